"""forumshift: Spark-native analysis of how an outside event changes forum questions.

Sub-packages: ``sources`` (dumps, Parquet), ``functions`` (column expressions and
small per-task helpers), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(named queries over the driver tables) and ``streaming`` (restartable ingest).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers may not have this package on their path (the driver may run
    from anywhere, executors certainly do not share it).  Functions used in Arrow
    UDFs and grouped maps are therefore pickled by value, with everything they
    reference from this package."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: fall back to import by name
        pass


_ship_by_value()
