"""Named analysis plans over the driver tables (one module per study stage)."""

from importlib import import_module

_MODULES = ("volume", "posts", "complexity", "terms", "causal", "significance", "io")


def load_all() -> None:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
