"""Operators for building training corpora (near copies, mixing, scans, formats).

Each ``opN`` module holds one general operator (``DataFrame -> DataFrame``) and the
thin registered query that applies it to the driver tables.  Nothing outside this
sub-package imports it; ``__spark_entry__`` adds its queries when it is present.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ngram_join", "mixing", "substrings", "secrets", "pseudonyms", "token_files", "decontaminate",
           "preferences", "quality", "wrappers", "prefix_trie", "bpe",
           "hard_negatives")


@dataclass(frozen=True)
class LlmQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def llm_queries() -> dict[str, LlmQuery]:
    """Name -> query of every operator of this sub-package."""
    out = {}
    for m in MODULES:
        q = import_module(f"{__name__}.{m}").QUERY
        out[q.name] = q
    return out
