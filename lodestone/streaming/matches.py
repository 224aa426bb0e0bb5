"""The per-file steps on a stream of files: they keep no state, so they run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.matching import find_matches
from ..plans.options import SearchOptions
from ..plans.search import pattern_of, searchable


def stream_matches(files: DataFrame, options: SearchOptions) -> DataFrame:
    """Match rows of arriving files (``files`` from ``readStream``), in append mode. Order and
    limits belong to a finished result and are left to the reader of the sink."""
    return find_matches(searchable(files, options), pattern_of(options), options.snippet_length)
