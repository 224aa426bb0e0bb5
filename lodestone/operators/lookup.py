"""Look paths up in a table of paths inside a row, so that what the row holds besides is never moved.

The table becomes one sorted array, which every task gets and rows search by halving, for their path and the directories above it. A join would either send
whole rows, contents included, to the table's partitions or copy them for each directory. So it is for tables of checked size; larger ones have to be joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from ..functions.paths import ancestors

#: Rows of the largest table that is sent to every task.
MOST = 100_000


def self_and_above(path: Column) -> Column:
    return F.concat(ancestors(path), F.array(path))


def path_key(corpus_id: Column | None, path: Column) -> Column:
    """One string for a path of a corpus; corpora are told apart before paths."""
    return path if corpus_id is None else F.concat(corpus_id, F.lit("\x00"), path)


class PathTable:
    """A table of at most ``MOST`` rows by a distinct string ``key``, with further ``values``, to be searched in rows of another table."""

    def __init__(self, entries: Column, size: int, values: tuple[str, ...]) -> None:
        self.entries, self.size, self.values = entries, size, values

    @classmethod
    def of(cls, rows: DataFrame, key: str, *values: str, most: int = MOST) -> PathTable | None:
        """The table of ``rows``, or nothing if they are too many. Runs a job."""
        entry = F.struct(F.col(key).alias("key"), *values)
        listed = rows.select(entry.alias("entry")).limit(most + 1)
        n = listed.count()
        if n > most:
            return None
        kind = f"array<{listed.schema['entry'].dataType.simpleString()}>"
        sent = listed.agg(F.to_json(F.array_sort(F.collect_list("entry")))).first()[0]  # ``most`` rows at most
        return cls(F.from_json(F.lit(sent), kind), n, values)

    def __bool__(self) -> bool:
        return self.size > 0

    def find(self, key: Column) -> Column:
        """The entry with this key, or null."""
        return _halve(self.entries, self.size, key)

    def found(self, corpus_id: Column | None, path: Column) -> Column:
        """The entries of a path and of the directories above it, from the top down."""
        return F.array_compact(F.transform(self_and_above(path), lambda at: self.find(path_key(corpus_id, at))))


def _halve(entries: Column, size: int, key: Column) -> Column:
    """The entry of a sorted array that has this key."""

    def step(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.get(entries, middle)["key"] < key
        return F.struct(
            F.when((at["lo"] < at["hi"]) & below, middle + 1).otherwise(at["lo"]).alias("lo"),
            F.when((at["lo"] < at["hi"]) & ~below, middle).otherwise(at["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(size).alias("hi"))
    place = F.aggregate(F.sequence(F.lit(0), F.lit(size.bit_length())), start, step, lambda at: at["lo"])
    return bind(place, lambda i: bind(F.get(entries, i), lambda e: F.when(e["key"] == key, e)))
