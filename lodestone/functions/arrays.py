"""Array helpers built from higher-order functions; nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 512


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use ``value`` several times in ``body`` but evaluate it once: a lambda variable holds it.
    Expressions that repeat a regular expression match would otherwise repeat its work. ``element_at`` works its type out once, ``get``
    from the whole body at each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(values: Column) -> Column:
    """An array in pieces of 512, for folds that append: what they copy on each step stays small."""
    return bind(
        values,
        lambda held: F.transform(
            F.sequence(F.lit(0), F.greatest((F.size(held) - 1) / _CHUNK, F.lit(0)).cast("int")),
            lambda c: F.slice(held, c * _CHUNK + 1, F.lit(_CHUNK)),
        ),
    )


def running(
    values: Column,
    initial: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    emitted: str,
) -> Column:
    """Walk an array with a state: for each value emit something from the state before it, then
    step the state. Gives the array of emitted values (of SQL type ``emitted``).

    ``aggregate`` copies its accumulator on each append, so one flat fold is quadratic. The fold
    runs over chunks of 512 and appends whole chunks, which keeps arrays of millions near linear
    while an ordinary array is a single chunk.
    """
    def one(acc: Column, value: Column) -> Column:
        return F.struct(
            step(acc["state"], value).alias("state"),
            F.array_append(acc["out"], emit(acc["state"], value)).alias("out"),
        )

    def fold_chunk(acc: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(acc["state"].alias("state"), F.array().cast(f"array<{emitted}>").alias("out")),
            one,
            lambda a: F.struct(
                a["state"].alias("state"), F.array_append(acc["out"], a["out"]).alias("out")
            ),
        )

    return F.aggregate(
        chunks(values),
        F.struct(initial.alias("state"), F.array().cast(f"array<array<{emitted}>>").alias("out")),
        fold_chunk,
        lambda a: F.flatten(a["out"]),
    )


def running_starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array."""
    return running(
        lengths, F.lit(0).cast("int"), lambda total, n: total + n, lambda total, _: total, "int"
    )
