"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_batches
from lodestone.llm.components import connected_components
from lodestone.materialize import materialize

#: The index's reference points: a sample of one vector in PER_PIVOT, within these bounds.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 64, 16_384
#: A vector is described by its nearest reference points in order, and retrieved by those that share so many of them.
PREFIX, SHARED = 8, 2
#: Vectors of an inverted list that are compared within one task; longer lists are dealt into pieces.
PIECE = 768


def usable(embedding: Column, label: Column) -> Column:
    """Vectors with a label, at least one component other than zero, and none that is null or not finite."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(embedding) > 0) & sound & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares stay finite
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def choose_pivots(nodes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Reference points by their dimension: the vectors with the smallest hashes, ``MOST_PIVOTS`` at most in all."""
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT))
    draw = F.xxhash64("node", F.lit("pivot"))
    share = min(1.0, (2 * wanted + 100) / max(1, n))
    drawn = nodes.filter(F.shiftrightunsigned(draw, 11) / F.lit(2.0**53) < share)
    rows = drawn.select("embedding").orderBy(draw).limit(wanted).collect()
    by_size: dict[int, list] = {}
    for (vector,) in rows:
        by_size.setdefault(len(vector), []).append(vector)
    return {size: unit_rows(pa.array(v, pa.list_(pa.float64()))) for size, v in by_size.items()}


def nearest_pivots(rows: np.ndarray, pivots: np.ndarray | None, prefix: int = PREFIX) -> np.ndarray:
    """The numbers of each row's nearest reference points, nearest first. Without any all rows share made-up ones."""
    if pivots is None:
        return np.tile(-1 - np.arange(prefix), (len(rows), 1))
    near = rows @ pivots.T
    k = min(prefix, near.shape[1])
    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    order = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def describe(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``nodes`` with a column ``pivots``: the beginning of each vector's permutation of the reference points."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    schema = nodes.withColumn("pivots", F.array(F.lit(0))).schema

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                vectors = part.column(part.schema.get_field_index("embedding"))
                sizes = np.array([len(v) for v in vectors])
                out: list = [None] * part.num_rows
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    found = nearest_pivots(unit_rows(vectors.take(pa.array(at))), shared.value.get(int(size)))
                    for i, row in zip(at.tolist(), found.tolist(), strict=True):
                        out[i] = row
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.int32()))], names=schema.names)

    return map_batches(nodes, run, schema)


def _compare(pivot: int, left: dict, right: dict | None, least: float, shared: int) -> pa.RecordBatch:
    """Links between two pieces of one inverted list, or within one: for each vector its links' weight and a spanning forest.

    A pair is retrieved if the vectors share enough reference points, and then verified; it counts only in the list of the smallest
    reference point that both share, so that it counts once."""
    both = left if right is None else {k: np.concatenate([left[k], right[k]]) for k in left}
    n, m = len(both["node"]), len(left["node"])
    names, column = np.unique(both["pivots"], return_inverse=True)
    member = np.zeros((n, len(names)), np.float32)
    member[np.arange(n)[:, None], column.reshape(n, -1)] = 1
    counts = member @ member.T
    below = member[:, names < pivot]
    # where fewer reference points were drawn than have to be shared, all of them are
    retrieved = (counts >= min(shared, both["pivots"].shape[1])) & (below @ below.T == 0)
    rows = both["rows"]
    linked = retrieved & (rows @ rows.T >= least)
    np.fill_diagonal(linked, False)
    if right is not None:
        linked[:m, :m] = False
        linked[m:, m:] = False
    weights = linked @ both["copies"]
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        fresh = np.where(reach, label[None, :], n).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    at = np.flatnonzero(weights)
    return pa.RecordBatch.from_arrays(
        [pa.array(both["node"][at].tolist(), pa.string()), pa.array(both["node"][label[at]].tolist(), pa.string()), pa.array(weights[at].astype(np.int64))],
        names=["a", "b", "weight"],
    )


def verified_links(described: DataFrame, least: float, shared: int = SHARED) -> DataFrame:
    """Rows ``(a, b, weight)``: node ``a`` has links to ``weight`` other vectors by one inverted list, and ``b`` is reached through them."""
    listed = described.select(
        F.struct("label", F.size("embedding").alias("size")).alias("part"), "node", "embedding", "copies", "pivots", F.explode("pivots").alias("pivot")
    )
    lists = listed.groupBy("part", "pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = lists.select(
        F.col("part").alias("of"), F.col("pivot").alias("at"), F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")
    )
    placed = listed.join(lists, (F.col("part") == F.col("of")) & (F.col("pivot") == F.col("at")))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    # every two pieces meet, and each one meets itself
    meets = F.transform(
        F.sequence(F.lit(0), F.col("pieces") - 1),
        lambda other: F.struct(F.least(other, F.col("own")).alias("low"), F.greatest(other, F.col("own")).alias("high")),
    )
    dealt = placed.withColumn("own", own).withColumn("meet", F.explode(meets))
    dealt = dealt.select(
        F.xxhash64("part", "pivot", "meet").alias("unit"), "pivot", (F.col("own") == F.col("meet.low")).alias("first"),
        (F.col("meet.low") == F.col("meet.high")).alias("alone"), "node", "embedding", "copies", "pivots",
    )
    ordered = dealt.repartition("unit").sortWithinPartitions("unit", "pivot", F.desc("first"), "node")

    def run(batches) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                units = batch.column("unit").to_numpy()
                cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), batch.num_rows]
                for a, b in itertools.pairwise(cuts):
                    if b > a:
                        yield int(units[a]), batch.slice(a, b - a)

        for _, group in itertools.groupby(pieces(), key=lambda x: x[0]):
            rows = pa.Table.from_batches([part for _, part in group]).combine_chunks()
            column = lambda name: rows.column(name).combine_chunks()  # noqa: B023, E731
            data = {
                "node": np.array(column("node").to_pylist(), object),
                "rows": unit_rows(column("embedding")),
                "copies": column("copies").to_numpy().astype(np.float64),
                "pivots": column("pivots").flatten().to_numpy().reshape(rows.num_rows, -1),
            }
            pivot, first = int(column("pivot")[0].as_py()), column("first").to_numpy(zero_copy_only=False)
            if column("alone")[0].as_py():
                yield _compare(pivot, data, None, least, shared)
            else:
                left, right = ({k: v[mask] for k, v in data.items()} for mask in (first, ~first))
                if len(left["node"]) and len(right["node"]):
                    yield _compare(pivot, left, right, least, shared)

    return map_batches(ordered, run, "a string, b string, weight long")


def near_duplicate_vectors(
    vectors: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shared: int = SHARED
) -> DataFrame:
    """Rows ``(<vec_id>, n_links, component_id, kept)``, one for each row of ``vectors``.

    Vectors of equal label and dimension are linked if the index retrieves the pair and its cosine in double precision is at least ``least``.
    The index: reference points are a sample of the vectors (see the constants); every vector is described by its nearest ones in
    order and entered in their inverted lists; a pair is retrieved if it shares ``shared`` of them.

    Equal vectors are one node with a number of copies, which are links of each other. Lists are compared in pieces of bounded size.
    A vector that is null, empty or zero, or holds null or non-finite components, or has no label, is linked with nothing. A
    null id counts as larger than all others. Repeated rows are copies; an empty table gives no rows; other columns are not looked at.
    """
    value = F.col(embedding).cast("array<double>")
    marked = vectors.select(F.col(vec_id).alias("key"), F.col(label).alias("label"), value.alias("embedding"))
    sound = usable(F.col("embedding"), F.col("label"))
    node = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.lit("|"), F.col("embedding").cast("array<string>")).cast("binary"))
    sane = marked.filter(sound).select("key", node.alias("node"), "label", "embedding")
    nodes = sane.groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")
    )
    nodes = materialize(nodes, "vectors")
    pivots = choose_pivots(nodes, nodes.count())
    links = materialize(verified_links(describe(nodes.select("node", "label", "embedding", "copies"), pivots), least, shared), "vector_links")
    weights = links.groupBy("a").agg(F.sum("weight").alias("weight"))
    roots = connected_components(links.select("a", "b"))
    known = nodes.select("node", "key", "copies").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    known = known.join(weights, F.col("node") == F.col("a"), "left").select(
        "node", "key", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")
    )
    known = materialize(known, "vector_roots")
    least_key = known.groupBy("root").agg(F.min("key").alias("component_id")).withColumnRenamed("root", "of_root")
    least_key = materialize(least_key, "least")  # then a component with very many vectors can be split in the join
    found = known.join(least_key, F.col("root") == F.col("of_root")).select(F.col("node").alias("of"), "n_links", "component_id")
    linked = sane.select("key", "node").join(found, F.col("node") == F.col("of")).select("key", "n_links", "component_id")
    apart = marked.filter(~sound).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(apart).select(
        F.col("key").alias(vec_id), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )
