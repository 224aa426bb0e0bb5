"""Near-duplicate documents by circulant MinHash, banding and exact comparison of shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_batches, raw_texts, row_schema, text_slices
from lodestone.llm.components import connected_components
from lodestone.llm.hashing import POWER, mix, stretch_hashes
from lodestone.materialize import materialize

SHINGLE = 5
#: Coordinates of a band, and the chance that a pair just at the limit shares no band, from which the number of bands follows.
ROWS, MISSED = 5, 5e-7
#: Largest share of a candidate group that is compared within one task: texts and shingles.
UNIT_TEXTS, UNIT_SHINGLES = 256, 1 << 18
#: A shingle in more texts of a unit than this is counted by a matrix product, not pair by pair.
DENSE = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(documents: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles: runs of ``size`` words (bytes other than 0x20 and
    0x09-0x0D, A-Z lowered), or the whole sequence if there are fewer words; none without words."""
    joined = b"\n".join(documents).translate(_FOLD)
    raw = np.frombuffer(joined, np.uint8)
    if not len(raw):
        return [np.empty(0, np.uint64) for _ in documents]
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    words = stretch_hashes(raw, starts, ends)
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        runs = runs * np.uint64(POWER) + words[i : i + len(runs)]
    runs = mix(runs)
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    text_starts = np.cumsum(lengths + 1) - (lengths + 1)
    first = np.searchsorted(starts, text_starts).tolist()
    last = np.searchsorted(starts, text_starts + lengths).tolist()
    out = []
    for a, b in zip(first, last, strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(POWER) + w
            out.append(mix(np.array([h], np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _first_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers: it takes the structure out of the set's elements."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _second_permutation(x: np.ndarray) -> np.ndarray:
    """The permutation that is shifted."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of coordinates for each set, all from two permutations: coordinate ``k`` is the least place that the second
    permutation, shifted round by ``k``, gives to the elements in the order of the first. All sets have to have elements."""
    flat = np.concatenate(sets)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    placed = _first_permutation((flat ^ (flat >> np.uint64(32))).astype(np.uint32))
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_second_permutation(placed + np.uint32(k)), starts)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` coordinates; keys of different bands differ."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(signatures), bands))
    for i in range(rows):
        keys = mix(keys * np.uint64(POWER) + parts[:, :, i])
    return keys.astype(np.int64)


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The fewest bands that miss a pair with a similarity of ``percent`` with a chance of ``MISSED`` at most: 25 for 85, 37 for 80."""
    share = (min(max(percent, 1), 100) / 100) ** rows
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-share))) if share < 1 else 1


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketch(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int = ROWS) -> DataFrame:
    """Rows ``(key, node, n_shingles, bands)``: the document's id, its text's key, the size of its shingle set and its band
    keys (none for an empty set)."""
    schema = row_schema(docs.select(F.col(doc_id).alias("key")), "key", "node binary, n_shingles long, bands array<long>")

    def run(batches):
        for part in text_slices(batches):
            sets = shingle_sets(raw_texts(part.column("text")))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = [s for s in sets if len(s)]
            keys = band_keys(circulant_signatures(full, bands * rows), bands, rows) if full else np.empty((0, bands), np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("node"), pa.array(sizes), lists], names=schema.names)

    rows_in = docs.select(F.col(doc_id).alias("key"), text_key(F.col(text)).alias("node"), F.col(text).alias("text"))
    return map_batches(rows_in, run, schema)


def _linked(sets: list[np.ndarray], units: np.ndarray, percent: int) -> np.ndarray:
    """Whether texts ``i`` and ``j`` are of one unit and similar, from the exact sizes of all intersections."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    keys = np.concatenate(sets) ^ mix(units.astype(np.uint64))[owner]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    runs = np.diff(np.append(bounds, len(keys)))
    often = np.repeat(runs > DENSE, runs)
    column = np.repeat(np.cumsum(runs > DENSE) - 1, runs)
    both = np.zeros(n * n, np.int64)
    k, o = keys[~often], owner[~often]
    for step in range(1, DENSE):
        at = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else []
        if not len(at):
            break
        both += np.bincount(o[at] * n + o[at + step], minlength=n * n)
    both = both.reshape(n, n)
    both = both + both.T
    dense_owner, dense_column = owner[often], column[often]
    for a in range(0, int(runs[runs > DENSE].size), 2048):
        own = (dense_column >= a) & (dense_column < a + 2048)
        member = np.zeros((n, 2048), np.float32)
        member[dense_owner[own], dense_column[own] - a] = 1
        both += np.rint(member @ member.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    same = units[:, None] == units[None, :]
    return same & (both > 0) & (100 * both >= percent * union)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches."""
    n = len(linked)
    label = np.arange(n)
    linked = linked | np.eye(n, dtype=bool)
    while True:
        fresh = np.where(linked, label[None, :], n).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def compare_units(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between the nodes of each unit of ``members(unit, node, key)``: for every group of nodes that exact similarities hold
    together, each node with the group's first. ``texts(node, key, text)`` has the texts.

    A task works through whole units one after another, several small ones at once; a unit's bounded size bounds the memory."""
    placed = members.join(
        texts.withColumnsRenamed({"node": "node2", "key": "key2"}),
        (F.col("node") == F.col("node2")) & F.col("key").eqNullSafe(F.col("key2")),
    ).select("unit", "node", "text")
    ordered = placed.repartition("unit").sortWithinPartitions("unit", "node")

    def links(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        sets = shingle_sets([t for _, _, t in rows])
        number = {u: i for i, u in enumerate(dict.fromkeys(u for u, _, _ in rows))}
        units = np.fromiter((number[u] for u, _, _ in rows), np.int64, len(rows))
        root = _roots(_linked(sets, units, percent)).tolist()
        pairs = [(rows[i][1], rows[r][1]) for i, r in enumerate(root) if r != i]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"]
        )

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        size = whole = 0  # whole: rows of held before its last unit
        for part in text_slices(batches):
            for unit, node, body in zip(part.column("unit").to_pylist(), part.column("node").to_pylist(), raw_texts(part.column("text")), strict=True):
                if held and held[-1][:2] == (unit, node):
                    continue  # a repeated row of a text
                if held and held[-1][0] != unit:
                    if size > UNIT_SHINGLES * 6 or len(held) > UNIT_TEXTS:  # about six bytes a word
                        yield links(held)
                        held, size = [], 0
                held.append((unit, node, body))
                size += len(body)
        if held:
            yield links(held)

    return map_batches(ordered, run, "a binary, b binary")


def near_duplicate_components(
    docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", bands: int | None = None, rows: int = ROWS
) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows of ``docs`` and, for each distinct text with shingles, ``(of_node, least_key, component, root)``: the
    smallest id with that text, the smallest id among all texts that links lead to, and ``root``, which these texts share.

    1. Every text gets a circulant MinHash signature and band keys; equal texts fall into one node, by a minimum that
       is taken before the shuffle.
    2. Nodes with an equal band key are a candidate group. Groups with the same members in several bands are compared once.
    3. A group is dealt into units of bounded size by a hash of the node, each with the group's first node besides, and texts are
       compared exactly within a unit. So small groups are done, and in a large one most near copies are linked through its first node.
    4. What a large group holds outside the component of its first node is compared with all the rest in pairs of units; pairs inside
       that component are known to be connected and need no comparison.
    No pairs are written out: a unit gives at most a link for each of its nodes.
    """
    spark = docs.sparkSession
    sketches = materialize(sketch(docs, doc_id, text, bands or bands_for(percent, rows), rows), "sketches")
    full = sketches.filter("n_shingles > 0")
    nodes = full.groupBy("node").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("node", "key", "n_shingles", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_shingles").alias("shingles"),
        F.min(F.struct("node", "key")).alias("hub"),
        F.bit_xor(F.xxhash64("node")).alias("content"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("content2"),
    )
    # a group's members as a fingerprint: the same group in several bands is kept once
    groups = buckets.filter("n > 1").groupBy("content", "content2", "n", "shingles", "hub").agg(F.min("band").alias("group"))
    pieces = F.greatest(F.ceil(F.col("n") / UNIT_TEXTS), F.ceil(F.col("shingles") / UNIT_SHINGLES)).cast("int")
    groups = materialize(groups.select("group", "hub", pieces.alias("pieces")), "groups")
    joined = banded.join(groups, F.col("band") == F.col("group")).select("group", "hub", "pieces", "node", "key")
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    members = materialize(joined.select("group", "hub", "pieces", "node", "key", piece.alias("piece")), "members")
    unit = F.xxhash64("group", "piece")
    hubs = groups.filter("pieces > 1").select(
        F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "group", "hub.node", "hub.key"
    )
    first_units = members.select(unit.alias("unit"), "node", "key").unionByName(hubs.select(unit.alias("unit"), "node", "key"))
    texts = docs.select(text_key(F.col(text)).alias("node"), F.col(doc_id).alias("key"), F.col(text).alias("text"))
    links = materialize(compare_units(first_units.distinct(), texts, percent), "links")
    large = members.filter("pieces > 1")
    if not large.isEmpty():
        links = links.unionByName(_rest_of_large(large, links, texts, percent))
    roots = connected_components(links)
    known = nodes.select("node", "key")
    in_component = known.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    in_component = in_component.select("node", "key", F.coalesce("root", "node").alias("root"))
    in_component = materialize(in_component, "in_component")
    least = in_component.groupBy("root").agg(F.min("key").alias("component")).withColumnRenamed("root", "of_root")
    least = materialize(least, "least")  # then a component with very many texts can be split in the join
    found = in_component.join(least, F.col("root") == F.col("of_root")).select(
        F.col("node").alias("of_node"), F.col("key").alias("least_key"), "component", "root"
    )
    return sketches, found


def _rest_of_large(large: DataFrame, links: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The links that are missing in groups of several units: nodes outside the first node's component against all others."""
    roots = connected_components(links).withColumnsRenamed({"node": "of", "root": "at"})
    placed = large.join(roots, F.col("node") == F.col("of"), "left").withColumn("at", F.coalesce("at", "node")).drop("of")
    hub_roots = roots.withColumnsRenamed({"of": "hub_of", "at": "hub_at"})
    placed = placed.join(hub_roots, F.col("hub.node") == F.col("hub_of"), "left")
    placed = placed.withColumn("inside", F.col("at") == F.coalesce("hub_at", F.col("hub.node"))).drop("hub_of", "hub_at")
    placed = materialize(placed.select("group", "pieces", "node", "key", "inside"), "large")
    counted = placed.groupBy("group").agg(F.count_if(~F.col("inside")).alias("out"), F.count(F.lit(1)).alias("n"), F.first("pieces").alias("p"))
    counted = counted.filter("out > 0").select(
        F.col("group").alias("of"),
        F.greatest(F.ceil(F.col("out") * F.col("p") / F.col("n")), F.lit(1)).cast("int").alias("outs"),
        F.greatest(F.ceil((F.col("n") - F.col("out")) * F.col("p") / F.col("n")), F.lit(1)).cast("int").alias("ins"),
    )
    dealt = placed.join(counted, F.col("group") == F.col("of"))
    own = F.pmod(F.xxhash64("node", F.lit("piece")), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs"))).cast("int")
    dealt = dealt.withColumn("own", own)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # an outer piece meets each outer and each inner piece; inner pieces don't meet
    units = F.when(
        F.col("inside"), F.transform(every("outs"), lambda o: F.xxhash64("group", F.lit("in"), o, "own"))
    ).otherwise(
        F.concat(
            F.transform(every("outs"), lambda o: F.xxhash64("group", F.lit("out"), F.least(o, F.col("own")), F.greatest(o, F.col("own")))),
            F.transform(every("ins"), lambda i: F.xxhash64("group", F.lit("in"), F.col("own"), i)),
        )
    )
    return materialize(compare_units(dealt.select(F.explode(units).alias("unit"), "node", "key"), texts, percent), "links")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(<doc_id>, n_shingles, component_id, kept)``, one for each row of ``docs``.

    Documents are linked if ``100 * intersection >= percent * union`` of their shingle sets (see ``shingle_sets``; confirmed on the full
    sets). ``component_id`` is the smallest id that links lead to, ``kept`` whether that is the document's own.

    Null and empty texts, and those of white space, have no shingles and are linked with nothing. A null id counts as larger
    than all others, so a component has a null id only if all its ids are. Repeated rows get equal results; an empty table gives no
    rows; other columns are not looked at. Texts are read whole.
    """
    sketches, found = near_duplicate_components(docs, percent, doc_id, text)
    rows = sketches.select("key", "node", "n_shingles").join(found, (F.col("node") == F.col("of_node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key"))
    return rows.select(
        F.col("key").alias(doc_id),
        "n_shingles",
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one document stays, that with the smallest id, and every document without words. A
    null id counts as larger than all others; of several texts with the smallest id, or with null ids alone, one stays, and of repeated rows one. Null, empty
    and blank texts all stay, repeated ones too; an empty table stays empty. All columns are kept. Unlike ``near_duplicates``, whose default is the
    contract of its query, documents are linked from a similarity of 0.8 on."""
    _, found = near_duplicate_components(docs, percent, doc_id, text)
    order = F.struct(F.col("least_key").isNull().alias("no_id"), "least_key", "of_node")
    stays = found.groupBy("root").agg(F.min(order).alias("first")).select(
        F.col("first.of_node").alias("__node"), F.col("first.least_key").alias("__key")
    )
    has_words = F.coalesce(F.col(f"`{text}`").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.filter(has_words).withColumns({"__of": text_key(F.col(f"`{text}`")), "__id": F.col(f"`{doc_id}`")})
    chosen = keyed.join(stays, (F.col("__of") == F.col("__node")) & F.col("__id").eqNullSafe(F.col("__key")))
    chosen = chosen.dropDuplicates(["__of", "__id"]).drop("__of", "__id", "__node", "__key")
    return chosen.unionByName(docs.filter(~has_words))
