"""Renames and deletes on file tables: requests in order, and plans that leave contents where they are."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.materialize import materialize
from lodestone.operators import edits
from lodestone.operators.lookup import PathTable, path_key

FORM = "corpus_id string, request_id int, old_path string, new_path string"


def in_order(paths, asked):
    """One request after another on a set of paths, as a file system would."""
    tree, status = {p: p for p in paths}, {}
    for number, old, new in sorted(asked):
        there = lambda at: any(p == at or p.startswith(at + "/") for p in tree.values())
        if not there(old):
            status[number] = "source_missing"
        elif there(new):
            status[number] = "destination_exists"
        elif new.startswith(old + "/"):
            status[number] = "failed"
        else:
            status[number] = "rename" if old.rpartition("/")[0] == new.rpartition("/")[0] else "move"
            tree = {o: new + p[len(old) :] if p == old or p.startswith(old + "/") else p for o, p in tree.items()}
    return tree, status


@pytest.fixture
def made(spark, corpus):
    def build(paths, corpus_id="p"):
        return corpus({p: p for p in paths}, corpus_id, "/r")

    return build


def after_and_status(files, requests):
    after, status = edits.rename_in_order(files, requests)
    return {r.content: r.path for r in after.collect()}, {r.request_id: r.status for r in status.collect()}


def test_chains_and_swaps(spark, made):
    paths = ["/r/a", "/r/b", "/r/d/x", "/r/d/e/y"]
    asked = [
        (1, "/r/a", "/r/t"), (2, "/r/b", "/r/a"), (3, "/r/t", "/r/b"),  # a swap
        (4, "/r/d/e", "/r/e2"), (5, "/r/d", "/r/D"), (6, "/r/e2", "/r/D/e"), (7, "/r/D", "/r/d"), (8, "/r/d/e/y", "/r/d/y/z"), (9, "/r/d/e", "/r/q"),
    ]
    got, status = after_and_status(made(paths), spark.createDataFrame([("p", *a) for a in asked], FORM))
    assert got == {"/r/a": "/r/b", "/r/b": "/r/a", "/r/d/x": "/r/d/x", "/r/d/e/y": "/r/d/y/z"}
    assert status == in_order(paths, asked)[1] and status[9] == "source_missing"


@pytest.mark.parametrize("seed", range(3))
def test_random_requests_against_brute_force(spark, made, seed):
    rng = random.Random(seed)
    name = lambda: "/r/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
    paths = {f"{name()}/f{i}" for i in range(12)}
    asked = [(i, name() if rng.random() < 0.7 else rng.choice(sorted(paths)), name()) for i in range(9)]
    got, status = after_and_status(made(sorted(paths)), spark.createDataFrame([("p", *a) for a in asked], FORM))
    assert (got, status) == in_order(paths, asked)


def test_roots_corpora_and_nothing_to_do(spark, made):
    files = made(["/r/a"]).unionByName(made(["/r/a"], "q"))
    asked = spark.createDataFrame([("p", 1, "/r/a", "/r/b"), ("q", 1, "/x/a", "/r/b"), ("q", 2, "/r/a", "/x")], FORM)
    after, status = edits.rename_in_order(files, asked, ["/r"])
    assert sorted((r.corpus_id, r.path) for r in after.collect()) == [("p", "/r/b"), ("q", "/r/a")]
    assert sorted((r.corpus_id, r.status) for r in status.collect()) == [("p", "rename"), ("q", "destination_outside"), ("q", "source_outside")]
    for fn in (edits.rename_in_order, edits.rename_paths):
        after, status = fn(files, asked.filter("false"))
        assert after.count() == 2 and status.count() == 0


def test_contents_are_not_shuffled(spark, made, tmp_path):
    made([f"/r/d{i % 7}/f{i}" for i in range(50)]).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    renames = spark.createDataFrame([("p", i, f"/r/d{i}", f"/r/e{i}") for i in range(5)], FORM)
    deletes = renames.selectExpr("corpus_id", "request_id", "old_path AS path", "true AS recursive", "false AS force")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for after in (edits.rename_paths(files, renames)[0], edits.rename_in_order(files, renames)[0], edits.delete_paths(files, deletes)[0]):
            plan = after._jdf.queryExecution().executedPlan().toString()
            assert "content" in plan and "Exchange" not in plan and "Join" not in plan
            assert after.count() in (50, 14)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_requests_that_look_small_are_not_sent_to_the_driver(spark, made, monkeypatch):
    files = materialize(made([f"/r/d{i % 7}/f{i}" for i in range(50)]), "files")
    renames = materialize(spark.createDataFrame([("p", i, f"/r/d{i}", f"/r/e{i}") for i in range(5)], FORM), "asked")
    deletes = renames.selectExpr("corpus_id", "request_id", "old_path AS path", "true AS recursive", "false AS force")
    monkeypatch.setattr(edits.PathTable, "of", lambda *a, **k: None)
    judged = [edits.rename_status(files, renames), edits.delete_status(files, deletes)]
    for df in (*judged, edits.rename_paths(files, renames)[0], edits.rename_in_order(files, renames)[0], edits.delete_paths(files, deletes)[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_more_rules_than_are_sent(spark, made, monkeypatch):
    paths = [f"/r/d{i}/f" for i in range(6)]
    asked = [(i, f"/r/d{i}", f"/r/e{i}") for i in range(4)] + [(9, "/r/e1", "/r/g")]
    requests = spark.createDataFrame([("p", *a) for a in asked], FORM)
    ordered, first = after_and_status(made(paths), requests), sorted(r.path for r in edits.rename_paths(made(paths), requests)[0].collect())
    monkeypatch.setattr(edits.PathTable, "of", lambda *a, **k: None)
    assert after_and_status(made(paths), requests) == ordered == in_order(paths, asked)
    assert sorted(r.path for r in edits.rename_paths(made(paths), requests)[0].collect()) == first


@pytest.mark.parametrize("n", [0, 1, 2, 20, 40])
def test_lookup(spark, n):
    rows = spark.createDataFrame([("p", f"/r/d{i}", i) for i in range(0, 2 * n, 2)] + [("q", "/r", -1)], "corpus_id string, at string, n int")
    keyed = rows.select(path_key(F.col("corpus_id"), F.col("at")).alias("key"), "n")
    assert PathTable.of(keyed, "key", "n", most=n) is None
    table = PathTable.of(keyed, "key", "n", most=n + 1)
    asked = [("p", f"/r/d{i}/x/y") for i in range(-1, 81)] + [("q", "/r/d2"), ("p", "/r"), ("q", "/r"), ("p", "/r/d22")]
    df = spark.createDataFrame(asked, "corpus_id string, path string")
    got = {(r.corpus_id, r.path): [e.n for e in r.found] for r in df.select("*", table.found(F.col("corpus_id"), F.col("path")).alias("found")).collect()}
    want = {a: [] for a in asked} | {("p", f"/r/d{i}/x/y"): [i] for i in range(0, 2 * n, 2)} | {("q", "/r/d2"): [-1], ("q", "/r"): [-1]}
    assert got == want | ({("p", "/r/d22"): [22]} if n > 11 else {})
