import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import predicates as P
from lodestone.plans.options import SearchOptions
from lodestone.plans.search import search
from lodestone.sources import listing, sinks
from lodestone.sources.listing import scan_corpus, with_content


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    texts = {"src/__init__.py": b"hit", "src/_p.py": b"", ".env": b"hit=1", ".github/w.yml": b"", "src/a.ts": b"no\nhit \xff",
             "src/empty.js": b"", "src/b.bin": b"hit\x00", "node_modules/x/i.js": b"hit", "deep/a/b/c.txt": b"x"}
    for name, body in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    os.symlink(root / "src", root / "link")
    return str(root)


def rel(df):
    return sorted(r.rel_path for r in df.collect())


def test_listing(spark, tree):
    files = scan_corpus(spark, [tree])
    assert rel(files) == [".env", ".github/w.yml", "deep/a/b/c.txt", "src/__init__.py", "src/_p.py", "src/a.ts", "src/b.bin", "src/empty.js"]
    assert rel(scan_corpus(spark, [tree], max_depth=0)) == [".env"]
    assert "node_modules/x/i.js" in rel(scan_corpus(spark, [tree], prune_default_dirs=False))
    assert rel(scan_corpus(spark, [tree, tree + "/missing"], tasks=1))[0] == ".env"
    row = files.filter("basename = 'a.ts'").head()
    assert row.size == 8 and row.ext == ".ts" and row.depth == 1 and abs(row.mtime.timestamp() - os.stat(row.path).st_mtime) < 1e-3 + 1


def test_wide_and_deep_trees(spark, tmp_path):
    for i in range(300):
        (tmp_path / "wide" / f"d{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"d{i}" / "f").write_text("x")
    deep = tmp_path.joinpath("deep", *["n"] * 12)
    deep.mkdir(parents=True)
    (deep / "f").write_text("x")
    files = scan_corpus(spark, [str(tmp_path)], tasks=3)
    assert files.count() == 301 and files.agg({"depth": "max"}).first()[0] == 13


def test_roots_may_overlap_and_be_uris(spark, tree):
    files = scan_corpus(spark, [tree, tree + "/src", "file://" + tree + "/deep", "file:///no/such/place"])
    assert files.filter("corpus_id like '%/src'").count() == 5
    assert [r.rel_path for r in files.filter("corpus_id like 'file:%'").collect()] == ["a/b/c.txt"]


def test_size_bound_reaches_the_scan(spark, tree):
    files = P.size_between(scan_corpus(spark, [tree]), 4, 5)
    assert rel(files) == [".env", "src/b.bin"]


def test_content(spark, tree):
    files = with_content(P.ext_not_in(scan_corpus(spark, [tree]), ["yml"]), partitions=2)
    got = {r.rel_path: (r.content, r.is_binary) for r in files.collect()}
    assert got["src/a.ts"] == ("no\nhit �", False) and got["src/b.bin"][1] and got["src/empty.js"] == ("", False)
    assert [r.rel_path for r in search(files, SearchOptions(pattern="hit", sort_by="file")).collect()] == [".env", "src/__init__.py", "src/a.ts"]


def test_unreadable_file_keeps_its_row(spark, tree):
    files = scan_corpus(spark, [tree]).filter("basename = 'a.ts'").selectExpr("* except (path)", "'/nowhere' as path")
    assert with_content(files).head().content is None


def test_sinks(spark, tree, tmp_path):
    files = with_content(scan_corpus(spark, [tree]))
    sinks.write_json(search(files, SearchOptions(pattern="hit")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_tasks_read_by_bytes(spark, tmp_path):
    sizes = [10, 90, 0, 50, 50, 1, 500, 99, 3] * 6
    for i, n in enumerate(sizes):
        (tmp_path / f"f{i}").write_bytes(b"x" * n)
    files = scan_corpus(spark, [str(tmp_path)], tasks=2)
    read = with_content(files, task_bytes=100).withColumn("task", F.spark_partition_id()).select("task", "size", F.length("content").alias("n"))
    tasks = read.groupBy("task").agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n"), F.sum("n").alias("read")).collect()
    assert sum(t.n for t in tasks) == len(sizes) and sum(t.read for t in tasks) == sum(sizes)
    assert all(t["size"] <= 100 or (t["size"] == t.most == 500) for t in tasks) and len(tasks) < len(sizes)
    assert with_content(files.filter("false")).count() == 0


def test_binary_files_are_not_read_whole(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\0" + b"y" * 5_000)
    (tmp_path / "late.txt").write_bytes(b"z" * 1_024 + b"\0")
    files = scan_corpus(spark, [str(tmp_path)])
    for binary in (True, False):
        got = {r.basename: r for r in with_content(files, binary=binary).collect()}
        assert got["a.bin"].is_binary and not got["late.txt"].is_binary and len(got["late.txt"].content) == 1_025
        assert (got["a.bin"].content is None) == (not binary)
    assert listing._read_bytes(str(tmp_path / "a.bin"), False) == (None, True)
