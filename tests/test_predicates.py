import datetime as dt

from pyspark.sql import functions as F

from lodestone.operators import predicates as P
from lodestone.sources.tables import corpus_from_table

UTC = dt.timezone.utc


def paths(df):
    return sorted(r.path for r in df.collect())


def test_prune_and_hidden(corpus):
    files = corpus({n: "" for n in ["src/a.js", "node_modules/x.js", "dist", "src/build/y", ".env", ".github/w.yml"]})
    assert paths(P.prune_default_dirs(files)) == [".env", ".github/w.yml", "src/a.js"]
    assert paths(P.prune_default_dirs(files, "dirs")) == [".env", ".github/w.yml", "dist", "src/a.js"]
    assert ".github/w.yml" in paths(P.drop_hidden(files)) and ".env" not in paths(P.drop_hidden(files))


def test_extensions(corpus):
    files = corpus({n: "" for n in ["x.js", "x.min.js", "Makefile", "y.PY"]})
    assert paths(P.ext_in(files, ["js"])) == []
    assert paths(P.ext_in(files, [".JS"])) == ["x.js", "x.min.js"]
    assert paths(P.ext_in(files, ["."])) == ["Makefile"]
    assert paths(P.ext_not_in(files, ["js"])) == ["Makefile", "y.PY"]
    assert len(paths(P.ext_not_in(files, [".min.js"]))) == 4
    assert len(paths(P.ext_in(files, []))) == 4


def test_name_patterns(corpus):
    files = corpus({n: "" for n in ["my.test.ts", "tests/a.ts", "b.ts", "axb/c.ts"]})
    assert paths(P.exclude_names(files, ["*TEST*"])) == ["axb/c.ts", "b.ts"]
    assert len(paths(P.exclude_names(files, ["TEST"]))) == 4
    assert paths(P.exclude_names(files, ["a.b*"])) == ["b.ts", "my.test.ts", "tests/a.ts"]


def test_bounds(spark, corpus):
    files = corpus({"a": "", "b": "x" * 10, "c": "x" * 11})
    assert paths(P.size_between(files, 0, 10)) == ["a", "b"]
    assert paths(P.size_between(files, None, 0)) == ["a"]
    assert len(paths(P.max_depth(corpus({"a": "", "d/b": "", "d/e/c": ""}), 1))) == 2

    days = [dt.datetime(2024, 1, d, tzinfo=UTC) for d in (1, 2, 3)]
    df = spark.createDataFrame([(f"f{i}", "", t) for i, t in enumerate(days)], "p string, c string, m timestamp")
    dated = corpus_from_table(df, "p", "c", mtime="m")
    assert paths(P.modified_between(dated, "2024-01-02", "2024-01-02")) == ["f1"]
    assert len(paths(P.modified_between(dated, "not a date", ""))) == 3


def test_allow_list(corpus):
    files = corpus({"/a": "", "/a/b": "", "/ab": ""}, root="/")
    assert paths(P.under_roots(files, [" /a/ "])) == ["/a", "/a/b"]
    assert len(paths(P.under_roots(files, []))) == 3
    assert P.resolve_roots(["x", " /a ", "/a/", ""], "/r") == ["/r/x", "/a"]


def test_metadata_filters_do_not_read_content(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.createDataFrame([("a.js", "x")], "p string, c string").write.parquet(src)
    files = corpus_from_table(spark.read.parquet(src), "p", "c", size=F.lit(1))
    plan = P.ext_in(files, [".js"]).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p:string>" in plan


def test_forms_of_dates():
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    from lodestone.operators.predicates import parse_moment

    zone = "America/New_York"
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    assert parse_moment("2024", zone) == utc(2024, 1, 1) and parse_moment("2024-03", zone) == utc(2024, 3, 1)
    assert parse_moment("2024-03-05", zone) == utc(2024, 3, 5)
    assert parse_moment("2024/3/05", zone) == datetime(2024, 3, 5, tzinfo=ZoneInfo(zone))
    assert parse_moment("2024-13", zone) is None and parse_moment("soon", zone) is None


def test_relative_path_outside_the_root(spark):
    from lodestone.functions.paths import relative_path

    rows = [("/a/b/c.py", "/a/b"), ("/a/x/c.py", "/a/b"), ("/q", "/a/b/c"), ("/a/b", "/a/b"), ("x/y", "/a")]
    df = spark.createDataFrame(rows, "path string, root string").select(relative_path(F.col("path"), F.col("root")))
    assert [r[0] for r in df.collect()] == ["c.py", "../x/c.py", "../../../q", "", "x/y"]


def test_table_of_roots(spark, corpus):
    files = corpus({n: "x" for n in ["/a/b/c.py", "/a/b", "/ab/x", "/q/r/s", "/q/t", "rel/x"]})
    kept = lambda *roots: paths(P.under_root_table(files, spark.createDataFrame([(r,) for r in roots], "root string")))
    assert kept("/a/b", "/a/b/c.py", " /q/r/ ", None, " ") == ["/a/b", "/a/b/c.py", "/q/r/s"]
    assert kept("/") == ["/a/b", "/a/b/c.py", "/ab/x", "/q/r/s", "/q/t"]
    assert kept("rel") == ["rel/x"] and len(kept()) == 6 and kept("/none") == []


def test_roots_table_leaves_contents_alone(spark, tmp_path, monkeypatch):
    rows = [("", "", f"/r/d{i}/f{j}", f"text {i}") for i in range(6) for j in range(3)] + [("", "", "/r/d1", "x"), ("", "", "/q", "y")]
    made = corpus_from_table(spark.createDataFrame(rows, "c string, t string, p string, x string"), "p", "x", corpus_id="c", root="t")
    made.write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    roots = spark.createDataFrame([("/r/d1/",), (" /r/d2",), ("/r/d2/f1",), (None,), ("",), ("/none",)], "root string")
    kept = P.under_root_table(files, roots)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "content" in plan and not any(word in plan for word in ("Exchange", "Generate", "Join"))
    want = sorted(["/r/d1"] + [f"/r/d{i}/f{j}" for i in (1, 2) for j in range(3)])
    assert sorted(r.path for r in kept.collect()) == want
    assert P.under_root_table(files, roots.filter("false")).count() == 20
    assert P.under_root_table(files, spark.createDataFrame([("/",)], "root string")).count() == 20
    monkeypatch.setattr(P.PathTable, "of", lambda *a, **k: None)  # as for more roots than are sent
    assert sorted(r.path for r in P.under_root_table(files, roots).collect()) == want
