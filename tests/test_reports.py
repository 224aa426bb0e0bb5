import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import edits, outdated, retention, suggestions
from lodestone.operators.project_roots import find_project_roots
from lodestone.plans.outdated import render_outdated
from lodestone.sources.dependency_reports import parse_outdated


@pytest.fixture
def runs(spark):
    report = json.dumps({
        "a": {"current": "1", "wanted": "2", "latest": "3", "type": "devDependencies"}, "b": {"current": ""},
        "c": None, "d": 5, "e": [{"current": "9"}], "f": "{x", "g": {"latest": 4, "location": "/m/g"},
    })
    rows = [
        ("p1", 1, report, "", True, None, None), ("p2", 1, "{broken", "", True, None, None), ("p3", 0, " ", report, True, None, None),
        ("p4", 0, " ", "warn", True, None, None), ("p5", None, None, None, False, None, None),
        ("p6", None, None, None, True, "ENOENT", "x"), ("p7", None, None, None, True, None, "timeout hit"),
        ("p8", None, None, None, True, None, "ENOTDIR"), ("p9", 2, "{}", "", True, "2", "odd"), ("p0", 1, "", report, True, None, None),
    ]
    return parse_outdated(spark.createDataFrame(
        rows, "project string, exit_code int, stdout string, stderr string, has_manifest boolean, error_code string, error_message string"))


def test_outdated_rows(runs):
    rows = {r.package: r for r in outdated.explode_outdated(runs.filter("project = 'p1'")).collect()}
    assert set(rows) == {"a", "b", "e", "g"}
    assert (rows["a"].current, rows["a"].type) == ("1", "devDependencies")
    assert rows["b"][2:] == ("unknown", "unknown", "unknown", "p1", "dependencies")
    assert rows["e"].current == "unknown" and (rows["g"].latest, rows["g"].location) == ("4", "/m/g")
    kept = outdated.production_only(outdated.explode_outdated(runs.filter("project = 'p1'")))
    assert kept.count() == 3


def test_outdated_summary(runs):
    got = {r.project: (r.n_checked, r.n_outdated, r.has_outdated) for r in outdated.outdated_summary(runs).collect()}
    assert got["p1"] == got["p3"] == got["p0"] == (7, 4, True) and got["p2"] == got["p4"] == (0, 0, False)
    types = {(r.project, r.type): r.n for r in outdated.outdated_by_type(outdated.explode_outdated(runs)).collect()}
    assert types[("p1", "dependencies")] == 3 and types[("p1", "devDependencies")] == 1


def test_status(runs):
    got = {r.project: r.status for r in outdated.report_status(runs).collect()}
    assert got == {
        "p1": "outdated", "p0": "outdated", "p3": "outdated", "p2": "ok", "p4": "ok", "p5": "missing_manifest",
        "p6": "command_missing", "p7": "timeout", "p8": "bad_directory", "p9": "failed",
    }


def test_outdated_text(runs):
    one = runs.filter("project = 'p1'")
    detailed = [r.line for r in render_outdated(one).collect()]
    assert detailed[2:5] == ["**Project:** p1/package.json", "**Total Packages Checked:** 7", ""]
    assert detailed[5] == "Found 4 outdated packages:" and "   Latest:  3" in detailed
    summary = [r.line for r in render_outdated(one, "summary").collect()]
    assert summary[-2:] == ["- devDependencies: 1", "- dependencies: 3"]
    raw = [r.line for r in render_outdated(one, "raw", include_dev=False).collect()]
    assert raw[5:7] == ["**Raw Output:**", "```"] and raw[-1] == "Found 3 outdated packages"
    assert render_outdated(runs.filter("project = 'p2'")).collect()[-1].line == "All packages are up to date! 🎉"
    with pytest.raises(ValueError):
        render_outdated(one, "html")


def test_suggest_names(spark):
    names = spark.createDataFrame([(n,) for n in ["Germany", "Algeria", "Peru", "Peru", ""]], "n string")
    got = suggestions.suggest_names(names, "n", ["ger", " "], 3).orderBy("rank").collect()
    assert [(r.candidate, r.score) for r in got] == [("Germany", 0), ("Peru", 2), ("Algeria", 3)]


def test_project_roots(corpus):
    names = ["a/package.json", "a/b/package.json", "c/d/e/f/package.json", "c/d/e/f/g/package.json", "node_modules/x/package.json",
             ".h/package.json", "z/y/x/w/v/package.json"]
    files = corpus({f"/r/{n}": "" for n in names}, root="/r")
    assert [r.dir for r in find_project_roots(files).orderBy("rank").collect()] == ["/r/a", "/r/c/d/e/f"]
    top = corpus({"package.json": "", "a/package.json": ""})
    assert [r.dir for r in find_project_roots(top).collect()] == ["."]
    many = corpus({f"d{i}/package.json": "" for i in range(9)})
    assert find_project_roots(many).count() == 5


@pytest.fixture
def tree(corpus):
    return corpus({"/r/src/main.ts": "", "/r/src/mani.ts": "", "/r/source/x": "", "/r/a.txt": "", "/r/src/lib/package.json": ""}, root="/r")


def requests(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


def test_suggest_paths(spark, tree):
    asked = requests(spark, [("p", 1, "/r/src/mian.ts"), ("p", 2, "/r/sorce"), ("p", 3, "/none/x"), ("p", 4, "/r/src/mian.ts")],
                     "corpus_id string, request_id int, path string")
    got = {}
    for r in suggestions.suggest_paths(asked, tree).orderBy("rank").collect():
        got.setdefault(r.request_id, []).append(r.suggestion)
    assert got[1] == ["/r/src/main.ts", "/r/src/mani.ts", "/r/src/lib"] == got[4]
    assert got[2] == ["/r/source", "/r/src", "/r/a.txt"] and 3 not in got
    dirs = suggestions.suggest_paths(asked.filter("request_id = 2"), tree, dirs_only=True).orderBy("rank").collect()
    assert [r.suggestion for r in dirs] == ["/r/source", "/r/src"]


def test_suggest_project(spark, tree):
    asked = requests(spark, [("p", 1, "/r/src"), ("p", 2, "/r/sourc")], "corpus_id string, request_id int, path string")
    rows = suggestions.suggest_project(asked, tree).orderBy("request_id", "rank").collect()
    assert [(r.request_id, r.suggestion) for r in rows] == [
        (1, "/r/src"), (1, "/r/source"), (1, "/r/src/lib"), (2, "/r/source"), (2, "/r/src")]


def test_rename(spark, tree):
    rows = [(1, "/r/src", "/r/code"), (2, "/r/a.txt", "/r/b.txt"), (3, "/r/nope", "/r/n"), (4, "/r/source/x", "/r/src/main.ts"),
            (5, "/x", "/r/q"), (6, "/r/source", "/x"), (7, "/r/source", "/r/source/in"), (8, "/r/source/x", "/r/b.txt")]
    asked = requests(spark, [("p", *r) for r in rows], "corpus_id string, request_id int, old_path string, new_path string")
    after, status = edits.rename_paths(tree, asked, ["/r"])
    assert {r.request_id: r.status for r in status.collect()} == {
        1: "rename", 2: "rename", 3: "source_missing", 4: "destination_exists", 5: "source_outside", 6: "destination_outside",
        7: "failed", 8: "destination_exists"}
    assert sorted(r.path for r in after.collect()) == [
        "/r/b.txt", "/r/code/lib/package.json", "/r/code/main.ts", "/r/code/mani.ts", "/r/source/x"]
    assert after.filter("path = '/r/code/main.ts'").head().rel_path == "code/main.ts"


def test_delete(spark, tree):
    rows = [(1, "/r/src", False, False), (2, "/r/source", True, True), (3, "/r/a.txt", False, False), (4, "/r/no", False, False),
            (5, "/q", True, False)]
    asked = requests(spark, [("p", *r) for r in rows], "corpus_id string, request_id int, path string, recursive boolean, force boolean")
    after, status = edits.delete_paths(tree, asked, ["/r"])
    assert {r.request_id: r.status for r in status.collect()} == {
        1: "not_empty", 2: "deleted_directory", 3: "deleted_file", 4: "missing", 5: "outside"}
    assert sorted(r.path for r in after.collect()) == ["/r/src/lib/package.json", "/r/src/main.ts", "/r/src/mani.ts"]


@pytest.mark.parametrize("order", ["k", "d", "t", "x", "s"])
def test_newest_by_any_order(spark, order):
    """Few rows reach the sort, whatever the order's type, with equal values, nulls and what is not a number."""
    log = spark.range(3_000).select(
        "id", F.when(F.col("id") % 10 != 0, F.col("id") * 7 % 901).alias("k"), F.date_add(F.lit("2024-01-01"), (F.col("id") % 400).cast("int")).alias("d"),
        F.timestamp_seconds(F.col("id") * F.col("id")).alias("t"), F.col("id").cast("string").alias("s"),
        F.when(F.col("id") == 5, float("nan")).when(F.col("id") == 6, float("inf")).when(F.col("id") == 7, float("-inf")).otherwise(F.sqrt("id")).alias("x"),
    )
    for n in (1, 50, 2_900, 5_000):
        want = [r.id for r in log.orderBy(F.desc(order), F.desc("id")).limit(n).collect()]
        assert [r.id for r in retention.latest_n(log, [order, "id"], n).collect()] == want
    if order != "s":
        assert retention._newest_steps(log, order, log.schema[order].dataType, 50).count() < 200
    assert retention.latest_n(log.filter("false"), [order, "id"]).count() == 0


def test_retention(spark):
    log = spark.range(1001).select(F.col("id"), (F.timestamp_seconds(F.col("id"))).alias("ts"))
    kept = retention.latest_n(log, ["ts", "id"])
    assert kept.count() == 1000 and kept.agg(F.min("id")).head()[0] == 1
    per = retention.latest_per_key(log.withColumn("k", F.col("id") % 2), ["k"], ["ts"], 3)
    assert per.count() == 6
    assert isinstance(kept.head().ts, dt.datetime)


def test_falsy_fields_and_missing_manifests(spark):
    from lodestone.operators.outdated import explode_outdated
    from lodestone.sources.dependency_reports import parse_outdated

    report = '{"a": {"current": false, "wanted": 0, "latest": "", "type": true, "location": 5}}'
    runs = spark.createDataFrame([("p", 1, report, "", True), ("q", 1, report, "", False)],
                                 "project string, exit_code int, stdout string, stderr string, has_manifest boolean")
    rows = explode_outdated(parse_outdated(runs)).collect()
    assert [tuple(r) for r in rows] == [("p", "a", "unknown", "unknown", "unknown", "5", "true")]


def test_a_list_of_queries_is_sent_to_the_candidates(spark):
    """Not the candidates to the list, whose few rows would leave the scores of all names to one task."""
    names = spark.range(100).selectExpr("concat('n', id) AS n")
    plan = suggestions.suggest_names(names, "n", ["n1", "n2"], 2)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in join and "BuildRight" in join and "REPARTITION_BY_NUM" in plan
