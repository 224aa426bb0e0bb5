"""Messages for paths that aren't there."""

import pytest

from lodestone.materialize import materialize
from lodestone.plans.answers import missing_paths


def asked(spark, *paths):
    return spark.createDataFrame([("p", i, p) for i, p in enumerate(paths)], "corpus_id string, request_id int, path string")


@pytest.fixture
def tree(corpus):
    return corpus({p: "" for p in ["/r/src/main.ts", "/r/src/lib/package.json", "/r/source/x", "/r/a.txt"]}, root="/r")


def messages(df):
    return {r.request_id: r.message for r in df.collect()}


def test_directories_are_asked_for(spark, tree):
    requests = asked(spark, "/r/src", "/r/sourc", "/r/a.txt", "/r/none/x", "/x")
    assert messages(missing_paths(tree, requests, "search", ["/r"])) == {
        1: "The path '/r/sourc' does not exist or cannot be accessed. Did you mean: /r/source, /r/src?",
        2: "The path '/r/a.txt' does not exist or cannot be accessed. Did you mean: /r/src, /r/source?",
        3: "The path '/r/none/x' does not exist or cannot be accessed.",
    }
    assert messages(missing_paths(tree, requests, "explore"))[4] == "The path '/x' does not exist or is not a directory. Did you mean: /r?"


def test_any_path_and_manifests(spark, tree):
    requests = asked(spark, "/r/src", "/r/b.txt", "/r/src/lib")
    assert messages(missing_paths(tree, requests, "rename")) == {
        1: 'Source path "/r/b.txt" does not exist. Did you mean: /r/a.txt, /r/src, /r/source?'}
    assert messages(missing_paths(tree, requests, "delete"))[1].startswith('Path "/r/b.txt" does not exist. Did you mean: /r/a.txt')
    got = messages(missing_paths(tree, requests, "outdated"))
    assert got[0] == 'package.json not found in "/r/src". Did you mean: /r/src, /r/source, /r/src/lib?' and 2 not in got


def test_no_requests_and_unknown_askers(spark, tree):
    assert missing_paths(tree, asked(spark, "/r/q").filter("false"), "search").count() == 0
    with pytest.raises(ValueError):
        missing_paths(tree, asked(spark, "/r"), "print")


@pytest.mark.parametrize("asker", ["search", "explore", "outdated", "rename", "delete"])
def test_requests_that_look_small_are_not_sent_to_the_driver(spark, tree, asker):
    """Files of known, small size; a table of the same estimate may be many times larger once its paths are built and repeated."""
    files, requests = materialize(tree, "files"), materialize(asked(spark, "/r/sourc", "/r/none/x"), "asked")
    plan = missing_paths(files, requests, asker)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
