import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.patterns import compile_pattern
from lodestone.operators import matching
from lodestone.plans import search as S
from lodestone.plans.options import SearchOptions
from lodestone.sources import sinks


def spans(files, pattern, **options):
    rows = matching.find_matches(files, compile_pattern(pattern, **options)).orderBy("path", "line_no", "match_ord")
    return [(r.line_no, r.match_start, r.match_end) for r in rows.collect()]


def test_offsets(corpus):
    assert spans(corpus({"a": "foo bar foo é foo"}), "foo") == [(1, 0, 3), (1, 8, 11), (1, 14, 17)]
    assert spans(corpus({"a": "xx\n"}), ".*", regex_mode=True) == [(1, 0, 2), (1, 2, 2), (2, 0, 0)]
    assert spans(corpus({"a": "ax xb"}), "a|b", regex_mode=True, word_boundary=True) == [(1, 0, 1), (1, 4, 5)]
    assert spans(corpus({"a": "xx"}), "x") == [(1, 1, 2), (1, 3, 4)]


def test_many_matches_on_one_line(corpus):
    got = spans(corpus({"a": "ab" * 3000}), "ab")
    assert len(got) == 3000 and got[-1] == (1, 5998, 6000)


def test_snippets(corpus):
    files = corpus({"a": "0123456789foo0123456789"})
    row = matching.find_matches(files, compile_pattern("foo"), 3, with_line=True).head()
    assert row.snippet == "789foo012"
    assert matching.find_matches(files, compile_pattern("foo"), 0).head().snippet == row.line


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\n", max_size=30), min_size=1, max_size=5),
       st.sampled_from(["a", "ab", "a+", "b*", "(a|é)b?", "^a", "b$"]))
def test_matches_agree_with_another_engine(corpus, texts, pattern):
    files = corpus({f"f{i}": t for i, t in enumerate(texts)})
    compiled = compile_pattern(pattern, regex_mode=True, case_sensitive=True)
    got = sorted((r.path, r.line_no, r.match_start, r.match_end) for r in matching.find_matches(files, compiled).collect())
    want, counts = [], {}
    for i, t in enumerate(texts):
        for n, line in enumerate(t.split("\n"), 1):
            for m in re.finditer(pattern, line):
                want.append((f"f{i}", n, m.start(), m.end()))
                counts[f"f{i}"] = counts.get(f"f{i}", 0) + 1
    assert got == sorted(want)
    assert {r.path: r.n_matches for r in matching.match_counts(files, compiled).collect()} == counts


@pytest.fixture
def three(corpus):
    return corpus({"b.js": "x\nhit hit", "a.js": "hit // hit\n'hit'", "c.py": "# hit\nhit hit hit"})


@pytest.mark.parametrize("sort_by, want", [
    ("relevance", ["c.py", "a.js", "b.js"]), ("file", ["a.js", "b.js", "c.py"]),
    ("lineNumber", ["a.js", "c.py", "b.js"]), ("size", ["c.py", "a.js", "b.js"]),
])
def test_orders(three, sort_by, want):
    got = S.search(three, SearchOptions(pattern="hit", sort_by=sort_by)).collect()
    assert [r.path for r in got] == want
    assert [len(r.matches) for r in got] == [r.n_matches for r in got]


def test_masks_and_limits(three):
    options = SearchOptions(pattern="hit", exclude_comments=True, exclude_strings=True, max_results=2)
    assert [(r.path, r.n_matches) for r in S.search(three, options).collect()] == [("c.py", 3), ("b.js", 2)]
    assert S.result_summary(three, options).head() == (2, 5)
    flat = S.flat_matches(three, SearchOptions(pattern="hit", max_results=3)).collect()
    assert [(r.path, r.line_no) for r in flat] == [("c.py", 1), ("c.py", 2), ("c.py", 2)]


def test_default_pattern_is_literal(corpus):
    files = corpus({"a": "foo", "b": "x .* y"})
    assert [r.path for r in S.search(files, SearchOptions()).collect()] == ["b"]


def test_binary_is_skipped(corpus):
    files = corpus({"a": "hit\x00", "b": "hit"})
    assert [r.path for r in S.search(files, SearchOptions(pattern="hit")).collect()] == ["b"]
    both = S.search(files, SearchOptions(pattern="hit", include_binary=True)).collect()
    assert len(both) == 2


def lines(df):
    return [r.line for r in df.collect()]


def test_text_output(corpus):
    files = corpus({"a.txt": "\n".join(["hit"] * 12)})
    text = lines(S.render_search(files, SearchOptions(pattern="hit")).drop("x"))
    assert text[:3] == ['# Search Results for: "hit"', "Found 1 file(s) with matches", ""]
    assert text[3] == "## a.txt" and text[5] == "Matches: 12"
    assert sum(t.startswith("Line ") for t in text) == 10 and text[-2] == "... and 2 more matches"
    flat = lines(S.render_search(corpus({"a.txt": "hit\nhit hit"}), SearchOptions(pattern="hit", max_results=3, group_by_file=False)))
    assert flat[3:] == ["a.txt:1: hit", "a.txt:2: hit hit", "a.txt:2: hit hit", "", "... search truncated at 3 results"]
    assert lines(S.render_search(files, SearchOptions(pattern="none"))) == ["No matches found for pattern: none"]


def test_json_output(corpus):
    doc = json.loads(S.render_search(corpus({"a.txt": "xhit"}), SearchOptions(pattern="hit", output_format="json")).head().json)
    assert doc["matches"] == [{"lineNumber": 1, "lineContent": "xhit", "matchStart": 1, "matchEnd": 4, "snippet": "xhit"}]
    assert doc["fileSizeFormatted"] == "4 Bytes"


def test_json_array(corpus):
    files = corpus({"a.txt": "xhit", "b.txt": "hit hit", "c.txt": "no"})
    for pattern, want in (("hit", ["b.txt", "a.txt"]), ("no", ["c.txt"]), ("none", [])):
        for limit in (100, None):
            text = "\n".join(lines(S.render_json_array(files, SearchOptions(pattern=pattern, max_results=limit))))
            assert [d["filePath"] for d in json.loads(text)] == want
    assert text == "[]"


def test_array_without_a_limit_as_part_files(corpus, spark, tmp_path):
    """The part files of an array, one after another, are one document."""
    files = corpus({f"f{i:03}.txt": "hit " * (i % 7 + 1) for i in range(300)}).repartition(6)
    array = S.render_json_array(files, SearchOptions(pattern="hit", sort_by="file", max_results=None))
    sinks.write_text(array, str(tmp_path / "array"))
    parts = sorted((tmp_path / "array").glob("part-*.txt"))
    found = json.loads("".join(part.read_text() for part in parts))
    assert [d["filePath"] for d in found] == [f"f{i:03}.txt" for i in range(300)]
    assert [len(d["matches"]) for d in found] == [i % 7 + 1 for i in range(300)]
    text = S.render_search(files, SearchOptions(pattern="hit", group_by_file=False, max_results=None))
    assert [r.block for r in text.filter("block > 0").collect()] == list(range(1, sum(i % 7 + 1 for i in range(300)) + 1))


def test_request_arguments(corpus):
    options = SearchOptions.from_request({"pattern": "", "maxResults": 0, "path": "/a", "regexMode": True, "followSymlinks": False})
    assert (options.pattern, options.max_results, options.search_path) == (".*", 100, "/a")
    with pytest.raises(ValueError):
        SearchOptions.from_request({"nope": 1})
    with pytest.raises(ValueError):
        SearchOptions(sort_by="x")
    files = corpus({"/a/x": "hit", "/b/y": "hit"}, root="/")
    got = lines(S.search_request(files, {"pattern": "hit", "path": "/a"}, ["/a"]))
    assert "Found 1 file(s) with matches" in got
    with pytest.raises(PermissionError):
        S.search_request(files, {"pattern": "hit", "path": "/b"}, ["/a"])


def test_ranking_plan_is_narrow(corpus):
    plan = S.ranked_files(corpus({"a": "hit"}), SearchOptions(pattern="hit"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    match_plan = matching.find_matches(corpus({"a": "x"}), compile_pattern("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in match_plan


def test_head_per_file(corpus):
    grouped = matching.group_matches(matching.find_matches(corpus({"a": "x" * 12}), compile_pattern("x")))
    row = matching.head_per_file(grouped).select(F.size("matches").alias("n"), "overflow").head()
    assert (row.n, row.overflow) == (10, 2)


def test_stream_gives_the_same_matches(spark, corpus, tmp_path):
    from lodestone.streaming.matches import stream_matches

    files, src = corpus({"a.txt": "hit x hit", "b.txt": "no"}), str(tmp_path / "in")
    files.write.parquet(src)
    stream = spark.readStream.schema(files.schema).parquet(src)
    options = SearchOptions(pattern="hit")
    query = (
        stream_matches(stream, options).writeStream.format("memory").queryName("hits").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert sorted(r.match_start for r in spark.table("hits").collect()) == [0, 6]


def scans(df):
    """File scans of the plan that ran, without those whose exchange is shared."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan, plan.count("FileScan parquet")


@pytest.mark.parametrize("group_by_file", [True, False])
def test_report_reads_the_files_twice(spark, corpus, tmp_path, group_by_file):
    corpus({f"f{i}": f"x hit {i}" for i in range(30)}).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    options = SearchOptions(pattern="hit", max_results=3, exclude_strings=True, group_by_file=group_by_file)
    plan, n = scans(S.render_search(files, options))
    assert n <= 2


def test_masks_run_on_winners_only(spark, corpus, tmp_path):
    corpus({f"f{i}": f"x hit {i}" for i in range(30)}).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    found = S.search(files, SearchOptions(pattern="hit", max_results=3, exclude_strings=True))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    below_join = plan[plan.index("Join"):]
    assert below_join.count("regexp_replace") <= 2 * 3 + 2  # the count's own masks, once


def test_long_line_takes_linear_time(corpus):
    import time

    def seconds(n):
        files = corpus({"a": "abcdefgh " * n}).cache()
        files.count()
        start = time.perf_counter()
        rows = matching.find_matches(files, compile_pattern("cde")).selectExpr("count(*)", "max(match_end)", "max(length(snippet))").head()
        assert rows[0] == n and rows[1] == 9 * n - 4 and rows[2] == 103
        return time.perf_counter() - start

    seconds(1_000)
    small, large = seconds(14_000), seconds(112_000)  # the second line has 1 MB
    assert large < 8 * 3 * small + 5


def test_search_below_an_excluded_directory(corpus):
    files = corpus({"/r/build/x/a.py": "hit", "/r/src/deep/b.py": "hit", "/r/src/deep/c/d.py": "hit"}, root="/r")
    found = S.search(files, SearchOptions(pattern="hit", search_path="/r/build/x")).collect()
    assert [(r.path, r.rel_path) for r in found] == [("/r/build/x/a.py", "a.py")]
    found = S.search(files, SearchOptions(pattern="hit", search_path="/r/src/deep", max_depth=0)).collect()
    assert [r.rel_path for r in found] == ["b.py"]


def test_no_limit(corpus):
    files = corpus({f"f{i:03}": "hit" for i in range(150)})
    assert S.search(files, SearchOptions(pattern="hit")).count() == 100
    every = S.search(files, SearchOptions(pattern="hit", max_results=None, sort_by="file")).collect()
    assert [r.path for r in every] == [f"f{i:03}" for i in range(150)]
    text = lines(S.render_search(files, SearchOptions(pattern="hit", max_results=None)))
    assert text[1] == "Found 150 file(s) with matches" and sum(t.startswith("## ") for t in text) == 150


def test_letters_outside_ascii_fold_among_themselves(corpus):
    files = corpus({"a": "ı ſ K İ", "b": "É é", "c": "isk ISK"})
    count = lambda pattern, **o: {r.path: r.n_matches for r in matching.match_counts(files, compile_pattern(pattern, **o)).collect()}
    assert count("i") == {"c": 2} and count("s") == {"c": 2} and count("k", regex_mode=True) == {"c": 2}
    assert count("é") == {"b": 2} and count("[é]|k", regex_mode=True) == {"b": 2, "c": 2}


def test_rows_in_order_by_bytes(spark):
    """Parts have nearly equal bytes, not counts, and follow one another in order."""
    from lodestone.operators import packing

    sizes = [1000] * 10 + [1] * 990 + [None] * 1000
    places = spark.createDataFrame(list(enumerate(sizes, 1)), "place long, size long").withColumn("size", F.col("size") * 1000)
    rows = packing.in_order(places.orderBy(F.rand(1)), places, 2000, "place", "size")
    found = rows.withColumn("part", F.spark_partition_id()).collect()
    assert [r.place for r in found] == list(range(1, 2001))
    held = [sum(1 for r in found if r.part == p) for p in range(max(r.part for r in found) + 1)]
    assert held[0] == 1 and min(held) and len(held) > 4
    assert packing.in_order(places.limit(0), places.limit(0), 0, "place", "size").collect() == []


def test_array_is_sorted_before_matches_are_built(corpus):
    """What is shuffled and sorted has the texts; matches and documents, which may be far larger, are built in order."""
    files = corpus({f"{i}.txt": "hit " * (i + 1) for i in range(30)})
    for found in (S.render_json_array(files, SearchOptions(pattern="hit", sort_by="size", max_results=None)),
                  S.search(files, SearchOptions(pattern="hit", sort_by="size", max_results=None))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sort = plan.index("Sort [")
        assert "match_start" in plan[:sort] and "match_start" not in plan[sort:]


def test_edges_of_a_literal_are_looked_for_where_it_stands(spark):
    """The same matches as with both edges before the literal; wide letters are no word characters."""
    from lodestone.functions.patterns import ASCII_EDGE

    texts = ["import", "Import import", "reimport important _import import_ 1import", "(import)", "éimporté", "importimport import", "", "a.b", "xa.b a.bx a.b.a.b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for literal in ("import", "a.b", "a"):
        quick = compile_pattern(literal, word_boundary=True).regex
        plain = f"(?i){ASCII_EDGE}{re.escape(literal)}{ASCII_EDGE}"
        assert ASCII_EDGE not in quick
        marked = df.select(F.regexp_replace("t", quick, "<$0>").alias("a"), F.regexp_replace("t", plain, "<$0>").alias("b")).collect()
        assert any("<" in r.a for r in marked) and all(r.a == r.b for r in marked)


def test_text_is_made_once_for_matches(corpus):
    """Neither the look for the pattern nor the size of an array is a second place where a masked text is made."""
    files = corpus({"a.py": "import a # import b\n\nimport c", "b.py": "# import", "c.py": ""})
    masked = files.withColumn("content", F.regexp_replace("content", "#[^\n]*+", ""))
    found = matching.find_matches(masked, compile_pattern("import", word_boundary=True))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#[^") == 1
    assert sorted((r.path, r.line_no, r.match_ord, r.match_start, r.match_end, r.snippet) for r in found.collect()) == [
        ("a.py", 1, 1, 0, 6, "import a "), ("a.py", 3, 1, 0, 6, "import c")
    ]


def test_single_match_has_the_snippet_of_several(spark):
    """A line with one match takes a shorter way to the same structure."""
    rows = spark.createDataFrame([("x" * 30 + "hit" + "y" * 30,), ("hit",), ("hit and hit",), ("a hit\ue000 b",)], "line string")
    found = [[tuple(m) for m in r.m] for r in rows.select(matching.line_matches(F.col("line"), compile_pattern("hit"), 4).alias("m")).collect()]
    assert found == [[(30, 33, "xxxxhityyyy")], [(0, 3, "hit")], [(0, 3, "hit and"), (8, 11, "and hit")], [(2, 5, "a hit\ufffd b")]]
