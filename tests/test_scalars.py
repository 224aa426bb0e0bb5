import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrays, fuzzy, paths, text
from lodestone.functions.patterns import compile_pattern, to_java_regex


def values(spark, data, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_path_ext(spark):
    names = [".gitignore", "a.min.js", "a.", "..foo", ".a.js", "Makefile", "d.x/B.PY"]
    assert values(spark, names, paths.path_ext) == ["", ".js", ".", ".foo", ".js", "", ".py"]


def test_normalize_path(spark):
    given = ["/a/./b//c/..", "a/../b", "../x", "/..", "a/b/", "", "./x.ts", "/a/b.c", "a/../../b"]
    want = ["/a/b", "b", "../x", "/", "a/b", ".", "x.ts", "/a/b.c", "../b"]
    assert values(spark, given, paths.normalize_path) == want
    assert values(spark, ["x/../y", "/z"], lambda c: paths.normalize_path(c, "/r/s")) == ["/r/s/y", "/z"]


def test_relative_and_parents(spark):
    assert values(spark, ["/r/a/b", "/r", "/rx/a"], lambda c: paths.relative_path(c, "/r")) == ["a/b", "", "../rx/a"]
    assert values(spark, ["/a", "a", "/a/b", "a/b/c"], paths.dirname) == ["/", ".", "/a", "a/b"]
    assert values(spark, ["/a/b/c", "a/b/c", "x"], paths.ancestors) == [["/a", "/a/b"], ["a", "a/b"], []]


def test_format_size(spark):
    sizes = [0, 500, 1024, 1536, 10240, 1234567, 1024**3, 1024**4 * 3000, 1024**2 - 1]
    assert values(spark, sizes, paths.format_size, "long") == [
        "0 Bytes", "500 Bytes", "1 KB", "1.5 KB", "10 KB", "1.18 MB", "1 GB", "3000 TB", "1024 KB",
    ]


def test_file_class(spark):
    assert values(spark, [".ts", ".json", ".txt"], paths.file_class) == ["code", "config", None]


def test_binary_sniff_window(spark):
    inside, outside = b"a" * 1023 + b"\x00", b"a" * 1024 + b"\x00"
    assert values(spark, [inside, outside, b"", b"\x00"], text.is_binary, "binary") == [True, False, False, True]


def test_comment_masks(spark):
    def mask(ext):
        return lambda c: text.mask_comments(c, F.lit(ext))

    assert values(spark, ['a = "http://x"', "/*\n*/x"], mask(".js")) == ['a = "http:', "x"]
    assert values(spark, ["a # b\nc"], mask(".py")) == ["a \nc"]
    assert values(spark, ["a<!-- x\n y -->b"], mask(".html")) == ["ab"]
    assert values(spark, ["a // b # c"], mask(".txt")) == ["a // b # c"]


def test_string_masks(spark):
    long = '"' + "x" * 200_000 + '"'
    escaped = "'" + "\\'" * 20_000 + "'"
    assert values(spark, [long, escaped, "a 'b' `c\nd` \"e", '"a\\\nb"'], text.mask_strings) == [
        '""', "''", "a '' `` \"e", '"a\\\nb"',
    ]


def test_trim_is_wider_than_ascii(spark):
    assert values(spark, ["　﻿ a b \n"], text.trim_space) == ["a b"]


def test_running_starts(spark):
    data = [[1, 2, 3], [], list(range(1500))]
    got = values(spark, data, arrays.running_starts, "array<int>")
    assert got[0] == [0, 1, 3] and got[1] == []
    assert got[2] == [sum(range(i)) for i in range(1500)]


@pytest.mark.parametrize(
    "pattern, options, line, want",
    [
        ("a|b", dict(regex_mode=True, word_boundary=True), "ax xb", 2),
        (".*", {}, "foo", 0),
        ("a", dict(word_boundary=True), "éa", 1),
        ("É", {}, "é", 1),
        ("a.c", {}, "abc a.c", 1),
        ("x$", dict(regex_mode=True), "x\r", 0),
        ("x$", dict(regex_mode=True, multiline=True), "x\r", 1),
        (r"[\s[]", dict(regex_mode=True), "a [ ", 3),
        (r"a{b", dict(regex_mode=True), "a{b", 1),
        (r"\d{2}", dict(regex_mode=True), "123", 1),
        (r"\-\y", dict(regex_mode=True), "-y", 1),
        ("[^]", dict(regex_mode=True), "ab", 2),
        ("[a&&b]", dict(regex_mode=True), "ab&", 3),
        ("ab", dict(case_sensitive=True), "abAB", 1),
        ("42", {}, "42 4242", 3),
    ],
)
def test_pattern_dialect(spark, pattern, options, line, want):
    compiled = compile_pattern(pattern, **options)
    assert values(spark, [line], compiled.count_in_text) == [want]
    assert values(spark, [line], compiled.in_text) == [want > 0]


def test_bad_pattern_is_refused(spark):
    with pytest.raises(ValueError):
        compile_pattern("(", regex_mode=True)
    with pytest.raises(ValueError):
        compile_pattern("")
    assert compile_pattern("(").regex == r"(?i)\("
    assert to_java_regex("^a$") == r"\Aa\z"


def test_suggest_score(spark):
    def score(c):
        return fuzzy.suggest_score(F.lit("ger"), fuzzy.name_key(c))

    assert values(spark, ["Germany", "Algeria", "Peru"], score) == [0, 3, 2]
    assert values(spark, [" kitten "], lambda c: fuzzy.edit_distance(c, F.lit("SITTING"))) == [3]
