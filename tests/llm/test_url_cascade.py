from pyspark.sql import functions as F

from lodestone.llm import url_cascade as U
from lodestone.llm.queries import URL_RULES, op7_url_cascade

SF = "/root/testdata/sf0.001"


def test_membership_is_exact_at_any_filter_size(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) key", "id % 7 = 0 listed").cache()
    for bits in (2, 4, 12):
        cascade = U.build_cascade(universe, bits_per_key=bits)
        assert universe.filter(cascade.listed(F.col("key")) != F.col("listed")).count() == 0
        if bits == 2:
            assert len(cascade.levels) > 2
    assert U.build_cascade(universe, max_bits=64) is None
    assert U.build_cascade(universe.filter("not listed")).levels == ()


def pages(spark):
    urls = [
        "http://Example.NET/en/1", "https://a.example.net/en/2?x=/de/", "http://example.net/de/", "http://notexample.com/de/x",
        "http://x.example.com/de/", "http://x.example.com/de", "http://b.org/fr/", "http://b.org/en/#/fr/", "http://c.io#frag", "http://c.io?q",
        "no scheme", "", None, "http://", "://h/p", "http://net", "http://net/", "http://listed.io/a", "http://listed.io/a", "a://b://c/d",
        "HTTP://ÉX.io/Ä",
    ]
    return spark.createDataFrame([(i, u, "block", "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string, host string")


def test_hosts_paths_rules_and_verdicts(spark):
    listed = spark.createDataFrame([("listed.io/a",), ("listed.io/a",), (None,), ("absent/",)], "key string")
    want = {
        0: ("example.net", "/en/1", "example.net/en/", "allow"),
        1: ("a.example.net", "/en/2", "example.net/en/", "allow"),
        2: ("example.net", "/de/", "net/", "block"),
        3: ("notexample.com", "/de/x", None, "allow"),
        4: ("x.example.com", "/de/", "example.com/de/", "block"),
        5: ("x.example.com", "/de", None, "allow"),
        6: ("b.org", "/fr/", "org/fr/", "allow"),
        7: ("b.org", "/en/", None, "allow"),
        8: ("c.io", "", None, "allow"),
        10: ("", "", None, "allow"),
        12: ("", "", None, "allow"),
        13: ("", "", None, "allow"),
        14: ("h", "/p", None, "allow"),
        15: ("net", "", None, "allow"),
        16: ("net", "/", "net/", "block"),
        17: ("listed.io", "/a", None, "block"),
        18: ("listed.io", "/a", None, "block"),
        19: ("b:", "//c/d", None, "allow"),
        20: ("Éx.io", "/Ä", None, "allow"),
    }
    for most in (U.MAX_BITS, 8):  # the cascade, and the join beyond its bound
        found = U.judge_urls(pages(spark), URL_RULES, listed, max_bits=most).collect()
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
        assert len(found) == 21 and {k: got[k] for k in want} == want


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "key string")
    assert {r.verdict for r in U.judge_urls(pages(spark), [], nothing).collect()} == {"allow"}
    assert U.judge_urls(pages(spark).filter("false"), URL_RULES, nothing).collect() == []


def test_no_python_and_no_join_on_pages(spark):
    plan = op7_url_cascade(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
