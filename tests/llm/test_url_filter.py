import numpy as np
from mailspark.llm.queries import URL_RULES
from mailspark.llm.url_filter import build_levels, probe, suffix_hashes, url_verdicts

PAGES = [
    (1, "http://a.example.com/en/1"),
    (2, "http://www.example.com/en/"),
    (3, "https://x.NET/es/q?y=1#z"),
    (4, "ftp://x.net/de/"),
    (5, "http://bad.org/x"),
    (6, "http://sub.bad.org?x=/en/"),
    (7, "http://good.org"),
    (8, "no scheme"),
    (9, None),
    (10, ""),
    (11, "http://example.com/en/"),
    (11, "http://example.com/en/"),
    (None, "http://com/a://b"),
    (12, "http://" + "d." * 300 + "bad.org/" + "p" * 5000),
    (13, "http://notexample.com/en/"),
    (14, "http://example.com"),
]
WANT = {
    1: ("example.com/en/", "block"),
    2: ("www.example.com/en/", "allow"),
    3: ("net/es/", "block"),
    4: (None, "allow"),
    5: (None, "block"),
    6: (None, "block"),
    7: (None, "allow"),
    8: (None, "allow"),
    9: (None, "allow"),
    10: (None, "allow"),
    11: ("example.com/en/", "block"),
    None: ("com/", "allow"),
    12: (None, "block"),
    13: ("com/", "allow"),
    14: (None, "allow"),
}


def verdicts(spark, **settings):
    pages = spark.createDataFrame([(*p, 1, "x") for p in PAGES], "page_id long, url string, listed int, host string")
    listed = spark.createDataFrame([("bad.org",), ("unseen.org",), ("bad.org",)], "key string")
    return url_verdicts(pages, URL_RULES, listed, **settings).collect()


def test_rules_and_list(spark):
    rows = verdicts(spark)
    assert len(rows) == len(PAGES)
    for r in rows:
        assert (r["rule"], r["verdict"]) == WANT[r["page_id"]], r


def test_large_lists_are_judged_by_shard(spark):
    assert sorted(map(tuple, verdicts(spark, broadcast_bytes=0, shard_keys=3)), key=repr) == sorted(map(tuple, verdicts(spark)), key=repr)


def test_keys_of_a_host_are_its_parents():
    assert suffix_hashes("") == []
    for host in ("a.b.c", "a..b.", ".", "é.b"):
        labels = host.split(".")
        keys = [".".join(labels[i:]) for i in range(len(labels))]
        assert suffix_hashes(host) == [suffix_hashes("x." + k)[1] for k in keys]
    assert len({h for x in ("a.b", "ab", "a.b.", ".a.b", "b.a") for h in suffix_hashes(x)[:1]}) == 5


def test_host_of_very_many_labels(spark):
    rows = [(1, "http://" + "d." * 200_000 + "bad.org/"), (2, "http://" + "d." * 200_000 + "good.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("bad.org",), (None,), ("",)], "key string")
    for settings in ({}, {"broadcast_bytes": 0, "shard_keys": 50_000}):
        got = {r["page_id"]: r["verdict"] for r in url_verdicts(pages, URL_RULES, listed, **settings).collect()}
        assert got == {1: "block", 2: "allow"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(pages, URL_RULES, spark.createDataFrame([], "key string")).count() == 0


def test_cascade_is_exact_over_its_universe():
    rng = np.random.default_rng(4)
    h1, h2 = rng.integers(-(2**62), 2**62, (2, 20_000))
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(20_000) < share
        levels = build_levels(h1, h2, listed)
        assert (probe(levels, h1, h2) == listed).all()
        assert share == 0 or len(levels) >= 1
