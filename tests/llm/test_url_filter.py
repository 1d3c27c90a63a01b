import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import url_filter as uf


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:].split("?")[0].split("#")[0]
    best = None
    for h, p, a in uf.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, a
    return host, path, best and best[0], best[1] if best else "allow"


URLS = [
    None, "", "no scheme/en/", "http://a.example.com/en/71?x#y", "HTTP://A.Example.COM/en/8", "http://com/en/", "http://xcom/en/", "http://net/de/9", "http://example.net/de/8#q",
    "http://www.example.net/de/81", "http://a.b.net/de", "ftp://x.org/es/1", "http://x.org?/es/", "http://x.org#://y.com/en/", "://", "http:///en/", "x://É.com/en/é", "a://b://c.com/en/", "http://m.org/es/\nx", "http://..com/en/1",
]


def test_matches_the_rules_one_by_one(spark):
    urls = URLS + [f"http://{h}.{d}/{p}/{n}" for h in ("a", "b.c") for d in ("example.com", "example.net", "org", "xnet") for p in ("en", "de", "es") for n in (7, 8, 70, 81)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, host string")
    got = uf.filter_urls(pages, uf.RULES).select("page.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == slow(urls[r.page_id])
    assert uf.filter_urls(pages.limit(0), uf.RULES).collect() == []
    assert {r.verdict for r in uf.filter_urls(pages, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, 30000))
    listed = keys[::40]
    df = spark.createDataFrame([(int(k),) for k in keys], "h long")
    cascade = uf.build_cascade(df, listed.view(np.uint64))
    assert (cascade.listed(keys.view(np.uint64)) == np.isin(keys, listed)).all()
    assert len(cascade.levels) > 2 and cascade.size_bytes < 4 * len(listed)
    assert not uf.build_cascade(df, np.zeros(0, np.uint64)).listed(keys.view(np.uint64)).any()
    alone = uf.build_cascade(df.filter(F.col("h").isin([int(x) for x in listed[:5]])), listed[:5].view(np.uint64))
    assert alone.listed(listed[:5].view(np.uint64)).all()


def test_long_hosts_and_paths(spark):
    """Hosts of very many labels, and very long paths, cost no more than their length."""
    host, path = ".".join(["a"] * 200_000) + ".example.com", "/en/7" + "x" * 1_000_000
    pages = spark.createDataFrame([(0, f"http://{host}{path}"), (1, f"http://{host}/en/8"), (2, f"http://{'b' * 500_000}.com/en/7")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.filter_urls(pages, uf.RULES).select("page.page_id", "rule", "verdict").collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("com/en/", "block")}


def test_lists_beyond_one_cascade(spark):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(-(2**62), 2**62, 20000))
    listed = keys[::9]
    df = spark.createDataFrame([(int(k),) for k in keys], "h long")
    dealt = uf.build(df, listed.view(np.uint64), most=600)
    assert len(dealt.cascades) == 4 and dealt.size_bytes > 0
    assert (dealt.listed(keys.view(np.uint64)) == np.isin(keys, listed)).all()
    rules = [(f"h{i}.com", "/x", "block") for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://h{i}.com/x") for i in range(80)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.filter_urls(pages, rules, most=7).select("page.page_id", "verdict").collect()}
    assert got == {i: "block" if i < 40 else "allow" for i in range(80)}
