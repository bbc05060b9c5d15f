import random

import numpy as np
import pytest
from helpers import write_tables

from lodestream.llm import url_filter as uf


def brute(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), r[0], r[1], r[2] == "allow"), default=None)
    if best:
        return host, path, best[0] + best[1], best[2]
    return host, path, None, "block" if host in listed else "allow"


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def rules_of(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def hosts_of(spark, hosts):
    return spark.createDataFrame([(h,) for h in hosts], "host string")


def random_urls(rng, n):
    tops, mids = ["com", "net", "org", "de"], [f"m{i}" for i in range(40)]
    for _ in range(n):
        host = ".".join([*rng.choices(mids, k=rng.randrange(3)), rng.choice(tops)])
        path = "".join("/" + rng.choice(["en", "fr", "a", "b", ""]) for _ in range(rng.randrange(4)))
        yield f"https://{host}{path}{rng.choice(['', '?q=/en/', '#x', '?', ':80/'])}"


def judged(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


@pytest.mark.parametrize("max_bytes", [uf.MAX_BYTES, 150])
def test_large_lists_against_brute_force(spark, max_bytes):
    """With a small limit the lists are dealt into sections, and several passes are made."""
    rng = random.Random(8)
    urls = list(random_urls(rng, 3000))
    rules = [(".".join([*rng.choices([f"m{i}" for i in range(40)], k=rng.randrange(2)), rng.choice(["com", "net"])]), rng.choice(["/", "/en", "/en/a", ""]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    hosts = sorted({brute(u, [], set())[0] for u in urls})
    listed = set(rng.sample(hosts, len(hosts) // 5)) | {"never.asked"}
    got = judged(uf.judge_urls(pages(spark, urls), rules_of(spark, rules), hosts_of(spark, listed), max_bytes=max_bytes))
    assert got == {i: brute(u, rules, listed) for i, u in enumerate(urls)}
    assert len({v[3] for v in got.values() if v[2] is None}) == 2


def test_cascades_are_exact(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 62), 1 << 62, (20_000, 2))
    for n in (1, 300, 19_990):
        rows = [(int(a), int(b), i < n) for i, (a, b) in enumerate(h)]
        cascade = uf.build_cascade(spark.createDataFrame(rows, "h1 long, h2 long, listed boolean"))
        u = h.astype(np.int64).view(np.uint64)
        assert (uf.members(u[:, 0], u[:, 1], cascade) == (np.arange(len(h)) < n)).all()
        if n == 300:
            assert len(cascade.levels) > 3
            assert cascade.n_bytes() * 8 < n * (1.5 * (np.log2(20_000 / n) + 3)) + 64 * len(cascade.levels)
    one = spark.createDataFrame([(1, 2, True)], "h1 long, h2 long, listed boolean")
    assert uf.build_cascade(one) == uf.Cascade([], True)
    assert uf.build_cascade(one.filter("h1 = 0")) == uf.Cascade([], False)


def test_odd_rows(spark, tmp_path):
    urls = [
        None, "", "no scheme/en/", "http://", "http:///x", "://a.net/", "HTTP://EXAMPLE.NET/en/x", "http://example.net/EN/x", "http://example.net", "http://example.net/?/en/",
        "http://example.net#/en/", "http://a.net://b.com/de/", "http://myexample.com/de/", "http://x.example.com/de/", "http://example.com/de", "http://b.ORG/fr/", "http://org/fr/a?b", "http://ÉXAMPLE.com/de/",
        "http://x.net:80/", "http://a b.net/", "http://x\ny.net/a\nb?c", "http://spam.example.org/de/", "http://" + "a." * 5000 + "net/" + "p" * 9000, "http://.net/", "http://net./", "http://cheap-PILLS.org/fr/x", "http://cheap-PILLS.org/",
    ]
    df = pages(spark, urls + urls[:9]).selectExpr("*", "1 AS host", "'clash' AS verdict", "page_id AS block")
    listed = uf.hosts_with_words(df)
    got = uf.judge_urls(df, rules_of(spark, uf.RULES), listed)
    assert sorted(got.columns) == sorted(["page_id", "url", "block", "host", "path", "rule", "verdict"])
    words = {brute(u, [], set())[0] for u in urls}
    words = {h for h in words if any(w in h for w in uf.LISTED_WORDS.split("|"))}
    assert judged(got) == {i: brute(u, uf.RULES, words) for i, u in enumerate(urls + urls[:9])}
    none = uf.judge_urls(df, rules_of(spark, []), hosts_of(spark, []))
    assert {(r["rule"], r["verdict"]) for r in none.collect()} == {(None, "allow")}
    assert uf.judge_urls(df.limit(0), rules_of(spark, uf.RULES), listed).count() == 0
    both = uf.judge_urls(pages(spark, ["http://net/"]), rules_of(spark, [("net", "/", "block"), ("net", "/", "allow"), ("net", "/", "allow")]), hosts_of(spark, ["net"]))
    assert judged(both) == {0: ("net", "/", "net/", "allow")}
    folder = write_tables(spark, tmp_path, pages=pages(spark, urls).selectExpr("page_id", "url", "'' AS html"))
    assert judged(uf.op13_url_filter(spark, folder)) == {i: brute(u, uf.RULES, words) for i, u in enumerate(urls)}
    with pytest.raises(ValueError):
        uf.judge_urls(df, rules_of(spark, [("net", "/" * n, "block") for n in range(300)]), listed)
