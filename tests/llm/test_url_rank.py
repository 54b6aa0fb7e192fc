import random
import re

import numpy as np
import pytest

from tessera.llm.queries import URL_RULES
from tessera.llm.url_rank import Rule, host_edges, judge, personalised


def pagerank(n, edges, seeds, d=0.85):
    w = np.zeros((n, n))
    for s, t, c in edges:
        w[s, t] += c
    out = w.sum(axis=1, keepdims=True)
    p = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    v = seeds / seeds.sum()
    r = v.copy()
    for _ in range(200):
        moved = d * (r @ p)
        r = moved + (1 - moved.sum()) * v
    return r


def test_ranks_against_matrix(spark):
    r = random.Random(1)
    edges = sorted({(a, b): r.randint(1, 5) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(40)) if a != b}.items())
    edges = [(a, b, c) for (a, b), c in edges]
    seeds = np.zeros(12)
    seeds[[0, 3]] = [2, 1]
    df = spark.createDataFrame([(f"h{a}", f"h{b}", c) for a, b, c in edges], "src string, dst string, n long")
    got = personalised(df, spark.createDataFrame([("h0", 2.0), ("h3", 1.0)], "host string, weight double"))
    want = pagerank(12, edges, seeds)
    have = {x.host: x["rank"] for x in got.collect()}
    assert all(have.get(f"h{i}", 0) == pytest.approx(want[i], abs=1e-4) for i in range(12))


def test_far_hosts_are_reached(spark):
    n = 36
    edges = [(i, i + 1, 1) for i in range(n - 1)]
    df = spark.createDataFrame([(f"h{a}", f"h{b}", c) for a, b, c in edges], "src string, dst string, n long")
    got = {x.host: x["rank"] for x in personalised(df, spark.createDataFrame([("h0", 1.0)], "host string, weight double"), tolerance=1e-2).collect()}
    want = pagerank(n, edges, np.eye(n)[0])
    assert len(got) == n and all(got[f"h{i}"] == pytest.approx(want[i], abs=1e-2) and got[f"h{i}"] > 0 for i in range(n))


def test_links(spark):
    html = """<a href="http://B.x/1">1</a><a href='//c.x?q'>2</a><A HREF=https://b.x/2>3</a><a href="/own">4</a><a href="http://a.x/">5</a>"""
    pages = spark.createDataFrame([("https://a.x/p", html), ("https://a.x/q", html), (None, html), ("nothing", None)], "url string, html string")
    assert sorted(map(tuple, host_edges(pages).collect())) == [("a.x", "b.x", 2), ("a.x", "c.x", 2)]


def ruled(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_the_first_of_equally_long_rules_wins(spark):
    rules = [Rule("org", "/a/b", "allow"), Rule("x.org", "/a", "block"), Rule("x.org", "/", "allow")]
    docs = spark.createDataFrame([(1, "http://x.org/a/b", None), (2, "http://x.org/a", None)], "page_id long, url string, html string")
    for own in (rules, rules[::-1]):
        got = {r.page_id: (r.rule, r.verdict) for r in judge(docs, own).collect()}
        assert got == {1: (own[[r.text for r in own].index("org/a/b" if own is rules else "x.org/a")].text, "allow" if own is rules else "block"), 2: ("x.org/a", "block")}


def test_long_hosts_and_wide_links(spark):
    far = "h" * 400 + ".net"
    page = f"<a href {' ' * 20}= {' ' * 20}'http://{far}/'>x</a>"
    docs = spark.createDataFrame([(1, "http://b.com/de/1", page), (2, f"http://{far}/", None), (3, "http://z.net/", f"<a href=//{far}>")], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust > 0) for r in judge(docs, [*URL_RULES, Rule(far, "/", "block")]).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("block", True)}


def test_many_hosts_are_joined_by_shuffle(spark, monkeypatch):
    import tessera.llm.url_rank as m

    docs = spark.createDataFrame([(1, "http://b.com/de/1", None), (2, None, None), (3, "http://s.net/", '<a href="http://b.com/">')], "page_id long, url string, html string")
    want = sorted(tuple(map(str, r)) for r in judge(docs, URL_RULES).collect())
    monkeypatch.setattr(m, "BROADCAST_HOSTS", 0)
    assert sorted(tuple(map(str, r)) for r in judge(docs, URL_RULES).collect()) == want and len(want) == 3


def test_verdicts(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/">x</a>' for x in h)
    urls = [
        ("http://A.example.org/es/1", ""), ("http://a.example.org/en/12?x", ""), ("http://notexample.org/es/1", ""), ("http://example.org", ""), ("http://org/", ""),
        ("http://b.com/de/1", link("farm.net")), ("http://c.com/fr/#x", link("good.net")), ("https://spam.net/", link("b.com")), ("https://good.net/x", ""),
        ("ftp://lone.net/a?b://c", ""), ("nohost", None), (None, None), ("http://b.com/xx", None), ("x://y://z.org/", ""),
    ]
    docs = spark.createDataFrame([(i, u, h, "keep") for i, (u, h) in enumerate(urls)], "page_id long, url string, html string, rule string")
    rows = {r.page_id: r for r in judge(docs, URL_RULES).collect()}
    for i, (u, _) in enumerate(urls):
        host, path, rule, verdict = ruled(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert verdict is None or rows[i].verdict == verdict
    assert [rows[i].verdict for i in (7, 8, 9, 10, 11, 12)] == ["block", "allow", "allow", "allow", "allow", "block"]
    assert judge(docs.limit(0), URL_RULES).count() == 0
