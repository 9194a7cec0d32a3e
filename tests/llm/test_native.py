"""Exact dedup and URL filters against plain Python, with all edge cases."""

import hashlib
import re

from fundlens.llm import exact, urls

DOCS = "doc_id long, text string, keep_id string, h int, `a.b` int, norm string"


def test_exact_dedup(spark):
    texts = [(5, "a b"), (3, "a \t\n b"), (4, "A b"), (9, None), (7, ""), (8, " "), (6, "\x0b"), (3, "a b"), (None, "a b"),
             (None, "only null"), (10, "x" * 200_000), (11, "x" * 200_000), (12, "a\xa0b"), (1, "é"), (2, "é")]
    df = spark.createDataFrame([(i, t, "clash", 1, 2, "n") for i, t in texts], DOCS)
    got = sorted(map(tuple, exact.exact_dedup(df).collect()), key=repr)
    norm = [re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in texts]
    want = []
    for (i, _), n in zip(texts, norm):
        ids = [j for (j, _), m in zip(texts, norm) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact.exact_dedup(df.limit(0)).collect() == []


def fits(host, path, rule):
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def test_url_filter(spark):
    pages = ["http://example.net/en/a", "https://EXAMPLE.net/en/", "http://www.example.net/en", "http://a.b.net?x=1", "http://net/",
             "http://net", "http://xexample.com/de/", "http://example.com/de/x#y", "http://m.example.com/de/", "http://a.org/fr/b?c",
             "http://org/fr/", "http://a..org/fr/", "ftp://example.org/de/", "mailto:x@example.net", "", None, "://net/", "http:///de/",
             "http://example.com./de/", "http://a.net:80/", "http://u@b.net/x://org/fr/", "http://example.net/en/a",
             "http://" + "a." * 5000 + "net/", "http://x.net/" + "y" * 50_000, "http://ÄÖ.net/", "HTTP://é.ORG/fr/\n"]
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(pages)] + [(None, "http://a.net/", "x", "y", "z")],
                               "page_id long, url string, host string, rule string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    for i, u in [*enumerate(pages), (None, "http://a.net/")]:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        best = max((r for r in urls.RULES if fits(host, path, r)), key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    none = urls.judge_urls(df, urls.rule_table(spark, urls.RULES[:1]).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert urls.judge_urls(df.limit(0), urls.rule_table(spark, urls.RULES)).collect() == []


def test_url_filter_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://a.net/"), (2, "http://example.net/en/x"), (3, "http://a.de/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
    assert got == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow")}
