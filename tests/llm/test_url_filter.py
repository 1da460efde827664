import re

import pytest

from maskora.llm import url_filter as uf


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, uf.DEFAULT))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org", "http://example.org/en/12", "http://example.org/en/2", "x://b.com/de/", "x://com/de", "x://com/fr/é?://", "http://org/", "http://notorg/", "http://a.b.org:80/", "http://u@c.com/de/x", "http://é.com/fr/", "http://com?/fr/", "http://.org/", "y://a..org/" + "p" * 100_000, "http://x.com/fr/", "http://x.com/fr/"]


def test_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "z", "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string, path string")
    manifest = uf.build(spark.createDataFrame(uf.RULES, "host string, path string, verdict string"))
    got = {r["page_id"]: tuple(r)[1:] for r in uf.filter_urls(pages, manifest).collect()}
    assert got == {i: brute(u, uf.RULES) for i, u in enumerate(URLS)}
    assert uf.filter_urls(pages.limit(0), manifest).collect() == []


def test_many_shards_and_no_rules(spark, monkeypatch):
    monkeypatch.setattr(uf, "SHARD_RULES", 50)
    rules = [(f"h{i % 37}.net", f"/{i}", "block" if i % 3 else "allow") for i in range(500)] + [("dup.net", "/a", "allow"), ("dup.net", "/a", "block"), (None, "/", "block"), ("bad.net", "/", "drop")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = [f"http://w.h{i % 41}.net/{i}{i % 5}" for i in range(600)] + ["http://dup.net/a", "http://bad.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    kept = [r for r in rules if r[0] and r[2] != "drop" and r != ("dup.net", "/a", "allow")]
    got = {r["page_id"]: tuple(r)[1:] for r in uf.filter_urls(pages, uf.build(frame)).collect()}
    assert got == {i: brute(u, kept) for i, u in enumerate(urls)}
    none = uf.filter_urls(pages, uf.build(frame.limit(0)))
    assert {r["verdict"] for r in none.collect()} == {uf.DEFAULT}


def test_collisions_are_confirmed(monkeypatch, spark):
    monkeypatch.setattr(uf, "_digest", lambda rule: 7)
    rows = list(uf._write([__import__("pyarrow").RecordBatch.from_pylist([{"host": h, "path": p, "verdict": v} for h, p, v in uf.RULES])], "/tmp/maskora-url-test"))
    path = rows[0]["path"][0].as_py()
    assert [tuple(x) for x in uf.judge(URLS, [path], [1, 4, 5])] == [brute(u, uf.RULES) for u in URLS]


@pytest.mark.parametrize("url,parts", [("a://b/c?d", ("b", "/c")), ("a://b?c/d", ("b", "")), ("a://b#/c", ("b", "")), ("://x", ("x", ""))])
def test_parts(url, parts):
    assert uf.host_and_path(url) == parts
