from collections import defaultdict

import pytest

from maskora.llm import warc_archive as wa
from maskora.llm.shared import scratch

ROWS = [(i, f"http://h{i % 7}.Example.org/p{i % 11}?q#f", f"<p>{i % 5}</p>" * 50) for i in range(60)]
ROWS += [(100, None, None), (101, "", ""), (102, "no scheme\r\nX: y", "é𠮷"), (103, "http://a.b/" + "x" * 3000, "long" * 100_000), (104, "http://dup/", "same"), (104, "http://dup/", "same"), (None, "http://null/", "same"), (None, "http://null2/", "only"), (105, "http://h1.example.org/p1?q#f", "\r\n\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, n int, key string")


def want(rows, least):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        first = max((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(payload) >= least and first is not None and i != first
            out.append((i, len(payload), wa.sha1_base32(payload), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,least", [(512, 0), (3, 10)])
def test_read_back(spark, monkeypatch, block, least):
    monkeypatch.setattr(wa, "BLOCK_LINES", block)
    got = sorted((tuple(r) for r in wa.archived(frame(spark, ROWS), least).collect()), key=repr)
    assert got == want(ROWS, least)


def test_lookup(spark, monkeypatch):
    monkeypatch.setattr(wa, "BLOCK_LINES", 4)
    directory = wa.write_archive(frame(spark, ROWS), scratch(spark, "warc-test"))
    for url in {u for _, u, _ in ROWS if u}:
        key = url.lower().split("/p")[0]
        got = {(r["page_id"], r["record_type"] == "revisit" or r["payload"].decode()) for r in wa.lookup(directory, url)}
        assert {i for i, _ in got} == {i for i, u, _ in ROWS if u and (u == url or (u.lower().startswith(key) and u.lower() == url.lower()))}
    assert wa.lookup(directory, "http://absent/") == []


def test_empty_table_and_damage(spark):
    assert wa.archived(frame(spark, [])).collect() == []
    data = wa.record(1, "u", b"abc", None, 3, wa.sha1_base32(b"abc"))
    assert wa.parse(data)["payload"] == b"abc"
    with pytest.raises(ValueError):
        wa.parse(data.replace(b"abc", b"abd"))
