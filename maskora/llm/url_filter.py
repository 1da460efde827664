"""URL rules in sorted digest arrays.

A rule is a host and a path prefix with a verdict. Rules are dealt into shards by the hash of
host + path and written to the shared folder: sorted 64-bit xxhash keys, string offsets, the strings.
Workers memory-map the shards, so a list of any length costs a worker only the pages that it touches. A url
asks for each suffix of its host with each length of path that rules have; all questions of a batch are
answered by one vectorised binary search for a shard, and a hit counts only if the stored string is equal.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import create, local_path, open_file
from .shared import scratch, written

#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
SHARD_RULES = 4_000_000
_HEAD = struct.Struct("<8sQQ")
MAGIC = b"MSKURL01"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    tail = rest[len(host) :]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return host.translate(_LOWER), tail[: min(ends, default=len(tail))]


def _digest(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


def _write(batches, folder: str):
    rules: dict[str, tuple[int, str]] = {}
    for b in batches:
        for host, path, verdict in zip(*(b[c].to_pylist() for c in ("host", "path", "verdict")), strict=True):
            # of rules that are equal but for the verdict, block wins
            old = rules.get(host + path)
            rules[host + path] = _digest(host + path), max(verdict, old[1] if old else "")
    if not rules:
        return
    order = sorted(rules, key=lambda r: (rules[r][0], r))
    texts = [f"{rules[r][1]} {r}".encode() for r in order]
    path, lengths = f"{folder}/{uuid.uuid4().hex}.urls", sorted({len(r) - r.find("/") if "/" in r else 0 for r in order})
    with create(path) as out:
        out.write(_HEAD.pack(MAGIC, len(order), sum(map(len, texts))))
        out.write(np.array([rules[r][0] for r in order], "<u8").tobytes())
        out.write(np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes())
        out.write(b"".join(texts))
    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lengths], pa.list_(pa.int32()))], ["path", "lengths"])


def build(rules: DataFrame) -> DataFrame:
    """Write the rules ``(host, path, verdict)`` as shards; returns the manifest, a row for each shard.

    Hosts are lower-cased; a null path is the empty one; rules without a host or with another verdict than
    allow and block are errors of the list and are dropped. Of equal rules with both verdicts, block holds.
    """
    spark = rules.sparkSession
    folder = scratch(spark, "url-rules")
    clean = rules.select(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    clean = clean.filter("host != '' and verdict in ('allow', 'block')").distinct()
    shards = clean.count() // SHARD_RULES + 1
    # dealt by the whole rule, so equal rules meet; the task sorts its shard
    dealt = clean.repartition(shards, F.concat("host", "path"))
    return written(dealt.mapInArrow(lambda it: _write(it, folder), "path string, lengths array<int>"), "url-manifest")


class RuleShard:
    def __init__(self, path: str):
        local = local_path(path)
        if local is None:  # a remote store: one copy for this worker, mapped like a mounted file
            fd, local = tempfile.mkstemp(suffix=".urls")
            with os.fdopen(fd, "wb") as f:
                f.write(open_file(path).read())
        magic, n, size = _HEAD.unpack(open(local, "rb").read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a rule shard")
        self.keys = np.memmap(local, "<u8", "r", _HEAD.size, (n,))
        self._at = np.memmap(local, "<u8", "r", _HEAD.size + 8 * n, (n + 1,))
        self._texts = np.memmap(local, np.uint8, "r", _HEAD.size + 8 * n + 8 * (n + 1), (size,))

    def find(self, digests: np.ndarray, asked: list[str]) -> list[str | None]:
        """The verdict of each rule that is here; equal digests of other rules are told apart by their strings."""
        out: list[str | None] = [None] * len(asked)
        first = np.searchsorted(self.keys, digests)
        hits = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == digests)
        for i in hits:
            at = int(first[i])
            while at < len(self.keys) and self.keys[at] == digests[i]:
                verdict, _, rule = bytes(self._texts[int(self._at[at]) : int(self._at[at + 1])]).decode().partition(" ")
                if rule == asked[i]:
                    out[i] = verdict
                    break
                at += 1
        return out


@lru_cache(maxsize=64)
def _shard(path: str) -> RuleShard:
    return RuleShard(path)


def judge(urls: list[str | None], shards: list[str], lengths: list[int], default: str = DEFAULT) -> list[tuple[str, str, str | None, str]]:
    """``(host, path, rule, verdict)`` of each url: the longest rule that fits, of equally long ones that with the longer host."""
    parsed = [host_and_path(u) for u in urls]
    asked, owner = [], []
    for i, (host, path) in enumerate(parsed):
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for n in lengths:
                if suffix and n <= len(path):
                    asked.append((len(suffix) + n, len(suffix), suffix + path[:n]))
                    owner.append(i)
    best: list = [(0, 0, None, default)] * len(urls)
    if asked:
        names = [a[2] for a in asked]
        digests = np.fromiter(map(_digest, names), np.uint64, len(names))
        for path in shards:
            for (size, host_size, name), i, verdict in zip(asked, owner, _shard(path).find(digests, names), strict=True):
                if verdict and (size, host_size) > best[i][:2]:
                    best[i] = (size, host_size, name, verdict)
    return [(h, p, rule, verdict) for (h, p), (_, _, rule, verdict) in zip(parsed, best, strict=True)]


def filter_urls(pages: DataFrame, manifest: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row, without a shuffle.

    A null url, or one without ``://``, has an empty host and path and gets the default. Repeated rows give
    repeated results, an empty table none; without rules all get the default. Other columns are not read.
    """
    shards = [(r["path"], r["lengths"]) for r in manifest.select("path", "lengths").collect()]  # a row for each SHARD_RULES rules
    paths, lengths = [p for p, _ in shards], sorted({n for _, x in shards for n in x})

    def run(batches):
        for b in batches:
            host, path, rule, verdict = zip(*judge(b["url"].to_pylist(), paths, lengths, default), strict=True) if b.num_rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([b["page_id"], *(pa.array(x, pa.string()) for x in (host, path, rule, verdict))], ["page_id", "host", "path", "rule", "verdict"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return base.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), build(rules))


SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, parts.host, parts.path, rule, coalesce(v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON fits.page_id = parts.page_id AND fits.host = parts.host AND fits.path = parts.path AND place = 1
"""
