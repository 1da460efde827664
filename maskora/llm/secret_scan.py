"""Secrets in whole texts, told apart by who owns the candidates across the corpus.

Three base patterns give spans. Beyond them, long mixed tokens are candidates: each candidate's hash is summed
over the corpus by distinct repositories (here the document) and distinct owners (its source). A candidate that
one owner alone has, in few repositories, looks live and becomes a span; one that several owners have, or one owner
in many repositories, is a copied example and does not. The same sums label the base spans. Hashes, never the
secrets, are shuffled, and the sums are made in steps, by owner and repository, by owner, and then by hash, so a
widely copied example is no hot row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("assign", "access", "hex", "live")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A candidate of its own: at least 24 characters with a digit and a letter, or with a capital after a small letter
#: (so that a long word with a capital at its start is none).
_MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}")
_LETTER, _DIGIT, _CASES = re.compile("[A-Za-z]"), re.compile("[0-9]"), re.compile("[a-z][A-Z]")
SHORTEST_ASSIGNED = 6
#: At most so many distinct owners, and repositories, for a candidate that looks live. An owner's own key may stand
#: in a few places; on sf0.1 none of 131 candidates is in more than 3 repositories.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 8


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, secret)`` of the base patterns, in order; positions are code points."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_ASSIGNED]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def mixed_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates that no base span overlaps; both lists are in order of start, so one sweep meets them."""
    out, at, reached = [], 0, 0
    for m in _MIXED.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reached = max(reached, taken[at][2])
            at += 1
        if reached <= m.start() and (_DIGIT.search(m[0]) and _LETTER.search(m[0]) or _CASES.search(m[0])):
            out.append((m.start(), 3, m.end(), m[0]))
    return out


def span_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.int64())]))
_DDL = "doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<start:int,kind:int,end:int,hash:long>>"


def _hash(secret: str) -> int:
    return int.from_bytes(hashlib.blake2b(secret.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    for b in batches:
        counts, digests, spans = [], [], []
        for text in b["text"].to_pylist():
            base = base_spans(text or "")
            counts.append([sum(k == kind for _, k, _, _ in base) for kind in range(3)])
            digests.append(hashlib.sha256(span_text(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e, "hash": _hash(x)} for s, k, e, x in base + mixed_spans(text or "", base)])
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["owner"], *columns, pa.array(digests, pa.string()), pa.array(spans, _SPANS)], ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _as_text(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sums(each: DataFrame) -> DataFrame:
    """``(hash, repositories, owners)`` of ``(hash, owner, doc_id)``; each step adds up within tasks first."""
    pairs = each.groupBy("hash", "owner", "doc_id").count().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return pairs.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied)``, one row for each input row.

    ``n_live`` and ``n_copied`` count the row's candidates, base ones included, by what the corpus says of them.
    Null and empty texts have no spans; a very long text is scanned whole, as one list of spans. A null owner is an owner of its own. Rows are independent of their order;
    repeated rows give repeated results and count as one repository. An empty table gives an empty result.
    Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    found = written(base.mapInArrow(_scan, _DDL).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    each = found.select("row", "doc_id", "owner", F.explode("spans").alias("span")).select("row", "doc_id", "owner", F.col("span.hash").alias("hash"), "span")
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories)
    verdicts = each.join(_sums(each), "hash").select("row", "span", live.alias("live"))
    by_row = verdicts.groupBy("row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.collect_list(F.when(F.col("live") | (F.col("span.kind") < 3), F.col("span"))).alias("kept"),
    )
    return found.join(by_row, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(_as_text(F.array_sort("kept")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def candidate_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``(hash, repositories, owners)`` of every candidate in the corpus."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    return _sums(base.mapInArrow(_scan, _DDL).select("doc_id", "owner", F.explode("spans.hash").alias("hash")))


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in words)


def _matches_sql(kind: int, pattern: str, secret: int, keep: str) -> str:
    """Places of a pattern's matches: the text between the matches and the matches before, added up."""
    return f"""SELECT r, {kind} AS kind, CAST(begins AS bigint) AS s, CAST(begins AS bigint) + length(m) AS e, secret FROM (SELECT r, m, secret,
 sum(length(gap)) OVER in_text + coalesce(sum(length(m)) OVER (in_text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM (SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(secrets) AS secret, unnest(gaps[:len(ms)]) AS gap
 FROM (SELECT r, regexp_extract_all(text, $p${pattern}$p$) AS ms, regexp_extract_all(text, $p${pattern}$p$, {secret}) AS secrets, string_split_regex(text, $p${pattern}$p$) AS gaps FROM d)) WINDOW in_text AS (PARTITION BY r ORDER BY i)) WHERE {keep}"""


_ASSIGN_SQL = f"""({_either_case('password|passwd|secret|token|api_?key')})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner FROM documents),
b AS MATERIALIZED ({_matches_sql(0, _ASSIGN_SQL, 2, f"length(secret) >= {SHORTEST_ASSIGNED}")} UNION ALL {_matches_sql(1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20")} UNION ALL {_matches_sql(2, "[0-9a-f]+", 0, "length(m) >= 24")}),
o AS ({_matches_sql(3, "[A-Za-z0-9+/_-]+", 0, "length(m) >= 24 AND (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') OR regexp_matches(m, '[a-z][A-Z]'))")}),
x AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = o.r AND b.s < o.e AND b.e > o.s)),
v AS (SELECT secret, count(DISTINCT owner) <= {LIVE_OWNERS} AND count(DISTINCT concat(coalesce(CAST(doc_id AS varchar), ''), ':', owner)) <= {LIVE_REPOSITORIES} AS live FROM x JOIN d USING (r) GROUP BY secret),
y AS (SELECT r, kind, s, concat({list(KINDS)}[kind + 1], ':', s, ':', e) AS shown, live FROM x JOIN v USING (secret)),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(shown, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
 string_agg(shown, ',' ORDER BY s, kind) FILTER (kind < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (r)
"""
