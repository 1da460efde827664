"""Registered queries of the redaction engine and the SQL that DuckDB runs for them on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskora import engine
from maskora.functions import text as T
from maskora.operators import boxes as B
from maskora.operators import layout as L
from maskora.operators import names as N
from maskora.operators import pixels as X
from maskora.operators import propagate as P
from maskora.operators import redact as R
from maskora.operators import selection as C
from maskora.operators import spans as S
from maskora.plans import expected as W
from maskora.plans import recognised, streams
from maskora.sources import pages
from maskora.sources.scratch import materialised
from maskora.sources.tables import JP_LINE, doc_lines, jp_lines, split_lines, table
from maskora.streaming import edits as E

#: Recognised lines, from line items: labels, values and messages in two columns of a page for each order.
OCR_TEXT = """CASE l_partkey % 10 WHEN 0 THEN '氏名:' WHEN 1 THEN '山田太郎' WHEN 2 THEN 'TEL' WHEN 3 THEN concat('090-1234-', lpad(CAST(l_partkey % 10000 AS string), 4, '0'))
WHEN 4 THEN '住所' WHEN 5 THEN concat('東京都港区芝', CAST(l_partkey % 9 + 1 AS string), '-2') WHEN 6 THEN 'alice 10:24' WHEN 7 THEN 'hello there world' WHEN 8 THEN 'Email' ELSE concat('u', CAST(l_suppkey AS string), '@example.com') END"""
OCR_SQL = f"""SELECT l_orderkey AS doc_id, l_linenumber AS line_no, txt AS text, 10e0 + 110 * (l_linenumber % 2) AS x0, 24e0 * floor((l_linenumber + 1) / 2) + l_partkey % 5 AS y0,
10e0 + 110 * (l_linenumber % 2) + 10 * length(txt) AS x1, 24e0 * floor((l_linenumber + 1) / 2) + l_partkey % 5 + 18 AS y1, CAST(l_suppkey % 100 AS double) AS confidence
FROM (SELECT *, {OCR_TEXT} AS txt FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS one) AS named"""
BOX_SQL = """SELECT l_orderkey AS doc_id, l_linenumber AS seq, concat('b', CAST(l_linenumber AS string)) AS box_id, CASE l_partkey % 5 WHEN 0 THEN 'person' WHEN 1 THEN 'company' WHEN 2 THEN 'pii' WHEN 3 THEN 'face' ELSE 'custom' END AS type,
CASE l_partkey % 3 WHEN 0 THEN '人名' WHEN 1 THEN '電話番号' ELSE '' END AS label, '' AS text, 10e0 + 100 * (l_linenumber % 3) AS x, 24e0 * floor((l_linenumber + 1) / 2) AS y, CAST(l_quantity AS double) * 2 + 5 AS w, 18e0 AS h,
0e0 AS rotation, l_partkey % 7 != 0 AS enabled, false AS is_manual FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) AS one"""


def _sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query.replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}"), **{n: table(spark, sf_dir, n) for n in ("lineitem", "orders") if f"FROM {n}" in query})


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, OCR_SQL)


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, BOX_SQL).withColumn("confidence", F.lit(0.9))


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits from the event table: users are pages, event types are operations."""
    ops = {"signup": "add", "click": "update", "view": "toggle", "purchase": "undo", "error": "remove"}
    e = table(spark, sf_dir, "events")
    op = F.element_at(F.create_map(*(F.lit(x) for kv in ops.items() for x in kv)), F.col("event_type"))
    target = F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))
    side = F.coalesce(F.col("value"), F.lit(0.0))
    payload = F.to_json(F.struct(F.when(op == "add", F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))).otherwise(target).alias("id"), F.array(F.lit(0.0), F.lit(0.0), side, side).alias("rect"), F.struct(F.col("event_type").alias("label")).alias("patch")))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", op.alias("op"), payload.alias("payload"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses and card numbers of documents, redacted; characters, spans and rewritten characters by language."""
    docs = table(spark, sf_dir, "documents")
    rules = [r for r in S.FREE if r.category in ("email", "credit_card")]
    lines = docs.select("lang", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("norm", F.coalesce(T.half_width_line(F.col("line")), F.lit("")))
    lines = lines.withColumn("spans", S.pii_spans(F.col("line"), rules, F.col("norm")))
    typed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("pii").alias("type"), s["label"].alias("label"), s["text"].alias("text")))
    lines = lines.withColumn("redacted", F.when(F.size("spans") > 0, R.redact_spans(F.col("line"), typed)).otherwise(F.col("line")))
    return lines.groupBy("lang").agg(F.sum(F.length("line")).alias("chars"), F.sum(F.size("spans")).alias("spans"), F.sum(F.length("redacted")).alias("redacted_chars"))


# --- DuckDB forms -------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A rule's pattern for RE2: boundaries that Java needs spelled out are word boundaries there."""
    out = pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("(?iu)", "(?i)")
    return out.replace(r"\p{IsHan}", r"\p{Han}").replace(r"\p{IsHiragana}", r"\p{Hiragana}").replace(r"\p{IsKatakana}", r"\p{Katakana}")


_HALF = f"translate(line, {_q(T.WIDE)}, {_q(T.NARROW)})"
DOC_LINES = "SELECT doc_id, CAST(i AS integer) AS line_no, parts[i + 1] AS line FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b"
JP_LINES = f"SELECT c_custkey AS doc_id, 0 AS line_no, {JP_LINE} AS line FROM customer"
_DIGITS = f"regexp_replace(translate(SOURCE, {_q(T.ZERO_ONE_LIKE)}, {_q(T.ZERO_ONE_AS)}), '[^0-9]', '', 'g')"


def _spans_sql(lines: str, rules: list[tuple[str, int, str, str]], where: str = "true", seq: bool = False) -> str:
    """Spans of rules (pattern, group, category, condition on ``text``), each scanned by itself."""
    parts = []
    for pattern, group, category, condition in rules:
        p = _q(_re2(pattern))
        parts.append(f"""SELECT doc_id, line_no, CAST(place AS integer) AS start, CAST(place + length(value) AS integer) AS "end", '{category}' AS category, substr(line, CAST(place AS bigint) + 1, length(value)) AS text FROM (
SELECT doc_id, line_no, line, vs[i] AS value, ms[i] AS whole, coalesce(list_sum(list_transform(gs[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0) + strpos(ms[i], vs[i]) - 1 AS place
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(norm, {p}, 0) AS ms, regexp_extract_all(norm, {p}, {group}) AS vs, regexp_split_to_array(norm, {p}) AS gs FROM (SELECT *, {_HALF} AS norm FROM ({lines}) l) n) m) x) y WHERE {condition}""")
    return " UNION ALL ".join(parts)


_LUHN = f"(SELECT length(d) = 16 AND d != repeat(d[1], 16) AND list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(d[i] AS integer) * 2 > 9 THEN CAST(d[i] AS integer) * 2 - 9 ELSE CAST(d[i] AS integer) * 2 END ELSE CAST(d[i] AS integer) END)) % 10 = 0 FROM (SELECT {_DIGITS.replace('SOURCE', 'whole')} AS d))"
_MY = "(SELECT length(d) = 12 AND CASE WHEN list_sum(list_transform(range(1, 12), lambda i: CAST(d[i] AS integer) * [6,5,4,3,2,7,6,5,4,3,2][i])) % 11 <= 1 THEN 0 ELSE 11 - list_sum(list_transform(range(1, 12), lambda i: CAST(d[i] AS integer) * [6,5,4,3,2,7,6,5,4,3,2][i])) % 11 END = CAST(d[12] AS integer) FROM (SELECT DIGITS AS d))"


def _one_rule(category: str, label: str | None = None, n: int = 0) -> list[S.Rule]:
    return [[r for r in S.FREE if r.category == category][n]]


def _rule_query(lines, *rules):
    def query(spark, sf_dir):
        out = None
        for r in rules:
            part = S.detect_pii(lines(spark, sf_dir), [r]).select("doc_id", "line_no", "start", "end", "category", "text")
            out = part if out is None else out.unionByName(part)
        return out

    return query


def _registered() -> dict[str, tuple[Callable, str | None]]:
    free = {}
    for r in S.FREE:
        free.setdefault(r.category, r)
    phone_ok = f"length({_DIGITS.replace('SOURCE', 'whole')}) BETWEEN 9 AND 11"
    email, phone, card, money, postal, secret, sns = (free[k] for k in ("email", "phone", "credit_card", "money", "postal", "secret", "sns_id"))
    bank = [r for r in S.LABELLED if r.category in ("bank_account", "birth_date")]
    q: dict[str, tuple[Callable, str | None]] = {}
    q["pii_email_spans"] = _rule_query(doc_lines, email), _spans_sql(DOC_LINES, [(email.pattern, 0, "email", "true")])
    q["pii_phone_spans"] = _rule_query(doc_lines, phone), _spans_sql(DOC_LINES, [(phone.pattern, 0, "phone", phone_ok)])
    q["pii_card_luhn"] = _rule_query(doc_lines, card), _spans_sql(DOC_LINES, [(card.pattern, 0, "credit_card", f"NOT regexp_matches(whole, '^[0-9]') OR {_LUHN}")])
    q["pii_money_postal_secret"] = _rule_query(jp_lines, money, postal, secret, sns), _spans_sql(JP_LINES, [(r.pattern, r.group, r.category, "true") for r in (money, postal, secret, sns)])
    q["labeled_bank_birth"] = _rule_query(jp_lines, *bank), _spans_sql(JP_LINES, [(r.pattern, 1, r.category, "true") for r in bank]).replace("vs[i] AS value", f"rtrim(regexp_replace(vs[i], '(?i)\\s+({T.VALUE_LABELS})\\s*[:：].*', '')) AS value")
    number = "concat('', 1234, lpad(CAST(c_custkey * 7919 % 100000000 AS string), 8, '0'))"
    q["mynumber_check"] = (
        lambda s, d: table(s, d, "customer").select("c_custkey", T.is_my_number(F.expr(number)).alias("valid")),
        f"SELECT c_custkey, {_MY.replace('DIGITS', number)} AS valid FROM customer",
    )
    q["width_fold"] = (lambda s, d: jp_lines(s, d).select("doc_id", T.half_width(F.col("line")).alias("folded")), f"SELECT doc_id, {_HALF} AS folded FROM ({JP_LINES})")
    q["visual_fold"] = (lambda s, d: jp_lines(s, d).select("doc_id", T.fold_lookalikes(F.col("line")).alias("folded"), T.fold_digits(F.col("line")).alias("digits")), f"SELECT doc_id, translate(line, {_q(T.LOOKALIKE)}, {_q(T.LOOKALIKE_AS)}) AS folded, translate(line, {_q(T.DIGIT_LIKE)}, {_q(T.DIGIT_LIKE_AS)}) AS digits FROM ({JP_LINES})")
    blocks, ws = T.CJK_BLOCKS, T.WS
    clean = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, {_q(f'([{blocks}])[{ws}]+([{blocks}])')}, '\\1\\2', 'g'), {_q(f'[{ws}]*([:：])[{ws}]*')}, '\\1 ', 'g'), {_q('[ 	　]{2,}')}, ' ', 'g'), {_q(f'^[{ws}]+|[{ws}]+$')}, '', 'g')"
    q["export_clean"] = (
        lambda s, d: jp_lines(s, d).select("doc_id", T.clean_export(F.col("line")).alias("clean")),
        f"SELECT doc_id, {clean} AS clean FROM ({JP_LINES})",
    )
    half = f"translate(line, {_q(T.WIDE)}, {_q(T.NARROW)})"
    cjk = _re2(T.CJK)
    drop = f"regexp_replace(X, {_q(f'([{cjk}])[{T.SPACE}]+([{cjk}])')}, '\\1\\2', 'g')"
    twice = drop.replace("X", drop.replace("X", half))
    q["normalized_text"] = (lambda s, d: jp_lines(s, d).select("doc_id", T.normalize_recognised(F.col("line")).alias("norm"), T.search_fold(F.col("line")).alias("search")), f"SELECT doc_id, regexp_replace(regexp_replace({twice}, {_q(f'[{T.SPACE}]+')}, ' ', 'g'), '^ ', '') AS norm, lower(translate(regexp_replace({twice}, {_q(f'[{ws}]')}, '', 'g'), {_q(T.DASHES)}, '-----')) AS search FROM ({JP_LINES})")
    names = ", ".join(f"({_q(n)})" for n in N.SURNAMES)
    q["surname_prefix"] = (
        lambda s, d: jp_lines(s, d).select("doc_id", F.regexp_extract("line", r"([\p{IsHan}々]{2,})", 1).alias("name")).withColumn("surname", N.surname_of(F.col("name"))),
        f"SELECT doc_id, name, (SELECT s FROM (VALUES {names}) t(s) WHERE starts_with(name, s) OR (length(s) > 1 AND starts_with(translate(name, {_q(T.LOOKALIKE)}, {_q(T.LOOKALIKE_AS)}), translate(s, {_q(T.LOOKALIKE)}, {_q(T.LOOKALIKE_AS)}))) ORDER BY length(s) DESC LIMIT 1) AS surname FROM (SELECT doc_id, regexp_extract(line, '([\\p{{Han}}々]{{2,}})', 1) AS name FROM ({JP_LINES}))",
    )
    q["pii_all_spans"] = (lambda s, d: S.detect_pii(jp_lines(s, d)), W.PII_SQL)
    q["person_spans"] = (lambda s, d: N.detect_persons(jp_lines(s, d)), W.PERSON_SQL)
    q["company_spans"] = (lambda s, d: N.detect_companies(jp_lines(s, d)), W.COMPANY_SQL)
    q["keyword_hits"] = (
        lambda s, d: P.keyword_hits(doc_lines(s, d), ["apache license", "password"]),
        f"SELECT doc_id, line_no, keyword, CAST(place AS integer) AS start, CAST(place + length(keyword) AS integer) AS \"end\" FROM (SELECT doc_id, line_no, keyword, coalesce(list_sum(list_transform(gs[1:i], lambda z: length(z))), 0) + (i - 1) * length(keyword) AS place FROM (SELECT *, unnest(range(1, len(gs))) AS i FROM (SELECT *, string_split(lower(line), keyword) AS gs FROM ({DOC_LINES}) l CROSS JOIN (VALUES ('apache license'), ('password')) k(keyword)) m) x) y",
    )
    q["entity_propagation"] = (lambda s, d: _propagated(s, d), W.PROPAGATED_SQL)
    q["redacted_jp"] = (lambda s, d: engine.redact_plain(jp_lines(s, d)), W.REDACTED_SQL)
    q["chat_sender_context"] = (
        lambda s, d: L.sender_headers(ocr_lines(s, d)).select("doc_id", "line_no", "text"),
        f"WITH o AS ({OCR_SQL}) SELECT doc_id, line_no, text FROM o a WHERE regexp_matches(text, '\\s[0-9]{{1,2}}:[0-9]{{2}}$') AND EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.line_no != a.line_no AND length(trim(b.text)) >= 3 AND b.y0 >= a.y1 - (a.y1 - a.y0) * 0.1 AND b.y0 - a.y1 <= (a.y1 - a.y0) * 2.5 AND abs(b.x0 - a.x0) <= (a.y1 - a.y0) * 2)",
    )
    q["layout_label_value"] = (lambda s, d: L.label_values(ocr_lines(s, d)), _LABEL_SQL)
    q["layout_address_continuation"] = (lambda s, d: L.address_continuations(ocr_lines(s, d), L.label_values(ocr_lines(s, d))), _CONTINUED_SQL)
    q["bbox_for_range"] = (
        lambda s, d: ocr_lines(s, d).select("doc_id", "line_no", L.range_box(F.lit(0), F.lit(2), F.length("text"), *map(F.col, ("x0", "y0", "x1", "y1"))).alias("b")).select("doc_id", "line_no", "b.*"),
        f"SELECT doc_id, line_no, floor(x0 + 0.5) AS x, y0 AS y, greatest(10e0, floor((x1 - x0) * (2e0 / length(text)) + 0.5)) AS w, y1 - y0 AS h FROM ({OCR_SQL})",
    )
    q["pad_clamp"] = (
        lambda s, d: page_boxes(s, d).select("doc_id", "seq", L.padded(*map(F.col, "xywh"), 2.0, F.lit(200.0), F.lit(100.0)).alias("p")).select("doc_id", "seq", "p.*"),
        f"SELECT doc_id, seq, greatest(0e0, x - 3) AS x, greatest(0e0, y - 1) AS y, least(200e0, x + w + 3) - greatest(0e0, x - 3) AS w, least(100e0, y + h + 1) - greatest(0e0, y - 1) AS h FROM ({BOX_SQL})",
    )
    q["scale_geometry"] = (lambda s, d: L.scaled_lines(ocr_lines(s, d), F.lit(1.7)).select("doc_id", "line_no", "x0", "y0", "x1", "y1"), f"SELECT doc_id, line_no, floor(x0 / 1.7e0 + 0.5) AS x0, floor(y0 / 1.7e0 + 0.5) AS y0, floor(x1 / 1.7e0 + 0.5) AS x1, floor(y1 / 1.7e0 + 0.5) AS y1 FROM ({OCR_SQL})")
    q["ocr_quality"] = (
        lambda s, d: L.recognition_status(L.recognition_quality(ocr_lines(s, d))).select("doc_id", "chars", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("score", 6).alias("score"), "status"),
        f"SELECT doc_id, chars, round(a, 6) AS avg_confidence, round(chars * greatest(1e0, a), 6) AS score, CASE WHEN a < 35 THEN 'low_confidence' ELSE 'ok' END AS status FROM (SELECT doc_id, CAST(sum(n) AS bigint) AS chars, sum(confidence * greatest(1, n)) / sum(n) AS a FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM ({OCR_SQL})) GROUP BY doc_id)",
    )
    q["ocr_choose"] = (lambda s, d: L.better_result(L.recognition_quality(ocr_lines(s, d)), L.recognition_quality(ocr_lines(s, d).withColumn("confidence", F.pmod(F.col("confidence") * 7, F.lit(100))))), W.choice_sql(OCR_SQL))
    q["median_line_height"] = (lambda s, d: L.typical_line_height(ocr_lines(s, d)), f"SELECT doc_id, list_sort(list(y1 - y0))[CAST(floor(count(*) / 2) AS bigint) + 1] + 4 AS line_height FROM ({OCR_SQL}) WHERE y1 - y0 > 4 GROUP BY doc_id")
    q["text_columns_topk"] = (
        lambda s, d: L.text_columns(ocr_lines(s, d), 820.0).select("doc_id", "place", "edge", "n"),
        f"SELECT doc_id, CAST(place AS integer) AS place, CAST(edge AS bigint) AS edge, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_line) AS place FROM (SELECT doc_id, floor(x0 / 12.3e0 + 0.5) AS edge, count(*) AS n, min(line_no) AS first_line FROM ({OCR_SQL}) GROUP BY 1, 2)) WHERE place <= 4",
    )
    q["marquee_select"] = (lambda s, d: L.marquee(page_boxes(s, d), 100.0, 30.0, 60.0, 40.0).select("doc_id", "box_id"), f"SELECT doc_id, box_id FROM ({BOX_SQL}) WHERE x < 160 AND x + w > 100 AND y < 70 AND y + h > 30")
    points = "SELECT l_orderkey AS doc_id, 1 AS point_id, 115e0 AS px, 30e0 AS py FROM lineitem GROUP BY l_orderkey"
    q["point_hit"] = (lambda s, d: L.box_at(page_boxes(s, d), _sql(s, d, points)), f"SELECT doc_id, 1 AS point_id, arg_max(box_id, seq) AS box_id FROM ({BOX_SQL}) WHERE 115 BETWEEN x AND x + w AND 30 BETWEEN y AND y + h GROUP BY doc_id")
    q["line_snap"] = (lambda s, d: L.snap_drags(_sql(s, d, "SELECT l_orderkey AS doc_id, 1 AS drag_id, 12e0 AS sx, 30e0 AS sy, 80e0 AS cx, 34e0 AS cy FROM lineitem GROUP BY l_orderkey"), ocr_lines(s, d)), W.snap_sql(OCR_SQL))
    q["stroke_merge"] = (lambda s, d: L.absorb_strokes(page_boxes(s, d), _sql(s, d, "SELECT l_orderkey AS doc_id, 90e0 AS x, 25e0 AS y, 20e0 AS w, 18e0 AS h FROM lineitem GROUP BY l_orderkey"), 1.6), W.strokes_sql(BOX_SQL))
    q["box_counts"] = (
        lambda s, d: L.box_counts(page_boxes(s, d)),
        f"SELECT doc_id, count(*) FILTER (type IN ('face', 'avatar')) AS faces, count(*) FILTER (type = 'person') AS persons, count(*) FILTER (type = 'company') AS companies, count(*) FILTER (type = 'pii') AS pii, count(*) AS total FROM ({BOX_SQL}) WHERE enabled GROUP BY doc_id",
    )
    q["selection_bounds"] = (
        lambda s, d: L.selection_bounds(page_boxes(s, d)).select("doc_id", "x0", "y0", "x1", "y1", F.array_join("labels", "|").alias("labels")),
        f"SELECT doc_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, array_to_string(list_sort(list(DISTINCT label)), '|') AS labels FROM ({BOX_SQL}) GROUP BY doc_id",
    )
    q["dedupe_boxes"] = (lambda s, d: B.dedupe_boxes(page_boxes(s, d)), None)
    q["merge_adjacent"] = (lambda s, d: B.merge_adjacent(page_boxes(s, d)), None)
    q["merge_fragments"] = (lambda s, d: B.merge_fragments(ocr_lines(s, d)), None)
    q["char_coverage"] = (lambda s, d: R.character_cover(ocr_lines(s, d), page_boxes(s, d)).select("doc_id", "line_no", "pos", "box_id", "mark"), _COVER_SQL)
    q["redacted_text"] = (lambda s, d: R.redacted_text(ocr_lines(s, d), page_boxes(s, d)), W.text_sql(OCR_SQL, _COVER_SQL, BOX_SQL, clean))
    q["redaction_stats"] = (lambda s, d: R.redaction_stats(ocr_lines(s, d), page_boxes(s, d)), W.stats_sql(_COVER_SQL, BOX_SQL))
    q["edit_replay"] = (lambda s, d: E.replay(edit_events(s, d)), None)
    q["stall_sessions"] = (lambda s, d: E.stalled_jobs(table(s, d, "events").select(F.col("user_id").cast("string").alias("job_id"), "ts", (F.pmod(F.col("event_id") * 7, F.lit(101)) / 100).alias("progress"))).select("job_id", "stalled", "over_cap"), _STALL_SQL)
    q["work_scale"] = (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(L.work_scale(F.lit(400.0) + F.col("p_size") * 50, F.lit(300.0) + F.col("p_size") * 40, F.col("p_size") + 4.0, F.lit(False)), 9).alias("scale")),
        "SELECT p_partkey, round(least(greatest(0.55e0, least(3.2e0, 36e0 / (p_size + 4e0))), 2200e0 / greatest(400e0 + p_size * 50, 300e0 + p_size * 40), sqrt(3000000e0 / ((400e0 + p_size * 50) * (300e0 + p_size * 40)))), 9) AS scale FROM part",
    )
    q["lang_cache_stats"] = (
        lambda s, d: pages.cache_stats(table(s, d, "nation").select(F.concat(F.lit("m/"), F.element_at(F.array(*map(F.lit, ("jpn", "eng", "deu", "x"))), F.col("n_nationkey") % 4 + 1), F.when(F.col("n_nationkey") % 4 == 3, ".bin").otherwise(".traineddata")).alias("key"), F.col("n_name").cast("binary").alias("value"))).withColumn("languages", F.array_join("languages", ",")),
        "SELECT count(*) AS items, CAST(sum(strlen(n_name)) AS bigint) AS total_bytes, 'deu,eng,jpn' AS languages, true AS is_cached FROM nation WHERE n_nationkey % 4 != 3",
    )
    q["bulk_toggle"] = (
        lambda s, d: C.toggle_protection(page_boxes(s, d), F.col("x") < 200).select("doc_id", "seq", "enabled"),
        f"SELECT doc_id, seq, CASE WHEN x < 200 THEN NOT bool_or(x < 200 AND enabled) OVER (PARTITION BY doc_id) ELSE enabled END AS enabled FROM ({BOX_SQL})",
    )
    q["bulk_relabel"] = (
        lambda s, d: C.relabel(page_boxes(s, d), F.col("x") < 200, "電話番号").select("doc_id", "seq", "label", "reason"),
        f"SELECT doc_id, seq, CASE WHEN change THEN '電話番号' ELSE label END AS label, CASE WHEN change THEN 'ユーザー指定 (電話番号)' END AS reason FROM (SELECT *, x < 200 AND label != '電話番号' AND (SELECT count(DISTINCT label) FROM ({BOX_SQL}) i WHERE i.doc_id = o.doc_id AND i.x < 200) = 1 AS change FROM ({BOX_SQL}) o)",
    )
    q["more_with_label"] = (
        lambda s, d: C.more_with_label(page_boxes(s, d), F.col("x") < 200),
        f"WITH b AS ({BOX_SQL}), one AS (SELECT doc_id, min(label) AS label FROM b WHERE x < 200 GROUP BY doc_id HAVING count(DISTINCT label) = 1) SELECT one.doc_id, one.label, count(b.seq) AS more FROM one LEFT JOIN b ON b.doc_id = one.doc_id AND b.label = one.label AND b.x >= 200 GROUP BY 1, 2",
    )
    q["step_thickness"] = (
        lambda s, d: C.step_thickness(page_boxes(s, d), F.col("x") < 200, 1, F.lit(90.0)).select("doc_id", "seq", "y", "h"),
        f"SELECT doc_id, seq, CASE WHEN x < 200 THEN greatest(0e0, least(90e0 - 20, y - 1)) ELSE y END AS y, CASE WHEN x < 200 THEN 20e0 ELSE h END AS h FROM ({BOX_SQL})",
    )
    q["step_down"] = (
        lambda s, d: C.step_down(page_boxes(s, d), F.col("x") < 200, 1, F.lit(90.0)).select("doc_id", "seq", "y", "h"),
        f"SELECT doc_id, seq, CASE WHEN x < 200 AND y != 72 THEN least(72e0, y + 2) ELSE y END AS y, h FROM ({BOX_SQL})",
    )
    q["preview_pages"] = (lambda s, d: C.previews(ocr_lines(s, d), page_boxes(s, d)), f"SELECT DISTINCT doc_id FROM ({BOX_SQL}) WHERE enabled")
    q["document_quads"] = (
        lambda s, d: table(s, d, "part").select("p_partkey", F.expr(QUAD).alias("quad")).select("p_partkey", C.is_document_quad(F.col("quad"), F.lit(400.0), F.lit(300.0)).alias("valid"), C.needs_warp(F.col("quad"), F.lit(400.0), F.lit(300.0), F.col("p_partkey") % 2 == 0).alias("warp")),
        _QUAD_SQL,
    )
    for name, kernel in (("gaussian", X.gaussian), ("clahe", X.clahe), ("bradley", X.bradley)):
        q[name] = (lambda s, d, k=kernel: X.each_plane(_planes(s, d), k).select("doc_id", "width", "height", F.md5("pixels").alias("digest"))), None
    q["deskew"] = (lambda s, d: X.skew_angles(_planes(s, d)), None)
    return q | recognised.registered(ocr_lines, page_boxes, OCR_SQL, BOX_SQL) | streams.registered(lambda s, d: table(s, d, "events"))


#: Corners of a page in a photograph of 400 x 300, for each part.
QUAD = """named_struct('tl', named_struct('x', CAST(p_partkey % 97 AS double), 'y', CAST(p_partkey % 41 AS double)), 'tr', named_struct('x', 400e0 - p_partkey % 89, 'y', CAST(p_partkey % 53 AS double)),
'br', named_struct('x', 400e0 - p_partkey % 13 * 20, 'y', 300e0 - p_partkey % 7 * 30), 'bl', named_struct('x', CAST(p_partkey % 11 AS double), 'y', 300e0 - p_partkey % 5 * 40))"""
_QUAD_SQL = """
WITH c AS (SELECT p_partkey, CAST(p_partkey % 97 AS double) AS ax, CAST(p_partkey % 41 AS double) AS ay, 400e0 - p_partkey % 89 AS bx, CAST(p_partkey % 53 AS double) AS "by", 400e0 - p_partkey % 13 * 20 AS cx, 300e0 - p_partkey % 7 * 30 AS cy, CAST(p_partkey % 11 AS double) AS dx, 300e0 - p_partkey % 5 * 40 AS dy FROM part),
s AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - "by") ** 2) AS t, sqrt((bx - cx) ** 2 + ("by" - cy) ** 2) AS r, sqrt((cx - dx) ** 2 + (cy - dy) ** 2) AS b, sqrt((dx - ax) ** 2 + (dy - ay) ** 2) AS l,
 abs(ax * "by" - bx * ay + bx * cy - cx * "by" + cx * dy - dx * cy + dx * ay - ax * dy) / 2 AS area FROM c),
v AS (SELECT *, area BETWEEN 14400 AND 119400 AND least(t, r, b, l) >= 24 AND greatest(t, b) / greatest(1, l, r) BETWEEN 0.22 AND 4.5
 AND list_min([((dx - ax) * (bx - ax) + (dy - ay) * ("by" - ay)) / (l * t), ((ax - bx) * (cx - bx) + (ay - "by") * (cy - "by")) / (t * r), ((bx - cx) * (dx - cx) + ("by" - cy) * (dy - cy)) / (r * b), ((cx - dx) * (ax - dx) + (cy - dy) * (ay - dy)) / (b * l)]) >= cos(radians(128))
 AND list_max([((dx - ax) * (bx - ax) + (dy - ay) * ("by" - ay)) / (l * t), ((ax - bx) * (cx - bx) + (ay - "by") * (cy - "by")) / (t * r), ((bx - cx) * (dx - cx) + ("by" - cy) * (dy - cy)) / (r * b), ((cx - dx) * (ax - dx) + (cy - dy) * (ay - dy)) / (b * l)]) <= cos(radians(52)) AS valid FROM s)
SELECT p_partkey, valid, valid AND (abs(t - b) / greatest(t, b, 1) > 0.02 OR abs(l - r) / greatest(l, r, 1) > 0.02 OR abs(ay - "by") > 3 OR abs(ax - dx) > 4 OR abs(dy - cy) > 3
 OR (p_partkey % 2 != 0 AND (least(ax, dx) > 14 OR least(ay, "by") > 10.5 OR 400 - greatest(bx, cx) > 14 OR 300 - greatest(dy, cy) > 10.5))) AS warp FROM v
"""

_STALL_SQL = """
WITH p AS (SELECT CAST(user_id AS varchar) AS job_id, CAST(ts AS timestamp) AS ts, event_id * 7 % 101 / 100 AS progress FROM events),
b AS (SELECT *, max(progress) OVER (PARTITION BY job_id ORDER BY ts, progress ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p WHERE progress BETWEEN 0 AND 1),
m AS (SELECT job_id, max(gap) AS gap, max(ts) AS moved FROM (SELECT job_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY job_id ORDER BY ts, progress)) AS gap FROM b WHERE best IS NULL OR progress > best) GROUP BY job_id),
e AS (SELECT job_id, min(ts) AS start, max(ts) AS stop FROM p GROUP BY job_id)
SELECT e.job_id, greatest(coalesce(gap, 0), epoch_us(stop) - epoch_us(coalesce(moved, start))) >= 45000000 AS stalled, epoch_us(stop) - epoch_us(start) >= 60000000 AS over_cap FROM e LEFT JOIN m ON m.job_id = e.job_id
"""

#: A placeholder (9 characters for an address, 7 for a card) is not repeated where only white space lies between two of a kind.
_FLAGSHIP_SQL = f"""
WITH l AS ({DOC_LINES}), s AS ({_spans_sql(DOC_LINES, [(r.pattern, r.group, r.category, "true" if r.category == "email" else f"NOT regexp_matches(whole, '^[0-9]') OR {_LUHN}") for r in S.FREE if r.category in ("email", "credit_card")])}),
g AS (SELECT s.*, coalesce(category = lag(category) OVER before AND regexp_matches(substr(line, lag("end") OVER before + 1, start - lag("end") OVER before), {_q(f'^[{T.WS}]*$')}), false) AS again FROM s JOIN l USING (doc_id, line_no) WINDOW before AS (PARTITION BY doc_id, line_no ORDER BY start)),
c AS (SELECT doc_id, count(*) AS spans, sum(CASE WHEN again THEN 0 WHEN category = 'email' THEN 9 ELSE 7 END - length(text)) AS change FROM g GROUP BY doc_id)
SELECT lang, CAST(sum(chars) AS bigint) AS chars, CAST(sum(coalesce(spans, 0)) AS bigint) AS spans, CAST(sum(chars + coalesce(change, 0)) AS bigint) AS redacted_chars
FROM (SELECT doc_id, sum(length(line)) AS chars FROM l GROUP BY doc_id) t JOIN documents USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY lang
"""

_LABEL_SQL = f"""
WITH o AS ({OCR_SQL}), k AS (SELECT *, CASE WHEN text = '氏名:' THEN 'person' WHEN text = 'TEL' THEN 'phone' WHEN text = '住所' THEN 'address' WHEN text = 'Email' THEN 'email' END AS category,
 CASE WHEN text = '氏名:' THEN '人名' WHEN text = 'TEL' THEN '電話番号' WHEN text = '住所' THEN '住所' WHEN text = 'Email' THEN 'メールアドレス' END AS label FROM o),
p AS (SELECT *, h * 30 AS far, CASE WHEN same THEN greatest(0e0, bx0 - ax1) ELSE greatest(0e0, by0 - ay1) + abs(bx0 - ax0) * 0.25 END AS distance FROM (
 SELECT a.doc_id, a.line_no AS label_line, b.line_no AS value_line, a.category, a.label, b.text, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.y1 AS by1, greatest(8e0, a.y1 - a.y0) AS h,
 greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.55 AND b.x0 >= a.x1 - greatest(8e0, a.y1 - a.y0) * 0.25 AND b.x0 - a.x1 <= greatest(greatest(8e0, a.y1 - a.y0) * 30, (a.x1 - a.x0) * 12) AS same,
 b.y0 - a.y1 BETWEEN greatest(8e0, a.y1 - a.y0) * -0.15 AND greatest(8e0, a.y1 - a.y0) * 2.2 AND abs(b.x0 - a.x0) <= greatest(64e0, a.x1 - a.x0) AS below
 FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.category IS NOT NULL AND b.category IS NULL) z WHERE same OR below),
v AS (SELECT * FROM p WHERE CASE category WHEN 'phone' THEN length(regexp_replace(text, '[^0-9]', '', 'g')) BETWEEN 9 AND 11 WHEN 'email' THEN contains(text, '@') WHEN 'address' THEN contains(text, '東京都') OR (regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]')) ELSE text = '山田太郎' OR text = 'hello there world' END),
f AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.doc_id = v.doc_id AND c.category IS NOT NULL AND c.line_no != v.label_line AND CASE WHEN v.same
 THEN greatest(0e0, least(v.ay1, c.y1) - greatest(v.ay0, c.y0)) / least(v.ay1 - v.ay0, c.y1 - c.y0) >= 0.55 AND c.x0 > v.ax1 AND c.x0 < v.bx0 ELSE c.y0 > v.ay1 AND c.y0 < v.by0 AND abs(c.x0 - v.ax0) <= v.h * 2 END))
SELECT doc_id, label_line, value_line, category, label, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label_line ORDER BY same DESC, distance, by0, bx0, value_line) AS place FROM f) WHERE place = 1
"""


def _next_line_sql(step: str) -> str:
    """The first label or address-like line that follows each address of ``step``; a label ends the address."""
    return f"""SELECT * FROM (SELECT s.doc_id, s.label_line, s.first_line, s.vx0, s.h, b.line_no, b.text, b.y0 AS after, b.y1 AS stop, b.is_label, row_number() OVER (PARTITION BY s.doc_id, s.label_line ORDER BY b.y0, b.x0, b.line_no) AS place
 FROM {step} s JOIN c b ON b.doc_id = s.doc_id AND b.line_no NOT IN (s.label_line, s.first_line) AND b.y0 - s.stop BETWEEN s.h * -0.1 AND s.h * 1.25 AND abs(b.x0 - s.vx0) <= s.h * 1.5 AND (s.after IS NULL OR b.y0 >= s.after)) z WHERE place = 1 AND NOT is_label"""


_CONTINUED_SQL = f"""
WITH o AS ({OCR_SQL}), v AS ({_LABEL_SQL}),
c AS (SELECT * FROM (SELECT *, text IN ('氏名:', 'TEL', '住所', 'Email') AS is_label FROM o) k WHERE is_label OR contains(text, '東京都') OR (regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]'))),
f AS (SELECT v.doc_id, label_line, value_line AS first_line, a.x0 AS vx0, greatest(8e0, l.y1 - l.y0) AS h, CAST(NULL AS double) AS after, a.y1 AS stop FROM v JOIN o a ON a.doc_id = v.doc_id AND a.line_no = value_line JOIN o l ON l.doc_id = v.doc_id AND l.line_no = label_line WHERE category = 'address'),
one AS ({_next_line_sql('f')}), two AS ({_next_line_sql('one')})
SELECT doc_id, label_line, line_no AS value_line, text AS value FROM one UNION SELECT doc_id, label_line, line_no, text FROM two
"""


_COVER_SQL = f"""
WITH l AS ({OCR_SQL}), b AS (SELECT *, CASE WHEN label != '' THEN concat('[', label, ']') WHEN type = 'person' THEN '[人名]' WHEN type = 'company' THEN '[会社名]' WHEN type = 'custom' THEN '[伏字: 非公開]' ELSE '[非公開]' END AS mark FROM ({BOX_SQL}) WHERE enabled AND type != 'face'),
c AS (SELECT *, floor(x0 + pos * (greatest(1e0, x1 - x0) / length(text)) + 0.5) AS c0, floor(x0 + (pos + 1) * (greatest(1e0, x1 - x0) / length(text)) + 0.5) AS c1 FROM (SELECT *, unnest(range(length(text))) AS pos FROM l))
SELECT c.doc_id, c.line_no, CAST(c.pos AS integer) AS pos, arg_max(b.box_id, b.seq) AS box_id, arg_max(b.mark, b.seq) AS mark FROM c JOIN b ON c.doc_id = b.doc_id AND b.y + b.h >= c.y0 - 4 AND b.y <= c.y1 + 4
WHERE ((c.c0 + c.c1) / 2 BETWEEN b.x AND b.x + b.w OR greatest(0e0, least(b.x + b.w, c.c1) - greatest(b.x, c.c0)) / greatest(1e0, c.c1 - c.c0) >= 0.35) AND ((c.y0 + c.y1) / 2 BETWEEN b.y AND b.y + b.h OR (b.y + b.h >= c.y0 AND b.y <= c.y1))
GROUP BY 1, 2, 3
"""


def _propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = jp_lines(spark, sf_dir).withColumn("line_no", F.col("doc_id").cast("int")).withColumn("doc_id", F.floor(F.col("doc_id") / 14))
    rows = materialised(N.with_companies(N.with_persons(lines)), "named-lines")
    names = P.confirmed_names(rows.select("doc_id", F.explode("persons.text").alias("text")), rows.select("doc_id", F.explode("companies.text").alias("text")))
    return P.propagate(rows.select("doc_id", "line_no", "line"), names)


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray planes of 24 x 16 pixels whose bytes follow from the row's key."""
    byte = lambda i: F.lpad(F.hex(F.pmod((i + 1) * (F.col("n_nationkey") + 3) * 37, F.lit(256))), 2, "0")
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24 * 16 - 1)), byte), ""))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(24).alias("width"), F.lit(16).alias("height"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"flagship": flagship} | {name: run for name, (run, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {"flagship": _FLAGSHIP_SQL} | {name: sql for name, (_, sql) in _registered().items() if sql}
