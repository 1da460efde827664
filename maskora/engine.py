"""The engine's front door: lines in, spans, boxes and redacted text out, all as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators import boxes as B
from maskora.operators import layout as L
from maskora.operators import names as N
from maskora.operators import propagate as P
from maskora.operators import redact as R
from maskora.operators import symbols as Y
from maskora.operators.spans import detect_pii, pii_spans
from maskora.sources.scratch import by_text, materialised


@dataclass(frozen=True)
class Options:
    persons: bool = True
    companies: bool = True
    pii: bool = True
    propagate: bool = True
    keywords: tuple[str, ...] = ()
    padding: float = 2.0
    surnames: tuple[str, ...] = field(default=N.SURNAMES, repr=False)


SPAN_COLUMNS = ["doc_id", "line_no", "start", "end", "type", "label", "text"]


def detect(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """``(doc_id, line_no, start, end, type, label, text)`` of ``lines(doc_id, line_no, line)``; detectors that are off are not planned."""
    parts = []
    persons = N.detect_persons(lines, options.surnames) if options.persons else None
    companies = N.detect_companies(lines) if options.companies else None

    def spans(df: DataFrame, kind: str, label) -> None:
        parts.append(df.select("doc_id", "line_no", "start", "end", F.lit(kind).alias("type"), label.alias("label"), "text"))

    if persons is not None:
        spans(persons, "person", F.lit("人名"))
    if companies is not None:
        spans(companies, "company", F.lit("会社名"))
    if options.pii or options.persons:
        found = detect_pii(lines)
        if not (options.persons and options.pii):
            found = found.filter((F.col("category") == "person") == F.lit(options.persons))
        parts.append(found.select("doc_id", "line_no", "start", "end", F.when(F.col("category") == "person", "person").otherwise("pii").alias("type"), "label", "text"))
    if options.keywords:
        hits = P.keyword_hits(lines, list(options.keywords))
        spans(hits.withColumnRenamed("keyword", "text"), "custom", F.lit("カスタム単語"))
    if options.propagate and persons is not None and companies is not None:
        again = P.propagate(lines, P.confirmed_names(persons, companies))
        parts.append(again.select("doc_id", "line_no", "start", "end", F.col("kind").alias("type"), F.when(F.col("kind") == "person", "人名 (文書内一致)").otherwise("会社名 (文書内一致)").alias("label"), "text"))
    if not parts:
        return lines.sparkSession.createDataFrame([], "doc_id long, line_no int, start int, end int, type string, label string, text string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def page_lines(lines: DataFrame) -> DataFrame:
    """Recognised lines ``(doc_id, line_no, text, x0, y0, x1, y1, words, symbols, confidence)`` as the detectors want them.

    Characters get boxes of their own, pieces of one line are joined, and white space inside Japanese text goes.
    """
    return Y.cleaned_lines(B.merge_fragments(Y.aligned_lines(lines, clean=False)))


def page_spans(lines: DataFrame, options: Options = Options(), avatars: DataFrame | None = None) -> DataFrame:
    """``(doc_id, line_no, stage, start, end, type, label, text, reason, layout)`` of all that hides something on a page.

    Stage 0 is what a line shows by itself, with keywords and sender headers (beside ``avatars(doc_id, x, y, w, h)`` or
    above a message), stage 1 values that stand apart from their labels, with address lines that carry on, stage 2 the
    names that any of these confirmed, found again in all lines. What these need twice is written once, so that
    nothing is detected twice; calling this runs those jobs.
    """
    plain = lines.select("doc_id", "line_no", F.col("text").alias("line"))
    shown = by_text(plain, "line", lambda texts: _row_spans(texts, options).select("line", "spans"), "text-spans").filter(F.size("spans") > 0)
    found = plain.join(shown, "line").select("doc_id", "line_no", F.explode("spans").alias("s")).select("doc_id", "line_no", "s.*")
    parts = [found.withColumn("layout", F.lit(False))]

    def add(df: DataFrame, start, end, kind, label, text, reason, layout=False) -> None:
        parts.append(df.select("doc_id", "line_no", start.alias("start"), end.alias("end"), kind.alias("type"), label.alias("label"), text.alias("text"), reason.alias("reason"), F.lit(layout).alias("layout")))

    if options.persons:
        heads = sender_spans(lines, options, avatars)
        add(heads, F.col("start"), F.col("end"), F.lit("person"), F.lit("送信者名"), F.col("text"), F.lit(R.PERSON_REASONS["chat_sender_header"]))
    if options.keywords:
        hits = P.keyword_hits(plain, list(options.keywords))
        add(hits, F.col("start"), F.col("end"), F.lit("custom"), F.lit("カスタム単語"), F.col("keyword"), F.format_string('指定キーワード: "%s"', "keyword"))
    if options.pii or options.persons:
        values = materialised(L.label_values(lines), "label-values")
        more = L.address_continuations(lines, values).select("doc_id", "value_line", F.lit("address").alias("category"), F.lit("住所").alias("label"), "value")
        layout = values.select("doc_id", "value_line", "category", "label", "value").unionByName(more).withColumnRenamed("value_line", "line_no").join(plain, ["doc_id", "line_no"])
        person = F.col("category") == "person"
        layout = layout.filter((person if options.persons else F.lit(False)) | (~person if options.pii else F.lit(False)))
        at = F.position(F.col("value"), F.col("line")) - 1
        add(layout, at, at + F.length("value"), F.when(person, "person").otherwise("pii"), F.col("label"), F.col("value"), F.format_string("項目ラベルと値の配置 (%s)", "label"), True)
    out = reduce(DataFrame.unionByName, parts).select("doc_id", "line_no", F.col("layout").cast("int").alias("stage"), *SPAN_COLUMNS[2:], "reason", "layout").distinct()
    if not options.propagate:
        return out
    out = materialised(out, "page-spans")
    names = P.confirmed_names(out.filter("type = 'person'").select("doc_id", "text"), out.filter("type = 'company'").select("doc_id", "text"))
    again = P.propagate(plain, names)
    person = F.col("kind") == "person"
    label = F.when(person, "人名 (文書内一致)").otherwise("会社名 (文書内一致)")
    reason = F.concat(F.when(person, "同定済み人物名の全域保護 (").otherwise("同定済み組織名の全域保護 ("), "entity", F.lit(")"))
    again = again.select("doc_id", "line_no", F.lit(2).alias("stage"), "start", "end", F.col("kind").alias("type"), label.alias("label"), "text", reason.alias("reason"), F.lit(False).alias("layout"))
    return out.unionByName(again)


def sender_spans(lines: DataFrame, options: Options = Options(), avatars: DataFrame | None = None) -> DataFrame:
    """``(doc_id, line_no, start, end, text)`` of lines that name who sent the message below them."""
    name = T.trim_end(F.regexp_replace("text", L.SENDER_TAIL, ""))

    def senders(texts: DataFrame) -> DataFrame:
        named = N.with_persons(texts.withColumn("line", T.trim_all(name)), options.surnames)
        is_person = F.exists("persons", lambda s: (s["start"] == 0) & (s["end"] == F.length("line")))
        return named.select("text", F.length(name).alias("end"), "line", N.is_chat_sender(F.col("text"), is_person, F.lit(True)).alias("is_sender"))

    named = by_text(lines if avatars is not None else lines.filter(L.is_timed(F.col("text"))), "text", senders, "sender-texts").filter("is_sender")
    heads = L.sender_headers(lines, avatars).select("doc_id", "line_no", "text").join(named, "text")
    return heads.select("doc_id", "line_no", F.lit(0).alias("start"), "end", F.col("line").alias("text"))


#: A box's place in a page: its stage, then the line, the start in it, and the kind.
_RANKS = {"person": 0, "company": 1, "pii": 2, "custom": 3}


def boxes(lines: DataFrame, options: Options = Options(), width: float = 1e9, height: float = 1e9, avatars: DataFrame | None = None, angles: DataFrame | None = None, photo: bool = False) -> DataFrame:
    """Boxes for recognised lines ``(doc_id, line_no, text, x0, y0, x1, y1, confidence)``, deduplicated and merged by page.

    Where the lines have ``aligned``, ``symbols`` or ``words`` (see :func:`page_lines`), ranges get their boxes from these.
    ``angles(doc_id, angle)`` are pages that stand askew: from 0.8 degrees on their boxes are turned. ``photo`` widens the
    margins for screens taken by a camera. See :func:`page_spans` for what is detected and when it runs.
    """
    own = [c for c in ("aligned", "symbols", "words") if c in lines.columns]
    rows = page_spans(lines, options, avatars).join(lines.select("doc_id", "line_no", F.col("text").alias("line"), "x0", "y0", "x1", "y1", "confidence", *own), ["doc_id", "line_no"])
    raw = Y.span_box(F.col("start"), F.col("end"), F.col("line"), {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}, **{c: F.col(c) for c in own})
    rows = rows.withColumn("r", raw).filter("r is not null")
    rows = rows.withColumn("r", L.padded(*(F.col(f"r.{k}") for k in "xywh"), options.padding, F.lit(width), F.lit(height), photo))
    key = F.xxhash64("line_no", "start", "end", "type", "label")
    rank = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), list(_RANKS.items())[1:], F.when(F.col("type") == "person", 0)).otherwise(4)
    seq = F.shiftleft(F.col("stage").cast("long"), 60).bitwiseOR(F.shiftleft(F.col("line_no").cast("long"), 30)).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 3)).bitwiseOR(rank.cast("long"))
    confidence = F.col("confidence") / 100
    confidence = F.when(F.col("layout"), F.greatest(F.lit(0.0), F.least(F.lit(0.98), confidence))).otherwise(confidence)
    turned = F.lit(0.0)
    if angles is not None:
        rows = rows.join(angles.select("doc_id", "angle"), "doc_id", "left")
        turned = F.when(F.abs("angle") >= 0.8, F.col("angle").cast("double")).otherwise(0.0)
    rows = rows.select("doc_id", F.concat_ws("-", "type", key.cast("string")).alias("box_id"), seq.alias("seq"), "type", "label", "text", "r.*", turned.alias("rotation"), F.lit(True).alias("enabled"), F.lit(False).alias("is_manual"), confidence.alias("confidence"), "reason")
    return B.merge_adjacent(B.dedupe_boxes(rows))


def redact(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, redacted_text)`` of recognised lines with boxes."""
    return R.redacted_text(lines, found)


_SPANS = "array<struct<start:int,end:int,type:string,label:string,text:string,reason:string>>"


def _row_spans(lines: DataFrame, options: Options) -> DataFrame:
    """``lines`` with ``persons``, ``companies`` and ``spans``, all that a line shows by itself; no shuffle."""

    def of(column: str, kind: str, label: str, reason):
        return F.transform(column, lambda s: F.struct(s["start"], s["end"], F.lit(kind), F.lit(label), s["text"], reason(s))).cast(_SPANS)

    empty = F.array().cast(_SPANS)
    rows, parts = lines, [empty]
    if options.persons:
        rows = N.with_persons(rows, options.surnames)
        parts.append(of("persons", "person", "人名", lambda s: R.person_reason(s["reason"])))
    if options.companies:
        rows = N.with_companies(rows)
        parts.append(of("companies", "company", "会社名・組織", lambda s: F.lit("法人格または企業名パターン")))
    if options.pii or options.persons:
        found = pii_spans(F.coalesce("line", F.lit("")))
        if not (options.persons and options.pii):
            found = F.filter(found, lambda s: (s["category"] == "person") == options.persons)
        parts.append(F.transform(found, lambda s: F.struct(s["start"], s["end"], F.when(s["category"] == "person", "person").otherwise("pii"), s["label"], s["text"], F.concat(F.lit("特定個人情報 ("), s["label"], F.lit(")")))).cast(_SPANS))
    return rows.withColumn("spans", F.concat(*parts))


def redact_plain(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """``(doc_id, line_no, line, redacted)`` of plain lines, by their spans.

    The spans of a line are found on its row. Only what comes from elsewhere, names that the document confirms and
    keywords, is joined by ``(doc_id, line_no)``, and only where there is any. With propagation the lines are written
    once with what was found on them, so that nothing is detected twice: calling this runs two jobs, the returned
    table reads what they wrote.
    """
    rows, more = _row_spans(lines, options), []
    if options.keywords:
        hits = P.keyword_hits(lines, list(options.keywords))
        more.append(hits.select("doc_id", "line_no", "start", "end", F.lit("custom").alias("type"), F.lit("カスタム単語").alias("label"), F.col("keyword").alias("text"), F.lit("").alias("reason")))
    if options.propagate and options.persons and options.companies:
        rows = materialised(rows, "line-spans")
        names = P.confirmed_names(rows.select("doc_id", F.explode("persons.text").alias("text")), rows.select("doc_id", F.explode("companies.text").alias("text")))
        again = P.propagate(rows.select("doc_id", "line_no", "line"), names)
        label = F.when(F.col("kind") == "person", "人名 (文書内一致)").otherwise("会社名 (文書内一致)")
        more.append(materialised(again.select("doc_id", "line_no", "start", "end", F.col("kind").alias("type"), label.alias("label"), "text", F.lit("").alias("reason")), "propagated"))
    if more:
        joined = reduce(DataFrame.unionByName, more).groupBy("doc_id", "line_no").agg(F.collect_list(F.struct("start", "end", "type", "label", "text", "reason")).cast(_SPANS).alias("more"))
        rows = rows.join(joined, ["doc_id", "line_no"], "left").withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast(_SPANS))))
    return rows.select("doc_id", "line_no", "line", R.redact_spans(F.col("line"), F.col("spans")).alias("redacted"))


__all__ = ["Options", "boxes", "detect", "page_lines", "page_spans", "redact", "redact_plain", "sender_spans"]
