"""Redacted text: boxes cover characters, runs of covered characters become one placeholder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.bands import banded, share_band

# Placeholders by what a label holds, in order; then by type.
PLACEHOLDERS = [("メール", "[メールアドレス]"), ("電話", "[電話番号]"), ("住所", "[住所]"), ("人名", "[人名]"), ("会社", "[会社名]"), ("パスワード", "[パスワード]"), ("カード", "[カード情報]"), ("金額", "[金額]")]
SECRET = "[非公開]"
# Instructions before an exported text, and the lines around it.
WRAPPERS = {
    "reply": "以下のチャット履歴を踏まえて、丁寧でプロフェッショナルな返信メール／チャットの返信案を作成してください：",
    "action": "以下のチャット内容から、担当者ごとのToDo（タスク）と期日・連絡先事項を漏れなく抽出してください：",
    "risk": "以下のチャット内容から、契約・納期・合意事項に関する潜在的なリスクや注意点を洗い出してください：",
    "summary": "以下のチャット履歴の要点・決定事項・連絡先情報を分かりやすく整理してください：",
}
TEXT_BEGINS = "--- チャット内容（個人情報・機密情報は伏字処理済み） ---"
TEXT_ENDS = "-------------------------------------------------------"


# Why a person was found; short labels by what a label holds, in order, and then by type.
PERSON_REASONS = {"surname_match": "主要名字辞書との一致", "honorific_match": "敬称・役職付き人名パターン", "full_name_pattern": "フルネーム（姓名）パターン", "chat_sender_header": "チャット送信者名の推定"}
OTHER_PERSON_REASON = "人名パターンの検知"
COMPACT = [("メール", "メール"), ("パスワード", "PW"), ("カード", "カード"), ("Card", "カード"), ("電話", "TEL"), ("住所", "住所"), ("会社", "会社名"), ("人名", "人名"), ("金額", "金額")]
COMPACT_TYPES = {"person": "人名", "company": "会社名", "face": "顔写真", "avatar": "アイコン", "pii": "個人情報", "manual": "手動", "custom": "指定語"}


def person_reason(code: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in PERSON_REASONS.items():
        out = out.when(code == k, v)
    return out.otherwise(OTHER_PERSON_REASON)


def compact_label(kind: Column, label: Column) -> Column:
    """The short label that is drawn on a box."""
    clean = T.trim_all(F.coalesce(label, F.lit("")))
    by_label = F.when(clean == "PW", "PW")
    for word, short in COMPACT:
        by_label = by_label.when(F.contains(clean, F.lit(word)), short)
    by_type = F.when(F.lit(False), "")
    for k, short in COMPACT_TYPES.items():
        by_type = by_type.when(kind == k, short)
    return F.when((clean != "") & ~clean.isin("手動指定", "手動"), by_label.otherwise(clean)).otherwise(by_type.otherwise(F.coalesce(label, F.lit(""))))


def placeholder(kind: Column, label: Column, text: Column) -> Column:
    trimmed = T.trim_all(F.coalesce(label, F.lit("")))
    by_label = F.when(trimmed == "PW", "[パスワード]")
    for word, mark in PLACEHOLDERS:
        by_label = by_label.when(F.contains(trimmed, F.lit(word)), mark)
    by_label = by_label.otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    by_type = (
        F.when(kind == "person", "[人名]").when(kind == "company", "[会社名]")
        .when(kind == "pii", F.when(trimmed != "", F.concat(F.lit("["), label, F.lit("]"))).otherwise(SECRET))
        .when(kind == "custom", F.concat(F.lit("[伏字: "), F.when(text != "", text).otherwise("非公開"), F.lit("]"))).otherwise(SECRET)
    )
    return F.when((trimmed != "") & ~trimmed.isin("手動指定", "手動"), by_label).otherwise(by_type)


def character_cover(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, line_no, pos, box_id, type, mark)`` of each covered character; of several boxes the latest counts.

    A box covers a character that its text names, or of which it holds the middle or 35 % of the width. Characters
    have equal shares of the line unless ``aligned`` gives one box for each.
    """
    c = F.col
    on = boxes.filter(c("enabled") & ~c("type").isin("face", "avatar")).withColumn("mark", placeholder(c("type"), c("label"), F.coalesce("text", F.lit("")))).withColumnRenamed("text", "box_text")
    rows = banded(lines.filter(F.length(T.trim_all(c("text"))) > 0), c("y0") - 4, c("y1") + 4).alias("l")
    near = share_band("l", "b") & (c("b.y") + c("b.h") >= c("l.y0") - 4) & (c("b.y") <= c("l.y1") + 4)
    pairs = rows.join(banded(on, c("y"), c("y") + c("h")).alias("b"), near).select("l.*", "b.box_id", "b.seq", "b.type", "b.mark", "b.box_text", "b.x", "b.y", "b.w", "b.h")
    n = F.length("text")
    share = F.greatest(F.lit(1.0), c("x1") - c("x0")) / n
    word = T.trim_all(F.coalesce("box_text", F.lit("")))

    has_own = "aligned" in lines.columns

    def covered(i: Column) -> Column:
        x0, x1, y0, y1 = F.floor(c("x0") + i * share + 0.5), F.floor(c("x0") + (i + 1) * share + 0.5), c("y0"), c("y1")
        if has_own:
            own = F.size("aligned") == n
            at = F.try_element_at("aligned", i + 1)["bbox"]
            x0, x1, y0, y1 = (F.when(own, at[k]).otherwise(v) for k, v in (("x0", x0), ("x1", x1), ("y0", y0), ("y1", y1)))
        right, bottom = c("x") + c("w"), c("y") + c("h")
        wide = ((x0 + x1) / 2).between(c("x"), right) | (F.greatest(F.lit(0.0), F.least(right, x1) - F.greatest(c("x"), x0)) / F.greatest(F.lit(1.0), x1 - x0) >= 0.35)
        high = ((y0 + y1) / 2).between(c("y"), bottom) | ((bottom >= y0) & (c("y") <= y1))
        return wide & high

    # occurrences of the box's text, left to right without overlap
    parts = F.when(F.length(F.regexp_replace(word, f"[{T.WS}]", "")) >= 2, F.split(c("text"), F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1))
    starts = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["pos"] + F.length(p) + F.length(word)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + F.length(p))).alias("out")), lambda acc: acc["out"],
    )
    spots = lambda s: F.sequence(s, s + F.length(word) - 1)
    pairs = pairs.withColumn("named", F.coalesce(F.flatten(F.transform(starts, spots)), F.array().cast("array<int>")))
    # a character under the box ends right of its left side and begins left of its right side; two more on each side for rounding
    first, last = (c("x") - c("x0")) / share - 3, (c("x") + c("w") - c("x0")) / share + 3
    anywhere = (F.size("named") > 0) | first.isNull() | last.isNull() | F.isnan(first) | F.isnan(last)
    if has_own:
        anywhere = anywhere | F.coalesce(F.size("aligned") == n, F.lit(False))
    low = F.when(anywhere, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(first, n.cast("double"))))).cast("int")
    high = F.when(anywhere, n - 1).otherwise(F.floor(F.least(n - 1.0, F.greatest(last, F.lit(-1.0))))).cast("int")
    ranges = pairs.withColumns({"low": low, "high": high}).filter("low <= high")
    # a row for each character: a condition on rows is compiled, one in a lambda is not
    chars = ranges.select("*", F.explode(F.sequence("low", "high")).alias("pos")).filter(covered(c("pos")) | F.array_contains("named", c("pos")))
    chars = chars.select("doc_id", "line_no", "pos", F.struct("seq", "box_id", "type", "mark").alias("box"))
    return chars.groupBy("doc_id", "line_no", "pos").agg(F.max("box").alias("box")).select("doc_id", "line_no", "pos", "box.box_id", "box.type", "box.mark")


def redacted_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, line_no, redacted, boxes)``: the rewritten line and the distinct ``struct(box_id, type)`` that start a run."""
    c = F.col
    cover = character_cover(lines, boxes).groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("pos", "box_id", "type", "mark"))).alias("cover"))
    rows = lines.filter(F.length(T.trim_all(c("text"))) > 0).join(cover, ["doc_id", "line_no"], "left")
    state = "struct<out:string,pos:int,box:string,mark:string,starts:array<struct<box_id:string,type:string>>>"
    none = F.lit(None).cast("string")
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"), none.alias("box"), none.alias("mark"), F.array().cast("array<struct<box_id:string,type:string>>").alias("starts")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        # covered characters only; what lies before one is copied at once, and ends the run
        apart = F.struct(F.concat(acc["out"], F.substring(c("text"), acc["pos"] + 1, x["pos"] - acc["pos"])).alias("out"), x["pos"].alias("pos"), none.alias("box"), none.alias("mark"), acc["starts"].alias("starts")).cast(state)
        return T.bound(F.when(x["pos"] > acc["pos"], apart).otherwise(acc), lambda before: covered(before, x))

    def covered(acc: Column, x: Column) -> Column:
        goes_on = acc["box"].isNotNull() & ((x["box_id"].cast("string") == acc["box"]) | (x["mark"] == acc["mark"]))
        spaced = F.when((acc["out"] != "") & ~acc["out"].rlike(r"[ 　:：]\z"), F.concat(acc["out"], F.lit(" "))).otherwise(acc["out"])
        out = F.when(F.endswith(T.trim_end(acc["out"]), x["mark"]), acc["out"]).otherwise(F.concat(spaced, x["mark"]))
        head = F.struct(x["box_id"].cast("string").alias("box_id"), x["type"].alias("type"))
        same = F.struct(acc["out"].alias("out"), (x["pos"] + 1).alias("pos"), acc["box"].alias("box"), acc["mark"].alias("mark"), acc["starts"].alias("starts")).cast(state)
        new = F.struct(out.alias("out"), (x["pos"] + 1).alias("pos"), x["box_id"].cast("string").alias("box"), x["mark"].alias("mark"), F.array_union(acc["starts"], F.array(head)).alias("starts")).cast(state)
        return F.when(goes_on, same).otherwise(new)

    def ended(acc: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(c("text"), acc["pos"] + 1, F.length("text"))).alias("out"), acc["starts"].alias("starts"))

    done = F.when(c("cover").isNull(), F.struct(c("text").alias("out"), empty["starts"].alias("starts"))).otherwise(F.aggregate("cover", empty, step, ended))
    out = rows.select("doc_id", "line_no", done.alias("done"))
    return out.select("doc_id", "line_no", T.clean_export(c("done.out")).alias("redacted"), c("done.starts").alias("boxes"))


def redacted_text(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, redacted_text)``: the document's non-empty lines in order."""
    # empty lines are left out while they are gathered: a filter would go below the rewriting, and do it once more
    rows = redacted_lines(lines, boxes).select("doc_id", F.when(F.col("redacted") != "", F.struct("line_no", "redacted")).alias("line"))
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("lines")).filter(F.size("lines") > 0)
    return texts.select("doc_id", F.array_join(F.transform("lines", lambda r: r["redacted"]), "\n").alias("redacted_text"))


def redaction_stats(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(doc_id, person, company, pii, custom)``: boxes that start a run, once for each line."""
    heads = redacted_lines(lines, boxes).select("doc_id", F.explode_outer("boxes").alias("box")).filter("box IS NOT NULL")  # an inner explode would ask for the array's size first
    return heads.groupBy("doc_id").agg(*(F.count_if(F.col("box.type") == k).alias(k) for k in ("person", "company", "pii", "custom")))


def with_instruction(texts: DataFrame, template: str = "summary") -> DataFrame:
    """Texts inside an instruction for an assistant; ``none`` leaves them bare."""
    if template == "none":
        return texts
    head = WRAPPERS.get(template, WRAPPERS["summary"])
    return texts.withColumn("redacted_text", F.concat(F.lit(f"{head}\n\n{TEXT_BEGINS}\n"), "redacted_text", F.lit(f"\n{TEXT_ENDS}")))


def redact_spans(line: Column, spans: Column) -> Column:
    """A line with the text under its spans (``start, end, type, label, text``) replaced by placeholders.

    Spans may overlap, chain or repeat: what lies under any of them is hidden. Spans that overlap are one gap in the
    text, with the placeholder of the one that starts first (of those, the longest). A placeholder is not written where
    the output already ends with its like, white space aside; text between placeholders, white space too, is kept.
    Linear in the spans.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("order"), placeholder(s["type"], s["label"], F.coalesce(s["text"], F.lit(""))).alias("mark"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["order"]
        until = F.concat(acc["out"], F.substring(line, acc["pos"] + 1, s["start"] - acc["pos"]))
        again = F.endswith(T.trim_end(until), s["mark"])
        apart = F.struct(F.when(again, until).otherwise(F.concat(until, s["mark"])).alias("out"), end.alias("pos"))
        under = F.struct(acc["out"].alias("out"), F.greatest(acc["pos"], end).alias("pos"))
        return F.when(s["start"] >= acc["pos"], apart).otherwise(under)

    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    return F.aggregate(ordered, empty, step, lambda acc: F.concat(acc["out"], F.substring(line, acc["pos"] + 1, F.length(line))))
