"""Detectors as data: a table of patterns, scanned left to right, whose spans are merged in order.

A line's spans are an array of ``struct(start, end, category, label, text)``; everything stays in Catalyst
and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskora.functions import text as T

SPAN = "struct<start:int,end:int,category:string,label:string,text:string>"


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All non-overlapping matches: ``array<struct<at, start, whole, value>>``, with the match's and the group's start."""
    pattern = F.lit(pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    kind = "array<struct<at:int,start:int,whole:string,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        start = at + (F.position(x["value"], x["whole"]) - 1 if group else F.lit(0))
        found = F.struct(at.alias("at"), start.alias("start"), x["whole"].alias("whole"), x["value"].alias("value"))
        return F.struct((at + F.length(x["whole"])).alias("pos"), F.concat(acc["out"], F.array(found)).cast(kind).alias("out"))

    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    found = F.aggregate(parts, empty, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(kind))


@dataclass(frozen=True)
class Rule:
    """One detector. ``on`` says which form of the line it scans; ``accept`` sees the line's columns and a match.

    ``hint`` is what the scanned line holds wherever the pattern matches, and costs little to look for.
    """

    pattern: str
    category: str
    label: str
    group: int = 0
    on: str = "norm"
    accept: Callable[[Column, Column], Column] | None = None
    labelled: bool = False
    trimmed: bool = False
    hint: Callable[[Column], Column] | None = None


_W = T.WS
_DASH = r"\-ー−–‐"
_NOT_WORD = r"(?![A-Za-z0-9_])"
_SEP = rf"[{_W}]*[:：{_W}][{_W}]*"

# Labels, and the shapes of the values after them.
_PRECEDES_NO_PERSON = rf"(?iu)(?:ファイル|フォルダ|プロジェクト|商品|会社|企業|サービス|製品|表示|File|Folder|Project|Product|Company|Display)[{_W}]*\z"
LABELLED = [
    Rule(rf"(?iu)(?:Email|E-?mail|メール(?:アドレス)?){_SEP}([a-zA-Z0-9_.+-]+[{_W}]*@[{_W}]*[a-zA-Z0-9.-]+)", "email", "メールアドレス", 1),
    Rule(rf"(?iu)(?:TEL|電話(?:番号)?|携帯(?:番号)?){_SEP}([0-9Oo〇○()（）+{_DASH}・･.{_W}]{{8,24}})", "phone", "電話番号", 1),
    Rule(rf"(?iu)(?:郵便番号|〒)[{_W}]*[:：{_W}]?[{_W}]*([0-9]{{3}}[{_W}]*[{_DASH}]?[{_W}]*[0-9]{{4}})", "postal", "郵便番号", 1),
    Rule(rf"(?iu)(?:住所|Address){_SEP}([^、。\n\r]{{4,80}})", "address", "住所", 1, accept=lambda line, m: T.is_address_value(T.trim_labelled(m["value"]))),
    Rule(rf"(?iu)(?:パスワード|Password|PW){_SEP}([^\n\r]{{2,80}})", "password", "パスワード", 1),
    Rule(rf"(?iu)(?:カード(?:番号)?|Card|クレジットカード|お支払い(?:方法)?)[{_W}]*[:：{_W}(（]?[{_W}]*(?:下[0-9]桁[{_W}]*[:：]?[{_W}]*)?([0-9\-*{_W}]{{4,24}}(?:[{_W}]*有効期限[{_W}]*[:：]?[{_W}]*[0-9/]+)?)", "credit_card", "カード情報", 1),
    Rule(
        rf"(?iu)(?:お?名前|氏名|Name)[{_W}]*(?:\([^)]*\)|（[^）]*）)?{_SEP}([^\n\r]{{2,60}})", "person", "人名", 1,
        accept=lambda line, m: T.is_person_value(T.trim_labelled(m["value"])) & ~F.substring(line, F.lit(1), m["at"]).rlike(_PRECEDES_NO_PERSON),
    ),
    Rule(rf"(?iu)(?:生年月日|誕生日|Date[{_W}]*of[{_W}]*Birth|DOB){_SEP}((?:明治|大正|昭和|平成|令和)?[{_W}]*[0-9]{{1,4}}[{_W}]*[年/.\-][{_W}]*[0-9]{{1,2}}[{_W}]*[月/.\-][{_W}]*[0-9]{{1,2}}[{_W}]*日?)", "birth_date", "生年月日", 1),
    Rule(rf"(?iu)(?:口座番号|口座No\.?|Account[{_W}]*(?:No\.?|Number)){_SEP}([0-9\-{_W}]{{4,16}})", "bank_account", "口座番号", 1),
    Rule(rf"(?iu)(?:支店番号|店番号|Branch[{_W}]*(?:No\.?|Number)){_SEP}([0-9\-{_W}]{{3,8}})", "bank_account", "支店番号", 1),
    Rule(rf"(?iu)(?:マイナンバー|個人番号){_SEP}([0-9\-{_W}]{{12,18}})", "id_number", "個人番号", 1),
    Rule(rf"(?iu)(?:運転免許証?(?:番号)?|免許証番号){_SEP}([0-9A-Z\-{_W}]{{8,18}})", "id_number", "免許証番号", 1),
    Rule(rf"(?iu)(?:旅券番号|パスポート番号){_SEP}([A-Z]{{1,2}}[{_W}]*[0-9]{{6,8}})", "id_number", "旅券番号", 1),
    Rule(rf"(?iu)(?:保険者番号|被保険者番号|記号番号){_SEP}([0-9A-Zぁ-んァ-ヶ一-龠\-{_W}]{{4,24}})", "id_number", "保険証番号", 1),
    Rule(rf"(?iu)(?:社員番号|従業員番号|顧客番号|会員番号|会員ID|ユーザーID|ログインID){_SEP}([a-zA-Z0-9_.@\-]{{2,40}})", "id_number", "識別番号", 1),
]
LABELLED = [Rule(r.pattern, r.category, r.label, r.group, r.on, r.accept, labelled=True) for r in LABELLED]

_BLOCK = rf"[0-9０-９ー丁目番地号\-{_W}]+(?:[{_W}]*[^\n\r0-9０-９、。！？{_W}]{{1,15}}[0-9０-９]+(?:号室?)?)?"
_PHONE_SEP = rf"[{_DASH}・･.{_W}]{{1,3}}"
# The shapes of values that need no label.
PHONE = rf"[0Oo〇][0-9Oo]{{1,4}}{_PHONE_SEP}[0-9Oo]{{1,4}}{_PHONE_SEP}[0-9Oo]{{3,5}}|(?:0[789]0[{_W}\-]?[0-9]{{4}}[{_W}\-]?[0-9]{{4}}|0[0-9]{{1,4}}[{_W}\-]?[0-9]{{1,4}}[{_W}\-]?[0-9]{{4}}){_NOT_WORD}"
EMAIL = rf"[a-zA-Z0-9][a-zA-Z0-9_.+-]*[{_W}]*[@＠][{_W}]*[a-zA-Z0-9][a-zA-Z0-9.-]*[{_W}]*[.．][{_W}]*[a-zA-Z]{{2,}}"
CARD = rf"(?i)下[0-9０-９]桁[{_W}]*[:：]?[{_W}]*[0-9]{{4}}|有効期限[{_W}]*[:：]?[{_W}]*[0-9]{{2}}/[0-9]{{2}}|(?<![A-Za-z0-9_])(?:[0-9]{{4}}[-{_W}]?){{3}}[0-9]{{4}}{_NOT_WORD}"
MONEY = rf"[￥¥][{_W}]*[0-9,]+|[0-9,]+[{_W}]*円"
SECRET = rf"(?<![A-Za-z0-9_])(?:sk-[A-Za-z0-9_-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[A-Z0-9]{{16}}){_NOT_WORD}"
FREE = [
    Rule(PHONE, "phone", "電話番号", accept=lambda line, m: F.length(T.digits_only(T.trim_all(m["whole"]))).between(9, 11)),
    Rule(EMAIL, "email", "メールアドレス", hint=lambda line: F.contains(line, F.lit("@")) | F.contains(line, F.lit("＠"))),
    Rule(rf"〒[{_W}]*[0-9]{{3}}[{_DASH}][0-9]{{4}}{_NOT_WORD}", "postal", "郵便番号"),
    Rule(rf"{T.any_of(*T.PREFECTURES)}[^\n\r0-9０-９、。！？]{{1,25}}{_BLOCK}", "address", "住所", on="line", trimmed=True, accept=lambda line, m: T.has_address_structure(m["whole"], False)),
    Rule(rf"[^\n\r0-9０-９、。！？{_W}]{{1,12}}[市区町村郡][^\n\r0-9０-９、。！？{_W}]{{1,15}}{_BLOCK}", "address", "住所", on="line", trimmed=True, accept=lambda line, m: T.has_address_structure(T.trim_all(m["whole"]), True)),
    Rule(rf"(?i)(?:パスワード|Password|PW)[{_W}]*[:：]?[{_W}]*([●•*]{{4,24}})", "password", "パスワード", 1, on="line"),
    Rule(CARD, "credit_card", "カード情報", accept=lambda line, m: ~m["whole"].rlike("^[0-9]") | T.is_card_number(m["whole"]), hint=lambda line: line.rlike("[0-9]{4}|[0-9]/[0-9]")),
    Rule(MONEY, "money", "金額"),
    Rule(rf"(?:^|[{_W}])(@[a-zA-Z0-9_]{{3,25}}){_NOT_WORD}", "sns_id", "SNS・アカウントID", 1),
    Rule(rf"(?:^|[^0-9])([0-9]{{4}}[{_W}\-]?[0-9]{{4}}[{_W}\-]?[0-9]{{4}})(?![0-9])", "id_number", "個人番号", 1, accept=lambda line, m: T.is_my_number(m["value"])),
    Rule(SECRET, "secret", "認証情報"),
]


def rule_spans(rule: Rule, line: Column, norm: Column) -> Column:
    """The accepted spans of one rule; texts are cut from the line as it came."""
    scanned = line if rule.on == "line" else norm
    found = matches(scanned, rule.pattern, rule.group)
    if rule.accept:
        found = F.filter(found, lambda m: rule.accept(scanned, m))

    def span(m: Column) -> Column:
        value = m["value"] if rule.group else m["whole"]
        if rule.labelled:
            value = T.trim_labelled(value)
        if rule.trimmed:
            value = T.trim_all(value)
        end = m["start"] + F.length(value)
        return F.struct(m["start"].alias("start"), end.alias("end"), F.lit(rule.category).alias("category"), F.lit(rule.label).alias("label"), F.substring(line, m["start"] + 1, end - m["start"]).alias("text")).cast(SPAN)

    spans = F.transform(found, span)
    return F.filter(spans, lambda s: s["end"] - s["start"] >= 2) if rule.labelled else spans


def merge_spans(spans: Column, line: Column) -> Column:
    """Fold spans in order. The first earlier span that a new one touches decides: of the same category, overlapping,
    they unite; a span inside it is dropped; a span around it takes its place, with its own category and label."""
    empty = F.array().cast(f"array<{SPAN}>")

    def cut(start: Column, end: Column) -> Column:
        return F.substring(line, start + 1, end - start)

    def step(acc: Column, x: Column) -> Column:
        def relation(r: Column) -> Column:
            return (
                F.when((r["category"] == x["category"]) & (x["start"] < r["end"]) & (x["end"] > r["start"]), 1)
                .when((x["start"] >= r["start"]) & (x["end"] <= r["end"]), 2)
                .when((x["start"] <= r["start"]) & (x["end"] >= r["end"]), 3)
                .otherwise(0)
            )

        hits = F.transform(acc, relation)
        first = F.array_position(F.transform(hits, lambda h: h > 0), True)

        def changed(r: Column, i: Column) -> Column:
            start, end = F.least(r["start"], x["start"]), F.greatest(r["end"], x["end"])
            union = F.struct(start.alias("start"), end.alias("end"), r["category"].alias("category"), r["label"].alias("label"), cut(start, end).alias("text")).cast(SPAN)
            kind = relation(r)
            return F.when(i + 1 != first, r).when(kind == 1, union).when(kind == 3, x).otherwise(r)

        return F.when(first == 0, F.concat(acc, F.array(x))).otherwise(F.transform(acc, changed)).cast(f"array<{SPAN}>")

    return T.bound(spans, lambda found: F.when(F.size(found) > 0, F.aggregate(found, empty, step)).otherwise(empty))


def pii_spans(line: Column, rules: list[Rule] | None = None, norm: Column | None = None) -> Column:
    """The merged spans of the labelled and free rules, in the order of the rule table. Null lines have none."""
    text = F.coalesce(line, F.lit(""))
    norm = T.half_width(text) if norm is None else norm
    rules = LABELLED + FREE if rules is None else rules
    found = merge_spans(F.concat(*(rule_spans(r, text, norm) for r in rules)), text)
    if not all(r.hint for r in rules):
        return found
    # few lines hold what any of the rules needs; the others are passed by in compiled code
    likely = reduce(Column.__or__, (r.hint(text if r.on == "line" else norm) for r in rules))
    return F.when(likely, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def detect_pii(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, line_no, seq, start, end, category, label, text)``; no shuffle."""
    prepared = lines.withColumn("norm", F.coalesce(T.half_width_line(F.col("line")), F.lit("")))
    spans = prepared.select("doc_id", "line_no", F.posexplode(pii_spans(F.col("line"), rules, F.col("norm"))).alias("seq", "span"))
    return spans.select("doc_id", "line_no", "seq", "span.*")
