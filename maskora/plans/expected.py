"""SQL of what the detectors must find in the generated lines, kind by kind, and of redacted pages.

``JP_LINE`` makes fourteen kinds of line; what is personal in each kind is known from how it is made, so these
statements hold the detectors against the text's own making, not against another set of patterns.
"""

from __future__ import annotations

from maskora.sources.tables import _EIGHT, _NAME, JP_LINE

LINES = f"SELECT c_custkey AS id, c_custkey % 14 AS kind, {_NAME} AS name, {_EIGHT} AS eight, {JP_LINE} AS line FROM customer"


def _spans(rows: list[tuple]) -> str:
    """A union of ``(id, seq, start, end, text, ...)``; a row is ``(kind, seq, marker, text, more, condition)``. A text starts after its marker."""
    parts = []
    for kind, seq, marker, text, more, condition in rows:
        start = f"strpos(line, '{marker}') + {len(marker) - 1}" if marker else f"strpos(line, {text}) - 1"
        parts.append(f'SELECT id, {seq} AS seq, CAST({start} AS integer) AS start, CAST({start} + length({text}) AS integer) AS "end", {text} AS text, {more} FROM l WHERE kind = {kind} AND {condition}')
    return " UNION ALL ".join(parts)


PERSONS = [
    (0, 0, "", "name", "name, 'full_name_pattern' AS reason", "true"),
    (4, 0, "", "name", "name, 'full_name_pattern' AS reason", "true"),
    (5, 0, "", "concat(name, '様')", "name, 'honorific_match' AS reason", "true"),
]
_TECH, _TOYOTA, _BANK = "concat('株式会社テック', id)", "concat('トヨタ', id % 50, '自動車株式会社')", "'株式会社 三菱銀行'"
COMPANIES = [
    (4, 0, "", _TECH, f"{_TECH} AS name, 'corporate_prefix' AS reason", "true"),
    (11, 0, "", _BANK, f"{_BANK} AS name, 'corporate_prefix' AS reason", "true"),
    (11, 1, "", _TOYOTA, f"{_TOYOTA} AS name, 'corporate_suffix' AS reason", "true"),
]
_NUMBER = "concat('1234', eight)"
_VALID = f"(SELECT CASE WHEN r <= 1 THEN 0 ELSE 11 - r END = CAST({_NUMBER}[12] AS integer) FROM (SELECT list_sum(list_transform(range(1, 12), lambda i: CAST({_NUMBER}[i] AS integer) * [6,5,4,3,2,7,6,5,4,3,2][i])) % 11 AS r))"


def _pii(kind, seq, marker, text, category, label, condition="true"):
    return kind, seq, marker, text, f"'{category}' AS category, '{label}' AS label", condition


PII = [
    _pii(0, 0, "TEL: ", "concat('090-', substr(eight, 1, 4), '-', substr(eight, 5, 4))", "phone", "電話番号"),
    _pii(0, 1, "", "name", "person", "人名"),
    _pii(1, 0, "", "concat('〒', substr(eight, 1, 3), '-', substr(eight, 4, 4))", "postal", "郵便番号"),
    _pii(1, 1, "", "concat('東京都千代田区丸の内', id % 9 + 1, '-', id % 7 + 1)", "address", "住所"),
    _pii(2, 0, "", "concat(id % 900 + 100, ',000円')", "money", "金額"),
    _pii(2, 1, "", "concat('￥', id)", "money", "金額"),
    _pii(3, 0, "", _NUMBER, "id_number", "個人番号", _VALID),
    _pii(6, 0, "", "concat('user', id, '@example.jp')", "email", "メールアドレス"),
    _pii(6, 1, "", "concat('pw-', eight)", "password", "パスワード"),
    _pii(7, 0, "", "substr(eight, 1, 7)", "bank_account", "口座番号"),
    _pii(7, 1, "支店番号: ", "substr(eight, 1, 3)", "bank_account", "支店番号"),
    _pii(8, 0, "", "concat('1980年', id % 12 + 1, '月', id % 28 + 1, '日')", "birth_date", "生年月日"),
    _pii(8, 1, "", "concat('m_', id)", "id_number", "識別番号"),
    _pii(9, 0, "", "concat('4111 1111 1111 ', substr(eight, 1, 4))", "credit_card", "カード情報"),
    _pii(10, 0, "", "concat('ghp_1234567890ABCDEFGHIJ', eight)", "secret", "認証情報"),
    _pii(13, 0, "", "concat('@user_', id)", "sns_id", "SNS・アカウントID"),
]


def _named(rows: list[tuple], columns: str) -> str:
    return f'WITH l AS ({LINES}) SELECT id AS doc_id, 0 AS line_no, seq, start, "end", {columns} FROM ({_spans(rows)})'


PERSON_SQL = _named(PERSONS, "text, name, reason")
COMPANY_SQL = _named(COMPANIES, "text, name, reason")
PII_SQL = _named(PII, "category, label, text")

#: Fourteen customers are a document here. A name that stands alone in another line of its document is found there too.
PROPAGATED_SQL = f"""
WITH l AS ({LINES}), found AS (
SELECT id, 'person' AS kind, text AS entity, text, start, "end" FROM ({_spans(PERSONS)})
UNION ALL SELECT id, 'company', replace(text, ' ', ''), text, start, "end" FROM ({_spans(COMPANIES)})
UNION ALL SELECT id, 'person', name, name, CAST(strpos(line, name) - 1 AS integer), CAST(strpos(line, name) - 1 + length(name) AS integer) FROM l WHERE kind = 12)
SELECT CAST(floor(id / 14) AS bigint) AS doc_id, CAST(id AS integer) AS line_no, kind, entity, start, "end", text FROM found
"""

REDACTED_SQL = f"""
WITH l AS ({LINES}) SELECT id AS doc_id, 0 AS line_no, line, CASE kind WHEN 0 THEN '氏名: [人名] TEL: [電話番号]' WHEN 1 THEN '[郵便番号] [住所]' WHEN 2 THEN '合計 [金額] (税 [金額])'
WHEN 3 THEN CASE WHEN {_VALID} THEN '個人番号の控え [個人番号] 以上' ELSE line END WHEN 4 THEN '[会社名]の[人名]です' WHEN 5 THEN '先ほど[人名]から連絡、お疲れ様です'
WHEN 6 THEN 'Email: [メールアドレス] Password: [パスワード]' WHEN 7 THEN '口座番号: [口座番号] 支店番号: [支店番号]' WHEN 8 THEN '会員番号: [識別番号] 生年月日: [生年月日]'
WHEN 9 THEN 'カード番号: [カード情報]' WHEN 10 THEN 'ｔｏｋｅｎ [認証情報] を確認' WHEN 11 THEN concat('[会社名] ', name, '部長') WHEN 12 THEN line ELSE '東京都の会議は2026年10月 [SNS・アカウントID] お知らせ' END AS redacted FROM l
"""


def choice_sql(ocr: str) -> str:
    """The second recognition has the confidences times seven, modulo a hundred."""
    score = "sum(n) * greatest(1e0, sum({c} * greatest(1, n)) / sum(n))"
    return f"""
WITH q AS (SELECT doc_id, sum(confidence * greatest(1, n)) / sum(n) AS a, {score.format(c="confidence")} AS sa, sum(confidence * 7 % 100 * greatest(1, n)) / sum(n) AS b, {score.format(c="(confidence * 7 % 100)")} AS sb
FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM ({ocr})) GROUP BY doc_id)
SELECT doc_id, sb > sa * 1.15 AND b >= a - 3 AS use_second FROM q
"""


def strokes_sql(boxes: str) -> str:
    """The new stroke is (90, 25, 20, 18), the gap 1.6 heights."""
    return f"""
WITH b AS ({boxes}), same AS (SELECT * FROM b WHERE w >= 1 AND h >= 1 AND NOT (18 > h * 2.2 AND 18 > h + 14) AND NOT (h > 18 * 2.2 AND h > 32) AND abs(y + h / 2 - 34) <= greatest(8e0, least(h, 18e0) * 0.7)
 AND greatest(x, 90e0) - least(x + w, 110e0) <= greatest(h, 18e0) * 1.6),
e AS (SELECT d.doc_id, least(90e0, coalesce(min(x), 90e0)) AS x, least(25e0, coalesce(min(y), 25e0)) AS y, greatest(110e0, coalesce(max(x + w), 110e0)) AS r, greatest(43e0, coalesce(max(y + h), 43e0)) AS d, count(x) AS absorbed
 FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d LEFT JOIN same ON same.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, x, y, r - x AS w, d - y AS h, absorbed FROM e
"""


def snap_sql(ocr: str) -> str:
    """The drag goes from (12, 30) to (80, 34) in each document."""
    away = "CASE WHEN {b} >= y0 AND {a} <= y1 THEN 0e0 WHEN {b} < y0 THEN y0 - {b} ELSE {a} - y1 END"
    a, b, c = (away.format(a=x, b=y) for x, y in (("30e0", "30e0"), ("34e0", "34e0"), ("30e0", "34e0")))
    near = "coalesce((SELECT e FROM (VALUES (x0), (x1)) v(e) WHERE abs({p} - e) <= reach ORDER BY abs({p} - e), e LIMIT 1), {p})"
    return f"""
WITH t AS (SELECT *, greatest(8e0, y1 - y0) AS h, greatest(0e0, least(80e0, x1) - greatest(12e0, x0)) AS overlap, least(({a}) * 1.5, {b}, {c}) AS distance FROM ({ocr})),
n AS (SELECT *, distance * 2 - CASE WHEN overlap > 0 THEN 20 ELSE 0 END AS score FROM t WHERE (overlap > 0 OR (12 <= x1 + 40 AND 80 >= x0 - 40)) AND distance <= greatest(24e0, h * 1.25)),
o AS (SELECT *, greatest(12e0, h * 0.4) AS reach FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, line_no) = 1),
f AS (SELECT *, 68 > (x1 - x0) * 0.75 AND 12 <= x0 + reach * 2 AND 80 >= x1 - reach * 2 AS full_line FROM o),
e AS (SELECT *, CASE WHEN full_line THEN x0 ELSE {near.format(p="12e0")} END AS l, CASE WHEN full_line THEN x1 ELSE {near.format(p="80e0")} END AS r FROM f)
SELECT d.doc_id, 1 AS drag_id, CASE WHEN h * 2.4 >= 4 THEN line_no END AS line_no, CASE WHEN h * 2.4 >= 4 THEN greatest(0e0, l - 1) ELSE 12e0 END AS x, CASE WHEN h * 2.4 >= 4 THEN greatest(0e0, y0 - 2) ELSE 30e0 END AS y,
CASE WHEN h * 2.4 >= 4 THEN greatest(6e0, r - l + 2) ELSE 68e0 END AS w, CASE WHEN h * 2.4 >= 4 THEN y1 - y0 + 4 ELSE 4e0 END AS h, line_no IS NOT NULL AND h * 2.4 >= 4 AS snapped
FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d LEFT JOIN e ON e.doc_id = d.doc_id
"""


def runs_sql(cover: str, boxes: str) -> str:
    """``(doc_id, line_no, pos, box_id, type, mark, first)`` of covered characters; ``first`` where a placeholder starts."""
    return f"""SELECT c.*, b.type, lag(c.pos) OVER w IS DISTINCT FROM c.pos - 1 OR lag(c.mark) OVER w IS DISTINCT FROM c.mark AS first
FROM ({cover}) c JOIN ({boxes}) b ON b.doc_id = c.doc_id AND b.box_id = c.box_id WINDOW w AS (PARTITION BY c.doc_id, c.line_no ORDER BY c.pos)"""


def stats_sql(cover: str, boxes: str) -> str:
    kinds = ", ".join(f"count(*) FILTER (type = '{k}') AS {k}" for k in ("person", "company", "pii", "custom"))
    return f"SELECT doc_id, {kinds} FROM (SELECT DISTINCT doc_id, line_no, box_id, type FROM ({runs_sql(cover, boxes)}) WHERE first) GROUP BY doc_id"


def text_sql(ocr: str, cover: str, boxes: str, clean: str) -> str:
    """Lines are written part by part: characters as they are, placeholders apart from the text before them and not twice in a row."""
    return f"""
WITH o AS ({ocr}), r AS ({runs_sql(cover, boxes)}),
p AS (SELECT o.doc_id, o.line_no, i, CASE WHEN r.pos IS NULL THEN concat('t', substr(o.text, i + 1, 1)) WHEN r.first THEN concat('m', r.mark) END AS part
 FROM (SELECT doc_id, line_no, text, unnest(range(length(text))) AS i FROM o) o LEFT JOIN r ON r.doc_id = o.doc_id AND r.line_no = o.line_no AND r.pos = o.i),
w AS (SELECT doc_id, line_no, list_reduce(list_prepend('', list(part ORDER BY i) FILTER (part IS NOT NULL)), lambda a, x: CASE WHEN x[1] = 't' THEN concat(a, x[2:]) WHEN ends_with(rtrim(a), x[2:]) THEN a
 WHEN a = '' OR regexp_matches(a, '[ 　:：]$') THEN concat(a, x[2:]) ELSE concat(a, ' ', x[2:]) END) AS line FROM p GROUP BY 1, 2),
c AS (SELECT doc_id, line_no, {clean} AS line FROM w)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS redacted_text FROM c WHERE line != '' GROUP BY doc_id
"""
