from maskora.operators.names import SURNAMES, detect_companies, detect_persons, surname_prefixes


def lines(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")


PERSONS = ["山田 太郎", "山 田 太 郎", "佐々木 葵（Aoi Sasaki）", "先ほど佐藤さんから", "鈴木部長に", "山田・鈴木", "山田です"]
NOBODY = ["山口県", "清水公園", "田中工業", "小林製薬", "資料 作成", "氏名 変更", "お客様", "皆様", "お疲れ様です", "ご苦労さま", "", None]
COMPANIES = {"Google LLC": "Google LLC", "トヨタ自動車株式会社": "トヨタ自動車株式会社", "株式会社テックラボの山田です": "株式会社テックラボ", "三菱銀行": "三菱銀行", "勤務先: 山本開発": "山本開発"}
NO_COMPANY = ["画像処理システム", "通知センター", "開発グループ", "株式会社の設立", "", None]


def test_persons(spark):
    texts = PERSONS + NOBODY + ["お疲れ様。山田様に連絡しました。"]
    rows = detect_persons(lines(spark, texts)).collect()
    by = {}
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert set(by) == set(range(len(PERSONS))) | {len(texts) - 1}
    assert by[len(texts) - 1] == ["山田様"] and by[1] == ["山 田 太 郎"] and by[2] == ["佐々木 葵（Aoi Sasaki）"]


def test_companies(spark):
    texts = [*COMPANIES, *NO_COMPANY]
    got = {}
    for r in detect_companies(lines(spark, texts)).collect():
        got.setdefault(texts[r["doc_id"]], []).append(r["text"])
    assert got == {k: [v] for k, v in COMPANIES.items()}


def test_surname_join(spark):
    names = spark.createDataFrame([("佐々木葵",), ("林檎",), ("xyz",), (None,)], "name string")
    found = surname_prefixes(names, spark.createDataFrame([("佐",), ("佐々木",), ("林",)], "surname string"))
    assert {r["name"]: r["surname"] for r in found.collect()} == {"佐々木葵": "佐々木", "林檎": "林", "xyz": None, None: None}


def test_whole_dictionary(spark):
    texts = ["和久井 葵", "鷲尾・望月", "南野 拓也"]
    assert len(set(SURNAMES)) == len(SURNAMES) == 682
    rows = detect_persons(lines(spark, texts)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(texts))
