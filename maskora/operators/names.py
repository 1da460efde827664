"""Persons and companies from dictionaries and shapes.

The surname dictionary is a parameter: a short list goes into the plan as a literal set, a long one is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskora.functions import text as T
from maskora.operators.spans import matches

# The surnames of the dictionary, without repeats; and 和田, which it lacks. A default: callers may give their own.
SURNAMES = (
    "佐藤", "鈴木", "高橋", "田中", "渡辺", "伊藤", "山本", "中村", "小林", "加藤", "吉田", "山田", "佐々木", "山口", "松本", "井上", "木村", "林", "斎藤", "清水", "山崎", "森", "池田", "橋本", "阿部", "石川", "山下", "中島", "石井", "小川", "前田",
    "岡田", "長谷川", "藤田", "後藤", "近藤", "村上", "遠藤", "青木", "坂本", "斉藤", "福田", "太田", "西村", "藤井", "岡本", "藤原", "三浦", "中川", "中野", "原田", "竹内", "小野", "田村", "中山", "石田", "上田", "森田", "原", "柴田", "酒井", "工藤",
    "横山", "宮崎", "宮本", "内田", "高木", "安藤", "島田", "谷口", "大野", "高田", "丸山", "増田", "杉山", "村田", "大塚", "平野", "菅原", "武田", "新井", "小山", "馬場", "野口", "千葉", "小島", "久保", "岩崎", "松田", "桜井", "木下", "菊地", "野村",
    "佐野", "吉川", "市川", "渡部", "杉本", "大西", "菅野", "菊池", "古川", "水野", "島津", "今井", "高野", "小池", "藤本", "五十嵐", "安田", "川口", "平井", "川崎", "本田", "久保田", "森本", "関", "服部", "飯田", "福島", "川上", "永井", "樋口",
    "田口", "吉村", "土屋", "松井", "岩田", "中西", "矢野", "石原", "星野", "荒木", "松岡", "秋山", "内山", "吉岡", "大森", "片山", "広瀬", "松尾", "小早川", "大久保", "奥村", "小野寺", "河野", "上野", "多田", "堀", "大島", "望月", "辻", "栗原",
    "白石", "横田", "西田", "三宅", "成田", "浅野", "大橋", "片岡", "岩井", "平松", "藤村", "石橋", "篠原", "萩原", "鎌田", "宮田", "北村", "神谷", "小出", "大谷", "吉野", "黒田", "西山", "堀内", "細川", "今泉", "早川", "長岡", "大石", "岡崎", "角田",
    "関口", "津田", "相沢", "須藤", "田代", "西川", "本間", "中井", "平林", "金子", "松永", "奥田", "松村", "熊谷", "富田", "梶原", "日野", "大内", "小西", "西尾", "森下", "庄司", "滝沢", "毛利", "三好", "米田", "長野", "金井", "梅田", "野沢", "宮沢",
    "吉成", "野崎", "小倉", "佐竹", "深沢", "浜田", "星", "荒井", "大竹", "岩本", "田島", "大沢", "松原", "岩佐", "塚本", "岡野", "安部", "武内", "寺田", "堀江", "松浦", "杉原", "大山", "福井", "植田", "小松", "大平", "畠山", "中原", "下村", "小原",
    "川島", "武藤", "野中", "西野", "村山", "森山", "大城", "真鍋", "白井", "川原", "宮内", "有馬", "大友", "豊田", "奥山", "飯塚", "沢田", "川端", "三上", "平岡", "平山", "根岸", "長田", "大倉", "土井", "小森", "日高", "宮城", "越智", "笠原", "関根",
    "高島", "大槻", "神保", "中沢", "長尾", "秋元", "坂井", "小谷", "飯野", "丹羽", "保科", "三ツ矢", "吉沢", "中尾", "水谷", "田辺", "吉永", "浅井", "北川", "石黒", "神田", "佐伯", "金森", "松下", "奥野", "稲垣", "稲葉", "大庭", "中根", "坂口",
    "川村", "北島", "小田", "平田", "立花", "川田", "土肥", "吉本", "田端", "古賀", "大矢", "福本", "村松", "小笹", "赤松", "高山", "赤木", "大沼", "金山", "岡", "三木", "田所", "永田", "長島", "吉原", "西原", "江口", "大滝", "小湊", "田上", "倉田",
    "堀越", "諸星", "大門", "戸田", "瀬戸", "平川", "小柳", "山内", "西垣", "西島", "松崎", "高津", "北原", "浜口", "小柴", "松木", "大津", "奥平", "大和田", "羽鳥", "勝又", "坂田", "大東", "高松", "西平", "福原", "相原", "高岡", "長谷", "大熊",
    "古谷", "若林", "牧野", "大出", "矢部", "小関", "海老原", "島崎", "宮下", "手塚", "安斎", "大川", "小椋", "北野", "長坂", "相馬", "小坂", "広田", "矢島", "岩瀬", "小笠原", "中津", "宮越", "石塚", "小栗", "大場", "高石", "小泉", "保坂", "小沢",
    "大関", "高見", "大村", "富永", "黒岩", "三橋", "矢沢", "小森谷", "北林", "大木", "小寺", "大河内", "大越", "大隅", "大畑", "小松崎", "大宮", "小田切", "小橋", "大柳", "小幡", "小畑", "大吉", "小浜", "小山田", "小俣", "小竹", "大前", "大脇", "小高",
    "大原", "小菅", "大町", "小貫", "大林", "小山内", "大迫", "小久保", "大里", "小暮", "大浦", "小杉", "大塩", "小峰", "阿久津", "足立", "朝倉", "天野", "鮎川", "安食", "安達", "綾部", "粟野", "安西", "飯島", "五十住", "井川", "生田", "池上", "石津",
    "石渡", "磯野", "一ノ瀬", "糸井", "乾", "犬塚", "猪狩", "岩城", "岩見", "植松", "臼井", "内海", "宇佐美", "海野", "江川", "榎本", "海老沢", "大嶋", "大館", "岡部", "奥泉", "押田", "織田", "小野田", "恩田", "甲斐", "各務", "風間", "梶山", "春日",
    "粕谷", "片桐", "勝田", "加納", "金沢", "上泉", "上林", "亀井", "鴨下", "萱野", "刈谷", "川井", "川北", "川越", "川瀬", "川本", "木内", "木崎", "北沢", "北田", "城戸", "木全", "木本", "久米", "蔵田", "栗田", "栗本", "黒沢", "桑原", "桑田", "小嶋",
    "越川", "小堀", "駒井", "小宮", "西郷", "西条", "斉木", "酒向", "坂元", "相良", "櫻井", "笹川", "笹木", "真田", "佐保", "沢井", "沢木", "三条", "塩田", "志賀", "宍戸", "設楽", "篠崎", "篠田", "芝崎", "島村", "下田", "東海林", "白鳥", "菅井",
    "杉江", "杉田", "須田", "住友", "諏訪", "関谷", "芹沢", "千田", "副島", "園田", "高井", "高砂", "高瀬", "高梨", "高根", "滝川", "竹井", "竹下", "武井", "竹田", "竹村", "立石", "立川", "橘", "伊達", "棚橋", "谷", "谷川", "玉井", "玉置", "千代",
    "塚田", "津島", "辻本", "角井", "坪井", "鶴田", "手島", "寺島", "寺本", "東郷", "常盤", "戸塚", "富井", "鳥居", "内藤", "長井", "中居", "永尾", "長沼", "永野", "長峰", "七尾", "楢崎", "成瀬", "南部", "西", "西岡", "西久保", "仁科", "西本", "新田",
    "二宮", "沼田", "根本", "野上", "野添", "野本", "萩野", "橋爪", "長谷部", "畑中", "花田", "羽生", "浜崎", "早坂", "林田", "速水", "坂東", "日向", "平岩", "平瀬", "広川", "広沢", "福地", "深見", "福永", "藤川", "藤野", "布施", "船木", "古田",
    "北条", "星崎", "穂高", "本庄", "前川", "前原", "牧", "蒔田", "松川", "松平", "水島", "水橋", "皆川", "南", "宮前", "向井", "村井", "村瀬", "森井", "森脇", "八木", "矢口", "安川", "柳田", "柳", "山岡", "山岸", "山越", "山科", "湯浅", "湯川",
    "横井", "米山", "若井", "若菜", "若松", "涌井", "鷲尾", "渡利", "和久井", "和田",
)
#: Longest dictionary that is put into a plan as literals.
LITERALS = 2_000
# Titles and forms of address, corporate types, and suffixes of organisations.
HONORIFICS = (
    "様", "さま", "サマ", "さん", "サン", "君", "くん", "クン", "ちゃん", "チャン", "氏", "先生", "殿", "閣下", "社長", "副社長", "会長", "専務", "常務", "取締役", "執行役員", "部長", "次長", "課長", "係長", "主任", "主幹", "リーダー", "サブリーダー",
    "マネージャー", "マネージャ", "プロデューサー", "ディレクター", "代表", "CEO", "CTO", "CFO", "COO", "CIO", "PM", "PL", "担当",
)
CORPORATE_TYPES = (
    "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "一般社団法人", "公益社団法人", "一般財団法人", "公益財団法人", "特定非営利活動法人", "NPO法人", "学校法人", "医療法人", "社会福祉法人",
    "弁護士法人", "税理士法人", "監査法人", "特許業務法人", "司法書士法人", "行政書士法人", "（株）", "(株)", "【株】", "㈱", "（有）", "(有)", "㈲", "（同）", "(同)", "Inc.", "Corp.", "Ltd.", "LLC", "Co., Ltd.", "Co.,Ltd.", "Corporation",
)
DISTINCT_SUFFIXES = (
    "銀行", "信託銀行", "信用金庫", "信金", "労働金庫", "農協", "病院", "医院", "クリニック", "診療所", "大学", "短期大学", "大学院", "学園", "高等学校", "中学校", "小学校", "専門学校", "警察署", "市役所", "区役所", "町役場", "村役場", "税務署", "消防署", "裁判所",
    "法律事務所", "特許事務所", "会計事務所", "税理士事務所", "社労士事務所",
)
OTHER_SUFFIXES = (
    "歯科", "眼科", "製作所", "製造所", "工業", "興業", "商事", "物産", "不動産", "住宅", "開発", "システムズ", "システム", "ソリューションズ", "ソリューション", "テクノロジー", "テクノロジーズ", "ラボ", "研究所", "スタジオ", "パートナーズ", "ホールディングス", "グループ",
    "協会", "連合会", "組合", "機構", "公社", "公団", "センター", "事業所",
)
# Greetings, what may follow a name, and words that are no names.
_GREETING = "(?:お疲れ|おつかれ|ご苦労|ごくろう|お世話|おせわ|ご馳走|ごちそう|お互い|おたがい|お待ちどう|おまちどう)(?:様|さま|サマ|さん|サン)"
_AFTER_NAME = "^(?:さん|様|さま|君|くん|ちゃん|氏|殿|先生|です|でした|より|から|は|が|を|に|へ|と|の)"
_NOT_GIVEN = r"^(?:です|ます|でした|より|から|なら|でも|だよ|だね|だと|だが|では|には|とは|への|のみ|だけ|こと|など|ので|ため)\z"
_PARTICLE = "(?:の|は|が|を|に|で|と|より|から|へ|など|等|様|さん|殿|御中|です|ます|でした|にて|とも|との|として)"
_NOT_COMPANY = r"^(?:設立|一覧|概要|検索|登記|定款|制度|手続き?)(?:\z|の|について)"
_ORG_LABEL = rf"(?:会社名|企業名|組織名|所属|勤務先|取引先)[{T.WS}]*[:：][{T.WS}]*\z"
_GENERIC = r"^(?:通知|管理|設定|利用|画像|画像処理|情報|処理|開発|設計|営業|製品|業務|事業|研究|技術|金融|医療|国立|公立|私立|総合|地域|市民|近隣|近く|各種|対象|全国|一般)\z"
_READING = rf"^[{T.WS}]*[（(][A-Za-z{T.WS}.'-]+[）)]"
_H, _K, _HI = T.HAN, T.KATA, T.HIRA
_NAME_CHAR = rf"[{_H}々{_K}a-zA-Z0-9_]"
_NAMES = "array<struct<start:int,end:int,text:string,name:string,reason:string>>"


def _longest_first(words) -> str:
    return "|".join(f"\\Q{w}\\E" for w in sorted(words, key=len, reverse=True))


def _among(s: Column, words: list[str]) -> Column:
    """Whether ``s`` is one of ``words``, all of its length: one literal, where a list of them would make plans slow to build."""
    return F.lit("\0" + "\0".join(words) + "\0").contains(F.concat(F.lit("\0"), s, F.lit("\0")))


def surname_of(s: Column, surnames=SURNAMES) -> Column:
    """The longest dictionary surname (four characters at most) that ``s`` starts with, as it stands there; from two characters on look-alikes match too."""
    if len(surnames) > LITERALS:
        raise ValueError("join a dictionary of this length: surname_prefixes()")
    tries = [F.lit(None).cast("string")]
    for n in (4, 3, 2, 1):
        alike = [x for x in surnames if len(x) == n]
        if not alike:
            continue
        head = F.substring(s, 1, n)
        hit = _among(head, alike)
        if n > 1:
            hit = hit | _among(T.fold_lookalikes(head), sorted({x.translate(str.maketrans(T.LOOKALIKE, T.LOOKALIKE_AS)) for x in alike}))
        tries.append(F.when((F.length(s) >= n) & hit, head))
    return F.coalesce(*tries)


def surname_prefixes(names: DataFrame, surnames: DataFrame, name_col: str = "name") -> DataFrame:
    """``names`` with the longest surname of a dictionary table ``(surname)`` of any length: an equi-join on the prefixes."""
    rows = names.withColumn("_row", F.monotonically_increasing_id())
    tries = rows.select("_row", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring(F.col(name_col), F.lit(1), n))).alias("surname")).distinct()
    best = tries.join(surnames.select("surname").distinct(), "surname", "left_semi").groupBy("_row").agg(F.max_by("surname", F.length("surname")).alias("surname"))
    return rows.join(best, "_row", "left").drop("_row")


def is_known_full_name(s: Column, surnames=SURNAMES) -> Column:
    surname = surname_of(s, surnames)
    shape = s.rlike(rf"^[{_H}々][{_H}々{_K}ー]{{1,7}}\z") & ~s.rlike(T.NON_PERSON_WORDS) & ~s.rlike(rf"(?:{T.NON_PERSON_ENDING})\z") & ~s.rlike(rf"^(?:{T.SURNAME_COMPOUNDS})\z")
    return F.coalesce(shape & (F.length(s) - F.length(surname)).between(1, 3), F.lit(False))


def _is_surname(s: Column, surnames) -> Column:
    return F.coalesce(surname_of(s, surnames) == s, F.lit(False))


def _no_cover(spans: Column, checked: Column | None = None) -> Column:
    """In order, without spans that a kept one covers."""
    def step(acc, x):
        covered = F.exists(acc, lambda r: (x["start"] >= r["start"]) & (x["end"] <= r["end"]))
        skip = covered if checked is None else covered & (x["reason"] != "corporate_prefix")
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(x))).cast(_NAMES)

    return F.aggregate(spans, F.array().cast(_NAMES), step)


def _one_by_one(rows: DataFrame, column: str) -> DataFrame:
    """A row for each span. An inner explode would have the optimizer filter on the array's size, and run the detector once more for that."""
    spans = rows.select("doc_id", "line_no", F.posexplode_outer(column).alias("seq", "span")).filter("seq IS NOT NULL")
    return spans.select("doc_id", "line_no", "seq", "span.*")


def detect_persons(lines: DataFrame, surnames=SURNAMES) -> DataFrame:
    """``(doc_id, line_no, seq, start, end, text, name, reason)``: names by honorific, as pairs, and by dictionary.

    Spaces inside names are ignored; greetings are no names; a name must stand at a boundary. No shuffle.
    """
    return _one_by_one(with_persons(lines, surnames), "persons")


def with_persons(lines: DataFrame, surnames=SURNAMES) -> DataFrame:
    """``lines`` with ``persons``, the names of each line as an array."""
    line = F.coalesce("line", F.lit(""))
    places = F.filter(F.sequence(F.lit(0), F.length(line)), lambda i: (i < F.length(line)) & ~F.substring(line, i + 1, F.lit(1)).isin(" ", "\t", "　"))
    base = lines.withColumns({"_line": line, "_c": F.regexp_replace(line, "[ \t　]", ""), "_at": places})
    base = base.withColumn("_greet", matches(F.col("_c"), _GREETING))
    c, at, text = F.col("_c"), F.col("_at"), F.col("_line")
    place = lambda i: F.try_element_at(at, i + 1)

    def boundary(start: Column, end: Column) -> Column:
        before, after = F.substring(c, start, F.lit(1)), F.substring(c, end + 1, F.length(c))
        left = (start == 0) | ~before.rlike(_NAME_CHAR) | F.coalesce(place(start) > place(start - 1) + 1, F.lit(False))
        right = ~F.substring(after, 1, 1).rlike(_NAME_CHAR) | F.coalesce(place(end) > place(end - 1) + 1, F.lit(False)) | after.rlike(_AFTER_NAME)
        return left & right

    def free(start: Column, end: Column) -> Column:
        return ~F.exists(F.col("_greet"), lambda g: (start < g["at"] + F.length(g["whole"])) & (end > g["at"]))

    def span(start: Column, end: Column, name: Column, reason: str, reading: bool = False) -> Column:
        s, e = place(start), place(end - 1) + 1
        if reading:
            e = e + F.length(F.regexp_extract(F.substring(text, e + 1, F.length(text)), _READING, 0))
        return F.struct(s.alias("start"), e.alias("end"), F.substring(text, s + 1, e - s).alias("text"), name.alias("name"), F.lit(reason).alias("reason"))

    def no_person(s: Column) -> Column:
        return s.rlike(T.NON_PERSON_WORDS) | s.rlike(rf"^(?:{T.NON_PERSON_EXACT})\z") | s.rlike(rf"(?:{T.NON_PERSON_ENDING})\z") | s.rlike(rf"(?i)^(?:{T.UI_WORDS})\z")

    titled = matches(c, rf"([{_H}々]{{1,4}}[{_HI}]{{1,4}}|[{_H}々{_K}a-zA-Z]{{1,12}}|[{_HI}]{{2,4}})(?:{_longest_first(HONORIFICS)})", 1)
    titled = F.filter(titled, lambda m: ~no_person(m["value"]) & (_is_surname(m["value"], surnames) | is_known_full_name(m["value"], surnames) | T.is_person_value(m["value"])) & boundary(m["at"], m["at"] + F.length(m["whole"])) & free(m["at"], m["at"] + F.length(m["whole"])))
    titled = F.transform(titled, lambda m: span(m["at"], m["at"] + F.length(m["whole"]), m["value"], "honorific_match"))

    pairs = matches(c, rf"[{_H}々]{{1,4}}[・･·/／][{_H}々]{{1,4}}")
    part = lambda m, i: F.try_element_at(F.split(m["whole"], "[・･·/／]"), F.lit(i))
    pairs = F.filter(pairs, lambda m: _is_surname(part(m, 1), surnames) & _is_surname(part(m, 2), surnames) & boundary(m["at"], m["at"] + F.length(m["whole"])) & free(m["at"], m["at"] + F.length(m["whole"])))
    pairs = F.transform(pairs, lambda m: span(m["at"], m["at"] + F.length(m["whole"]), m["whole"], "full_name_pattern"))

    runs = matches(c, rf"[{_H}々{_K}ー]+")
    runs = F.filter(runs, lambda m: boundary(m["at"], m["at"] + F.length(m["whole"])) & ~m["whole"].rlike(T.NON_PERSON_WORDS) & ~m["whole"].rlike(rf"(?:{T.NON_PERSON_ENDING})\z"))

    def named(m: Column) -> Column:
        word, start, end = m["whole"], m["at"], m["at"] + F.length(m["whole"])
        after = F.substring(c, end + 1, F.length(c))
        kana = F.regexp_extract(after, rf"^([{_HI}]{{2,4}})(?=\z|[（(])", 1)
        given = (F.length(kana) > 0) & ~kana.rlike(_NOT_GIVEN) & T.is_person_value(F.concat(word, kana))
        surname = (F.length(word) >= 2) & _is_surname(word, surnames)
        return (
            F.when(is_known_full_name(word, surnames), span(start, end, word, "full_name_pattern", True))
            .when(surname & given, span(start, end + F.length(kana), F.concat(word, kana), "full_name_pattern", True))
            .when(surname & (~after.rlike(rf"^[{_HI}]") | after.rlike(_AFTER_NAME)), span(start, end, word, "surname_match"))
        )

    runs = F.filter(runs, lambda m: free(m["at"], m["at"] + F.length(m["whole"])))
    runs = F.filter(F.transform(runs, named), lambda x: x.isNotNull())
    found = _no_cover(F.concat(titled.cast(_NAMES), pairs.cast(_NAMES), runs.cast(_NAMES)))
    return base.withColumn("persons", found).drop("_line", "_c", "_at", "_greet")


def detect_companies(lines: DataFrame) -> DataFrame:
    """``(doc_id, line_no, seq, start, end, text, name, reason)``: a corporate type before or after a name, then organisations by suffix. No shuffle."""
    return _one_by_one(with_companies(lines), "companies")


def with_companies(lines: DataFrame) -> DataFrame:
    """``lines`` with ``companies``, the company names of each line as an array."""
    text, folded = F.col("_line"), F.col("_folded")
    base = lines.withColumn("_line", F.coalesce("line", F.lit(""))).withColumn("_folded", T.fold_lookalikes(F.col("_line")))
    name = rf"{_H}{_K}a-zA-Z0-9_ー・-"
    fold = str.maketrans(T.LOOKALIKE, T.LOOKALIKE_AS)

    def cut(start, length, reason):
        words = F.substring(text, start + 1, length)
        return F.struct(start.alias("start"), (start + length).alias("end"), words.alias("text"), words.alias("name"), F.lit(reason).alias("reason"))

    def of_type(mark: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), mark, F.lit("\\E"))
        before = matches(folded, F.concat(quoted, F.lit(rf"[{T.WS}]*([{name}]{{1,20}}|[{_HI}{name}]{{1,20}})")), 1)
        before = F.filter(before, lambda m: ~m["value"].rlike(f"^{_PARTICLE}") & ~m["value"].rlike(_NOT_COMPANY))
        before = F.transform(before, lambda m: cut(m["at"], F.length(m["whole"]) - F.length(m["value"]) + F.length(F.regexp_extract(m["value"], f"(?s)^.(?:(?!{_PARTICLE}).)*", 0)), "corporate_prefix"))
        after = F.filter(matches(folded, F.concat(F.lit(rf"[{name}]{{1,20}}[{T.WS}]*"), quoted)), lambda m: F.length(m["whole"]) > F.length(mark))
        return F.concat(before.cast(_NAMES), F.transform(after, lambda m: cut(m["at"], F.length(m["whole"]), "corporate_suffix")).cast(_NAMES))

    # only the types that the line holds are searched, in the table's order
    kinds = F.filter(F.array(*(F.lit(k.translate(fold)) for k in CORPORATE_TYPES)), lambda k: F.contains(folded, k))
    found = [F.flatten(F.transform(kinds, of_type))]
    orgs = matches(folded, rf"([{_H}{_K}a-zA-Z0-9_ー]{{2,15}})(?:{_longest_first(DISTINCT_SUFFIXES + OTHER_SUFFIXES)})", 1)

    def stands(m):
        suffix = F.substring(m["whole"], F.length(m["value"]) + 1, F.length(m["whole"]))
        labelled = F.substring(text, F.lit(1), m["at"]).rlike(_ORG_LABEL)
        return labelled | (suffix.isin(*DISTINCT_SUFFIXES) & ~F.substring(text, m["at"] + 1, F.length(m["value"])).rlike(_GENERIC))

    found.append(F.transform(F.filter(orgs, stands), lambda m: cut(m["at"], F.length(m["whole"]), "org_suffix")))
    kept = _no_cover(F.concat(*(x.cast(_NAMES) for x in found)), checked=True)
    # most lines hold neither a corporate type nor a suffix: one scan decides before seventy
    likely = folded.rlike("|".join(f"\\Q{k.translate(fold)}\\E" for k in CORPORATE_TYPES) + "|" + _longest_first(DISTINCT_SUFFIXES + OTHER_SUFFIXES))
    return base.withColumn("companies", F.when(likely, kept).otherwise(F.array().cast(_NAMES))).drop("_line", "_folded")


def is_chat_sender(value: Column, is_person: Column, context: Column) -> Column:
    """Whether a header line names its sender: a detected person, a capitalised full name, or, beside a message, a plausible name."""
    v = T.trim_all(F.regexp_replace(T.trim_all(value), rf"[{T.WS}]*(?:[0-9]{{1,2}}:[0-9]{{2}}|既読|未読|送信済み)[{T.WS}]*\z", ""))
    no = v.rlike(T.NON_PERSON_WORDS) | v.rlike(rf"(?i)^(?:{T.UI_WORDS})\z") | v.rlike(r"^(?:今日|昨日|既読|未読|送信済み|[0-9]{1,2}:[0-9]{2}|[0-9]{1,2}/[0-9]{1,2})\z")
    shaped = v.rlike(r"^[A-Z][a-z]+(?:[ .'-]+[A-Z][a-z]+)+\z")
    return F.length(v).between(2, 24) & ~no & (is_person | shaped | (context & (T.is_person_value(v) | v.rlike(r"^[A-Za-z][A-Za-z0-9_.]{1,14}\z"))))
