"""Scalar text functions as Spark columns: width and look-alike folding, cleanup, check digits, value shapes.

Offsets everywhere are 0-based code points, half-open. White space is what browsers call white space
(``WS``), which is wider than Java's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class for white space.
WS = r"\t\n\x0B\f\r " + "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What recognised text may have between characters.
SPACE = r" \t\n\r" + "\u3000\u00a0"
SPACE_MEMBERS = " \t\n\r\u3000\u00a0"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
CJK_MARKS = "\u3000-\u303f\u3040-\u309f\u30a0-\u30ff"
CJK_BLOCKS = CJK_MARKS + "\u4e00-\u9faf"
HAN, HIRA, KATA = r"\p{IsHan}", r"\p{IsHiragana}", r"\p{IsKatakana}"

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
# Characters that recognition confuses, and what each stands for.
LOOKALIKE = "口力二工八夕干才卜ヘべぺりー−–—‐杜殊"
LOOKALIKE_AS = "ロカニエハタチオトへベペリ一一一一一社株"
DIGIT_LIKE = "OoＯｏ〇○Il|ＩｌSｓ"
DIGIT_LIKE_AS = "0000001111155"
ZERO_ONE_LIKE, ZERO_ONE_AS = "OoｏＯ〇○IlＩｌ|", "00000011111"
DASHES = "ー−–—‐"

# Vocabularies that are no names of persons.
NON_PERSON_WORDS = (
    "確認|承知|了解|連絡|対応|添付|送付|返信|相談|報告|依頼|検討|作成|資料|画像|表示|設定|保存|編集|削除|検索|共有|通知|履歴|一覧|詳細|管理|運用|利用|契約|費用|電話|住所|至急|完了|開始|予定|"
    "午前|午後|重要|質問|回答|入力|変更|登録|選択|受付|申請|送信|受信|情報|項目|手順|操作|処理|氏名|名前|担当|責任|部署|総務|営業|社内|お疲れ|ご苦労|皆様|お客様|ユーザー|メンバー|ファイル|フォルダ|"
    "アカウント|プロジェクト|グループ|トーク|会議|チャット|チーム|チャンネル|ルーム|件名|ホーム|メニュー|カレンダー|スタンプ|システム|センター|ダウンロード|アップロード|オンライン|オフライン|プレミアム"
)
NON_PERSON_ENDING = "都|道|府|県|市|区|町|村|郡|駅|公園|空港|通り|会社|法人|工業|商事|製薬|電機|病院|銀行|大学|学校|研究所|事務所|製作所|支店|店舗|店|課|部|課長|部長|社長"
NON_PERSON_EXACT = (
    "皆|みな|客|神|仏|王|お疲れ|おつかれ|ご苦労|ごくろう|お世話|おせわ|利用者|管理者|参加者|申請者|契約者|代表者|担当者|本日|明日|昨日|未設定|未登録|未入力|不明|なし|無し|任意|必須|テスト|サンプル"
)
UI_WORDS = "home|menu|settings?|search|save|edit|delete|download|upload|profile|account|login|logout|password|email|name|next|back|cancel|submit|help|support|status|file|folder|project|notification|message|read|unread|online|offline|admin|user|bot"
SURNAME_COMPOUNDS = "原材料|原文|原稿|原理|原価|原因|原点|林檎|森林|林業|平野地形|高山地帯|清水湧水|小川沿い|小林製薬|山田電機"
# The 47 prefectures.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 "
    "兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
# Label words after which a new value begins.
VALUE_LABELS = "TEL|電話|Email|E-?mail|メール|住所|Address|氏名|名前|Name|生年月日|誕生日|口座番号|支店番号|顧客番号|社員番号|会員ID|ユーザーID|ログインID|パスワード|Password|PW|カード番号|有効期限"


def any_of(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


def trim_all(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{WS}]+|[{WS}]+\z", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, rf"[{WS}]+\z", "")


def half_width(s: Column) -> Column:
    """Full-width ASCII and the ideographic space to their narrow forms; the length stays."""
    return F.translate(s, WIDE, NARROW)


def half_width_line(s: Column) -> Column:
    """As :func:`half_width`, which looks up every character, but only for lines that hold a wide one. ``s`` should be a plain column."""
    wide = (F.octet_length(s) > F.length(s)) & s.rlike("[\uff01-\uff5e\u3000]")
    return F.when(wide, half_width(s)).otherwise(s)


def fold_lookalikes(s: Column) -> Column:
    return F.translate(s, LOOKALIKE, LOOKALIKE_AS)


def fold_digits(s: Column) -> Column:
    return F.translate(s, DIGIT_LIKE, DIGIT_LIKE_AS)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, ZERO_ONE_LIKE, ZERO_ONE_AS), "[^0-9]", "")


def has_cjk(s: Column) -> Column:
    return s.rlike(f"[{CJK}]")


def normalize_recognised(s: Column) -> Column:
    """Narrow forms; runs of spaces become one, none between two CJK characters and none at the start."""
    out = half_width(s)
    out = F.regexp_replace(out, rf"([{CJK}])[{SPACE}]++(?=[{CJK}])", "$1")
    return F.regexp_replace(F.regexp_replace(out, rf"[{SPACE}]++", " "), r"^ ", "")


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def characters(s: Column) -> Column:
    """The code points of a text as an array; none of an empty one."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def kept_spaces(s: Column, joins: str) -> Column:
    """As :func:`kept_places` with :func:`recognised_spaces`, by a few scans of the whole text: for each character whether it stays."""
    kinds = F.regexp_replace(F.regexp_replace(s, f"[^{joins}{SPACE}]", "x"), f"[{joins}&&[^{SPACE}]]", "j")
    gone = F.regexp_replace(kinds, f"^[{SPACE}]|(?<=[{SPACE}])[{SPACE}]|(?<=j)[{SPACE}](?=[{SPACE}]*+j)", "d")
    return F.transform(F.split(gone, ""), lambda k: k != "d")


def kept_places(s: Column, members: str, stays) -> Column:
    """For each character whether it stays, as an array: runs of the class ``members`` as ``stays(before, run, after)`` says, all others do.

    ``before`` and ``after`` are the neighbouring runs, null at the ends; ``stays`` gives the run's flags. Linear in the text.
    """
    def flags(runs: Column) -> Column:
        one = lambda r, i: F.when(r.rlike(f"^[{members}]"), stays(F.get(runs, i - 1), r, F.get(runs, i + 1))).otherwise(F.array_repeat(F.lit(True), F.length(r)))
        return F.flatten(F.transform(runs, one))

    return bound(F.regexp_extract_all(s, F.lit(f"[{members}]+|[^{members}]+"), F.lit(0)), flags)


def recognised_spaces(joins: str):
    """For :func:`kept_places`: of a run of spaces the first stays, unless it starts the line or has the class ``joins`` on both sides."""
    def stays(before: Column, run: Column, after: Column) -> Column:
        bridge = F.coalesce(F.right(before, F.lit(1)).rlike(f"[{joins}]") & F.left(after, F.lit(1)).rlike(f"[{joins}]"), F.lit(False))
        gone = F.array_repeat(F.lit(False), F.length(run) - 1)
        return F.concat(F.array(before.isNotNull() & ~bridge), gone)

    return stays


def normalized_map(s: Column) -> Column:
    """For each character of :func:`normalize_recognised` its place in ``s``.

    A space stays if it starts its run, follows something, and is not between two CJK characters.
    """
    stays = kept_places(half_width(s), SPACE, recognised_spaces(CJK))
    places = lambda flags: F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return bound(stays, places)


def original_range(index_map: Column, start: Column, end: Column) -> Column:
    """``struct(start, end)`` in the original text of a range of the normalised one; unchanged without a map."""
    last = F.size(index_map) - 1
    s = F.greatest(F.lit(0), F.least(start, last))
    e = F.greatest(s, F.least(end - 1, last))
    mapped = F.struct(F.try_element_at(index_map, s + 1).alias("start"), (F.try_element_at(index_map, e + 1) + 1).alias("end"))
    return F.when(last < 0, F.struct(start.alias("start"), end.alias("end"))).otherwise(mapped)


def join_cjk(s: Column) -> Column:
    """Without white space between two characters of the CJK blocks."""
    return F.regexp_replace(s, rf"([{CJK_BLOCKS}])[{WS}]+(?=[{CJK_BLOCKS}])", "$1")


def clean_export(s: Column) -> Column:
    """White space of exported text. The pair on both sides of a gap is consumed, so of adjacent gaps every other one stays."""
    out = F.regexp_replace(s, rf"([{CJK_BLOCKS}])[{WS}]+([{CJK_BLOCKS}])", "$1$2")
    out = F.regexp_replace(out, rf"[{WS}]*([:：])[{WS}]*", "$1 ")
    return trim_all(F.regexp_replace(out, "[ \t\u3000]{2,}", " "))


def search_fold(s: Column) -> Column:
    """For matching within a document: normalised, without white space, one dash, lower case."""
    return F.lower(F.translate(F.regexp_replace(normalize_recognised(s), rf"[{WS}]", ""), DASHES, "-----"))


def keyword_fold(s: Column) -> Column:
    """As :func:`search_fold`, with its spaces."""
    return F.lower(F.translate(normalize_recognised(s), DASHES, "-----"))


def trim_labelled(s: Column) -> Column:
    """A value ends at a bar, or at white space that another label with its colon follows."""
    out = F.regexp_replace(s, r"(?s)[|｜].*", "")
    return trim_end(F.regexp_replace(out, rf"(?isu)[{WS}]+(?=(?:{VALUE_LABELS})[{WS}]*[:：]).*", ""))


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i, 1).try_cast("int")


def is_my_number(s: Column) -> Column:
    """Twelve digits of which the last checks the others (weights 2-7 from the right, then 2-6; modulus 11)."""
    d = digits_only(s)
    weights = [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]
    rest = sum((_digit(d, i + 1) * w for i, w in enumerate(weights)), F.lit(0)) % 11
    check = F.when(rest <= 1, 0).otherwise(11 - rest)
    return F.coalesce(d.rlike(r"^\d{12}\z") & (check == _digit(d, 12)), F.lit(False))


def is_card_number(s: Column) -> Column:
    d = digits_only(s)
    return (F.length(d) == 16) & ~d.rlike(r"^(\d)\1+\z") & F.call_function("luhn_check", d)


def is_address_value(s: Column) -> Column:
    v = trim_all(half_width(s))
    # Words of forms and controls, and parts of addresses.
    control = "未設定|未登録|未入力|不明|なし|無し|入力|変更|登録|設定|保存|編集|削除|検索|確認|選択|こちら|任意|必須"
    place = any_of(*PREFECTURES) + "|[市区町村郡]|ビル|マンション|号室|丁目|番地"
    shape = v.rlike(place) | (v.rlike(r"\d") & v.rlike(rf"[A-Za-z{HAN}{KATA}]"))
    return F.length(v).between(2, 100) & ~v.rlike(f"^(?:{control})") & ~v.rlike("してください|できます|こちら|について") & shape


def has_address_structure(s: Column, block_number: bool) -> Column:
    place = F.regexp_extract(s, r"(?s)^([^0-9０-９]*)[0-9０-９]", 1)
    number = F.regexp_extract(s, r"(?s)^[^0-9０-９]*([0-9０-９].*)", 1)
    # Words of prose that no address has before its number.
    prose = "会議|会見|開催|資料|価格|販売|件数|更新|変更|確認|について|から|より"
    ok = (F.length(number) > 0) & place.rlike("[市区町村郡]") & ~place.rlike(prose) & ~number.rlike("^[0-9０-９]{4}年")
    return ok & number.rlike(rf"[0-9０-９][{WS}]*[-ー－丁目番地号]") if block_number else ok


def is_person_value(s: Column) -> Column:
    v = trim_all(F.regexp_replace(trim_all(s), rf"[（(][A-Za-z{WS}.'-]+[）)]\z", ""))
    c = F.regexp_replace(v, rf"[{WS}]", "")
    no = c.rlike(NON_PERSON_WORDS) | c.rlike(rf"^(?:{NON_PERSON_EXACT})\z") | c.rlike(rf"(?:{NON_PERSON_ENDING})\z") | c.rlike(rf"^(?:{SURNAME_COMPOUNDS})\z") | c.rlike(rf"(?i)^(?:{UI_WORDS})\z")
    yes = c.rlike(rf"^[{HAN}々]{{2,8}}\z") | c.rlike(rf"^[{HIRA}{KATA}ー・]{{2,12}}\z") | c.rlike(rf"^[{HAN}々]{{1,4}}[{HIRA}{KATA}ー]{{1,4}}\z") | v.rlike(rf"^[A-Za-z][A-Za-z.'-]*(?:[{WS}]+[A-Za-z][A-Za-z.'-]*){{0,3}}\z")
    return F.length(c).between(2, 24) & ~no & yes
