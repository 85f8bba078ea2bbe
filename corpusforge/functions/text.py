"""Text functions as column expressions: cleaning steps, validity, keys, clipping, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .phrases import converted

#: White space as Unicode has it; Java's own class is ASCII only.
SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"

# Fixed patterns of the cleaning steps, in their order.
HTML_TAG = r"<[^>]{1,200}>"
ENTITY = r"&[a-zA-Z]{2,8};|&#[0-9]{2,6};"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+|[{WORD}]+\.(?:com|cn|net|org)/[^{SPACE}]*"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.]+"
MENTION = rf"@[{WORD}\-.]{{1,30}}"
TOPIC = rf"#([^#{SPACE}]{{1,30}})#?"
BRACKET = r"\[[^\[\]]{1,12}\]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{FE0F}]"
META = rf"人均[{SPACE}]*[¥￥]?[{SPACE}]*[0-9]+[{SPACE}]*元?|推荐菜[{SPACE}]*[:：][{SPACE}]*[^{SPACE}，,。]{{1,20}}|图片数[{SPACE}]*[:：]?[{SPACE}]*[0-9]+|[0-9]+[{SPACE}]*张图片|通过.{{0,6}}消费"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]"
REPEAT = r"(?s)([^\n])\1{6,}"
NOT_KEPT = r"[^\x{4e00}-\x{9fff}\x{3040}-\x{30ff}a-zA-Z0-9]"
KEPT = NOT_KEPT.replace("[^", "[")
HAN = r"[\x{4e00}-\x{9fff}]"
WIDE = r"[\x{3000}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]"
STRIP = " 　.,;:!?~-—·、，。；：！？|/\\"
FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ　"
HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz "
# Fixed words of advertisements.
AD_WORDS = ("加微信", "微信号", "加群", "代购", "私聊", "点击链接", "扫码", "优惠券", "免费领取", "兼职", "刷单", "V信", "QQ群", "出售", "低价出")
# Fixed labels and levels.
POSITIVE, NEGATIVE, NEUTRAL, UNCLEAR = "正面", "负面", "中性", "无法判断"
LEVELS = {"超预期": (POSITIVE, 50), "很棒": (POSITIVE, 50), "满意": (POSITIVE, 40), "不错": (POSITIVE, 40), "一般": (NEUTRAL, 30), "差": (NEGATIVE, 20), "不满意": (NEGATIVE, 10), "": (UNCLEAR, 0)}


@dataclass(frozen=True)
class Profile:
    """Parameters of a cleaning run."""

    least: int = 4
    most: int | None = None  # longer texts are invalid; None: they are clipped instead
    clip: int = 500
    bare_numbers: bool = True
    metadata: bool = True
    ads: tuple[str, ...] = AD_WORDS
    steps: tuple[str, ...] = field(default=("newline", "markup", "links", "topic", "bracket", "emoji", "metadata", "control", "nfc", "half", "space", "squash", "strip"))


SITE_REVIEW = Profile()
SHORT_COMMENT = Profile(least=2, most=400, bare_numbers=False, metadata=False, ads=(*AD_WORDS[:13], "广告", *AD_WORDS[13:]))


def nfc(c: Column) -> Column:
    """Unicode NFC; Spark has no such function."""

    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(normal, StringType())(c)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def guarded(c: Column, marks: str | list[str], f: Callable[[Column], Column]) -> Column:
    """f where the text has one of the marks (a list, or parted by white space) that its pattern needs; most texts have none."""
    hit = lambda x: reduce(lambda p, q: p | q, [F.contains(x, F.lit(m)) for m in (marks.split() if isinstance(marks, str) else marks)])
    return once(c, lambda x: F.when(hit(x), f(x)).otherwise(x))


def ascii_apart(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of the texts that have more than ASCII; the others have nothing that f would change."""
    return once(c, lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(f(x)))


def within(least: str, most: str, pattern: str) -> str:
    """A class that lies between two code points, asked for them first: most characters fail at one comparison, not at every range of the class."""
    return rf"[\x{{{least}}}-\x{{{most}}}&&{pattern}]"


def step(name: str, c: Column, profile: Profile = SITE_REVIEW) -> Column:
    """One cleaning step."""
    r = F.regexp_replace
    if name == "newline":
        return guarded(c, ["\r"], lambda x: r(x, r"\r\n?", "\n"))
    if name == "markup":
        return guarded(guarded(c, "<", lambda x: r(x, HTML_TAG, " ")), "&", lambda x: r(x, ENTITY, " "))
    if name == "links":
        links = guarded(c, "/ www.", lambda x: r(x, URL, " "))
        return guarded(links, "@", lambda x: r(r(x, EMAIL, " "), MENTION, " "))
    if name == "topic":
        return guarded(c, "#", lambda x: r(x, TOPIC, "$1"))
    if name == "bracket":
        return guarded(c, "[", lambda x: r(x, BRACKET, " "))
    if name == "emoji":
        return ascii_apart(c, lambda x: r(x, within("2190", "1FAFF", EMOJI), " "))
    if name == "metadata":
        return guarded(c, "人均 推荐菜 图片 通过", lambda x: r(x, META, " ")) if profile.metadata else c
    if name == "control":
        odd = lambda x: x.rlike(r"\p{Cntrl}(?<![\t\n\r])") | ((F.octet_length(x) != F.length(x)) & x.rlike(within("200b", "feff", CONTROL)))
        return once(c, lambda x: F.when(odd(x), r(x, CONTROL, "")).otherwise(x))
    if name == "nfc":
        return nfc(c)
    if name == "half":
        return ascii_apart(c, lambda x: F.when(x.rlike(within("3000", "ff5a", WIDE)), F.translate(x, FULL, HALF)).otherwise(x))
    if name == "space":
        # All white space is made plain, by plain replacements where it is ASCII; then only runs are left to match.
        narrow = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(" ")), "\t\n\x0b\f\r", c)
        plain = ascii_apart(narrow, lambda x: r(x, within("85", "3000", f"[{SPACE}]"), " "))
        return F.trim(guarded(plain, ["  "], lambda x: r(x, " {2,}", " ")))
    if name == "squash":
        return r(c, REPEAT, "$1$1$1")
    if name == "strip":
        return F.btrim(c, F.lit(STRIP))
    raise ValueError(name)


def clean(c: Column, profile: Profile = SITE_REVIEW, without: tuple[str, ...] = (), phrases: dict[str, str] | None = None) -> Column:
    """All steps in order; null is the empty text. With a table of phrases, texts with Han characters are converted by it at the end."""
    out = reduce(lambda x, s: step(s, x, profile), [s for s in profile.steps if s not in without], F.coalesce(c, F.lit("")))
    return converted(out, phrases) if phrases else out


def kept(c: Column) -> Column:
    """How many characters are kept. Their runs are deleted and the rest is counted: a search that ends at every other letter costs several times as much."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{KEPT}+", ""))


def keep_ratio(c: Column) -> Column:
    return kept(c) / F.greatest(F.length(c), F.lit(1))


def keeps_less(c: Column, share: float) -> Column:
    """Whether the ratio is under the share. Where the first quarter alone has enough kept characters for the whole text, that is certain; else all are counted."""

    def less(x: Column) -> Column:
        head = kept(F.left(x, F.ceil(F.length(x) / 4).cast("int"))) / F.greatest(F.length(x), F.lit(1))
        return F.when(head >= share, F.lit(False)).otherwise(keep_ratio(x) < share)

    return once(c, less)


def invalid_reason(c: Column, profile: Profile = SITE_REVIEW) -> Column:
    """The first rule that a cleaned text breaks, or null."""
    out = F.when(F.length(c) < profile.least, F.lit("too_short"))
    if profile.most:
        out = out.when(F.length(c) > profile.most, F.lit("too_long"))
    no_words = (F.length(c) > 0) & ~c.rlike(r"\p{L}")  # ends at the first letter
    out = out.when(no_words, F.lit("digits_or_symbol_only")).when(keeps_less(c, 0.15), F.lit("punctuation_dominant"))
    # Every advertisement word has a Han character, so most texts need no search; the others are lower-cased once.
    found = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w.lower())) for w in profile.ads])
    han = (F.octet_length(c) != F.length(c)) & c.rlike(HAN) if all(any("\u4e00" <= x <= "\u9fff" for x in w) for w in profile.ads) else F.lit(True)
    return out.when(han & once(F.lower(c), found), F.lit("advertisement"))


def dedup_key(c: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(c, F.lit(f"{KEPT}+"), F.lit(0)), ""))


def clip(c: Column, most: int = 500) -> Column:
    """Cut at the last sentence mark, tried in a fixed order, that leaves at least 0.6 of the length."""

    def cut(head: Column) -> Column:
        out = None
        for mark in "。！？，； ":
            found = F.instr(F.reverse(head), mark)
            at = F.lit(most) - found  # zero-based place of the last mark
            ok = (found > 0) & (at >= 0.6 * most)
            part = F.left(head, (at + 1).cast("int"))
            out = F.when(ok, part) if out is None else out.when(ok, part)
        return out.otherwise(head)

    return once(c, lambda x: F.when(F.length(x) <= most, x).otherwise(once(F.left(x, F.lit(most)), cut)))


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by U+0001, its first 16 digits; null parts are empty."""
    return F.substring(F.md5(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def star_label(star: Column) -> Column:
    """Weak label of a star value 10 to 50, rounded half to even; what is not a number cannot be judged."""
    n = F.bround(star.try_cast("double"), 0)
    return F.when(n >= 40, POSITIVE).when(n == 30, NEUTRAL).when(n.isin(10, 20), NEGATIVE).otherwise(UNCLEAR)


def level_label(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v[0])])[level], F.lit(UNCLEAR))


def level_star(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v[1])])[level]


def binary_label(label: Column) -> Column:
    return F.when(label == POSITIVE, 1).when(label == NEGATIVE, 0)


def lexicon_label(c: Column, positive: list[str], negative: list[str], names: tuple[str, str, str] = (POSITIVE, NEGATIVE, NEUTRAL)) -> Column:
    """More distinct positive or negative words found as substrings; a tie is neutral (P20)."""
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))
    p, n = hits(positive), hits(negative)
    return F.when(p > n, names[0]).when(n > p, names[1]).otherwise(names[2])


def silver_label(weak: Column, lexicon: Column) -> Column:
    return F.when(weak.isin(POSITIVE, NEGATIVE, NEUTRAL), weak).otherwise(lexicon)


def site_b_content(c: Column) -> Column:
    """Lines split at bars, platform tags dropped, joined with spaces."""
    tags = (
        r"[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2})?月?出行.*$|通过.{0,8}消费|^[¥￥][ \t]*[0-9]+[ \t]*元?$|^[0-9]{4}-[0-9]{1,2}月?$|^游玩.{0,8}小时$|^[^｜|\n]{1,6}(?:夫妻|亲子|情侣|朋友|独自|家庭|商务)$"
    )
    faces = F.regexp_replace(step("newline", F.coalesce(c, F.lit(""))), BRACKET, " ")
    parts = F.transform(F.split(faces, r"[\n｜|]"), lambda x: trimmed(F.regexp_replace(trimmed(x), tags, " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), " ")


def human_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB (T20); halves go to the even digit."""
    short = lambda size, unit: F.format_string(f"%.1f {unit}", F.bround(n / size, 1))
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, short(1024, "KB")).otherwise(short(1 << 20, "MB"))


def markdown_cell(c: Column) -> Column:
    return F.coalesce(F.replace(F.regexp_replace(c.cast("string"), r"\r?\n", " "), F.lit("|"), F.lit("/")), F.lit(""))


def latin_tokens(c: Column) -> Column:
    """Lower case, marks deleted, split at white space."""
    return F.filter(F.split(F.translate(F.lower(c), ".,!?'\"", ""), r"\s+"), lambda x: x != "")


def local_time(ms: Column) -> Column:
    """Epoch milliseconds as text in the session's zone; what is no number is empty."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


#: The shorter set of marks stripped at both ends (fixed).
STRIP_MARKS = " 　.,;:!?~-—·、，。；：！？"


def missing(c: Column) -> Column:
    """Whether a text is null, empty or white space of any kind."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "") == ""


def star_label_truncated(c: Column) -> Column:
    """The star rule that cuts decimals off and leaves a blank star without a label (P17's variant)."""
    n = c.try_cast("double")
    whole = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))
    label = F.when(whole >= 40, "正面").when(whole == 30, "中性").when(whole.isin(10, 20), "负面").otherwise("无法判断")
    return F.when(c.isNull() | (F.trim(c) == ""), "").otherwise(label)


def simplified(c: Column, pairs: dict[str, str]) -> Column:
    """Characters replaced by a given table, only in texts with Han characters (T11); the table is the caller's."""
    return F.when(c.rlike(r"[\x{4e00}-\x{9fff}]"), F.translate(c, "".join(pairs), "".join(pairs.values()))).otherwise(c)


def now_text(zone: str = "UTC") -> Column:
    """The present time as a report's head has it."""
    return F.date_format(F.convert_timezone(None, F.lit(zone), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")
