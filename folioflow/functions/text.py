"""Text functions as column expressions; Arrow functions only where the JVM has none.

Null text counts as empty unless a function says otherwise. Character classes
are spelt out, because Java's, Python's and DuckDB's shorthands differ.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and words of printed Chinese exercise pages.
QUESTION_TERMINAL = "(?:[？?]|(?:求|请问|问|计算|证明|判断|是否|多少|几(?:个|名|种|枚|本|次)?)[^。！!?？\\n]{0,48}[。！!.])"
QUESTION_START = "(?iu)(?:[【\\[(（]?(?:例题|例|练习)\\s*[0-9S]+[】\\])）]?|列\\s*[0-9S]+\\s*[、.．]|(?:^|\\n)\\s*[1-9][0-9]?\\s*[、.．])"
TITLE = "(?iu)^[【\\[(（]?((?:例题|练习)\\s*([0-9S]+)|第\\s*([0-9]+)\\s*题)[】\\]）)]?\\s*"
NUMBER = "\\p{Nd}+(?::\\p{Nd}+)?"
ELLIPSIS = "(?:[.…⋯·•]{2,}|…)"
SUSPICIOUS_PUNCTUATION = "[·•]|、\\s*[，,]\\s*那么"
PUNCTUATION = "[\\s·•…⋯.．。,，、]"
UNCATEGORIZED = "未分类"
REASON_NO_NUMBER = "未定位到印刷题号"
REASON_NO_QUESTION_MARK = "未定位到题干问号"
REASON_TITLE = "题号格式未可靠恢复"
REASON_NUMBERS = "双 OCR 数字或比例不一致"
REASON_SHORT = "重建题干过短"
NAMELESS_TITLE = "【题目】"
RELIABLE_SIMILARITY = 0.82
SHORT_BODY = 12

HANZI = "一-鿿"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """`body(value)` with the value evaluated once, and no more generated code for each of its uses."""
    return F.transform(F.array(value), body)[0]


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Spark has no built-in for it. Null stays null. Texts in ASCII go to Python as nulls, so their bytes stay in the JVM."""
    plain = c.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, c).otherwise(_nfkc(F.when(~plain, c)))


def content_fingerprint(text: Column, figure: Column | None = None) -> Column:
    """SHA-256 of the NFKC-folded letters and digits of a text, a bar, and the figure kind (blank: "none")."""
    kind = F.lower(F.trim(text_of(figure))) if figure is not None else F.lit("")
    letters = F.regexp_replace(F.lower(nfkc(text_of(text))), r"[^\p{L}\p{N}]+", "")
    return F.sha2(F.concat(letters, F.lit("|"), F.when(kind == "", "none").otherwise(kind)), 256)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone, as embedded databases compare with LIKE."""
    return F.translate(c, _UPPER, _LOWER)


def contains_ascii_folded(c: Column, needle: str) -> Column:
    """Substring search that folds only ASCII case; the needle's %, _ and \\ are plain characters."""
    return F.contains(ascii_lower(text_of(c)), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def safe_relative_path(c: Column) -> Column:
    """Slashes for backslashes, without empty, "." and ".." parts; the last 500 characters."""
    parts = F.filter(F.split(F.replace(text_of(c), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.right(F.array_join(parts, "/"), F.lit(500))


def compact(c: Column) -> Column:
    """Without white space, Unicode's included."""
    return F.regexp_replace(text_of(c), r"(?U)\s+", "")


def numbers(c: Column) -> Column:
    """Numerals and ratios in order, repeats kept."""
    return F.regexp_extract_all(text_of(c), F.lit(NUMBER), 0)


def normalize_for_compare(c: Column) -> Column:
    return F.lower(F.regexp_replace(text_of(c), f"[^{HANZI}A-Za-z0-9]", ""))


def meaningful_length(c: Column) -> Column:
    return F.length(F.regexp_replace(text_of(c), f"[^{HANZI}A-Za-z0-9]", ""))


def hanzi_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(f"[{HANZI}]"))


def match_start(c: Column, pattern: str) -> Column:
    """0-based start of the first match, -1 without one."""
    return F.regexp_instr(text_of(c), F.lit(pattern)) - 1


def match_end(c: Column, pattern: str) -> Column:
    """0-based end of the first match, -1 without one."""
    return F.when(match_start(c, pattern) < 0, -1).otherwise(match_start(c, pattern) + F.length(F.regexp_substr(text_of(c), F.lit(pattern))))


def has_terminal(c: Column) -> Column:
    return text_of(c).rlike(QUESTION_TERMINAL)


def cut_at_terminal(c: Column) -> Column:
    """Up to the end of the first question mark or closing request; whole without one."""
    end = match_end(c, QUESTION_TERMINAL)
    return F.when(end < 0, text_of(c)).otherwise(F.substr(text_of(c), F.lit(1), end))


def question_fragment(c: Column, hint: Column | None = None) -> Column:
    """The question's span as struct<fragment, reasons>: from the printed number (or behind it, after a hint) to the terminal, on one line."""
    none = F.array().cast("array<string>")

    def cut(v: Column) -> Column:
        text, h, start, end = v["t"], v["h"], v["a"], v["b"]
        hinted = h != ""
        return (
            F.when((start < 0) & hinted & (F.trim(text) != ""), F.concat(h, F.lit(" "), F.trim(text)))
            .when(start < 0, F.lit(None).cast("string"))
            .when(hinted, F.concat(h, F.lit(" "), F.substr(text, end + 1)))
            .otherwise(F.substr(text, start + 1))
        )

    def tidy(raw: Column) -> Column:
        line = F.trim(F.regexp_replace(F.regexp_replace(cut_at_terminal(raw), r"[ \t]+", " "), r"\s*\n\s*", ""))
        reasons = F.when(raw.isNull(), F.array(F.lit(REASON_NO_NUMBER))).when(~has_terminal(raw), F.array(F.lit(REASON_NO_QUESTION_MARK))).otherwise(none)
        return F.struct(F.when(raw.isNull(), "").otherwise(line).alias("fragment"), reasons.alias("reasons"))

    found = F.struct(text_of(c).alias("t"), (text_of(hint) if hint is not None else F.lit("")).alias("h"), match_start(c, QUESTION_START).alias("a"), match_end(c, QUESTION_START).alias("b"))
    return let(let(found, cut), tidy)


def figure_kind(body: Column) -> Column:
    t = compact(body)
    return (
        F.when(t.contains("三个圆圈") & (t.contains("交叠") | t.contains("重叠")), "three_overlapping_circles")
        .when(t.contains("地图") & t.contains("五个国家"), "five_country_map")
        .when(t.rlike("2[×xX*]10方格"), "grid_2x10")
        .otherwise("none")
    )


def figure_needed(c: Column) -> Column:
    return text_of(c).rlike("如图|见下图|图中|方格图|地图")


def canonical_ellipsis(c: Column) -> Column:
    return F.regexp_replace(text_of(c), ELLIPSIS, "……")


def punctuation_candidate(text: Column, confidence: Column, alternatives: Column) -> Column:
    """The primary reading, or the first alternative that has the ellipsis which the primary seems to have lost.

    `alternatives` is array<struct<text, confidence>>; one counts at a confidence
    of at least the primary's less 0.08 and with the same characters besides punctuation.
    """
    skeleton = F.regexp_replace(text_of(text), PUNCTUATION, "")
    fit = F.filter(
        F.coalesce(alternatives, F.array().cast("array<struct<text:string,confidence:double>>")),
        lambda a: text_of(a["text"]).rlike(ELLIPSIS) & (F.coalesce(a["confidence"], F.lit(0.0)) >= F.coalesce(confidence, F.lit(0.0)) - 0.08) & (F.regexp_replace(text_of(a["text"]), PUNCTUATION, "") == skeleton),
    )
    other = F.get(fit, F.lit(0))["text"]
    return F.when(text_of(text).rlike(ELLIPSIS), canonical_ellipsis(text)).when(text_of(text).rlike(SUSPICIOUS_PUNCTUATION) & other.isNotNull(), canonical_ellipsis(other)).otherwise(text_of(text))


def ocr_candidate_score(c: Column) -> Column:
    """What the better reading has more of, in order: a question mark, distinct numbers, ellipsis rather than bullet."""
    t = text_of(c)
    dots = F.when(t.rlike(r"(?:……|⋯|\.{3,})"), 1).when(t.rlike("[·•]"), -1).otherwise(0)
    return F.struct(F.when(t.rlike("[？?]"), 1).otherwise(0).alias("question"), F.size(F.array_distinct(numbers(t))).alias("numbers"), dots.alias("ellipsis"))


def lenient_json(c: Column) -> Column:
    """The text as JSON, or else its first to last brace; null if neither parses."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(text_of(c), r"(?s)\{.*\}", 0)))


def normalize_category(c: Column) -> Column:
    t = F.left(F.regexp_replace(text_of(c), f"[^{HANZI}A-Za-z0-9·]", ""), F.lit(12))
    return F.when(t == "", UNCATEGORIZED).otherwise(t)


def normalized_name(c: Column, longest: int) -> Column:
    """An NFKC-folded, trimmed name; null where it is empty, too long, reserved, or has control characters or slashes."""
    t = F.regexp_replace(nfkc(text_of(c)), r"(?U)^\s+|\s+$", "")
    ok = (F.length(t) > 0) & (F.length(t) <= longest) & ~t.rlike(r"[\x00-\x1f/\\]") & (t != UNCATEGORIZED)
    return F.when(ok, t)


def anchor_id(*parts: Column) -> Column:
    """A link target from parts joined by the unit separator."""
    return F.concat(F.lit("mb-"), F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(16)))


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"([\\`*_\[\]<>])", r"\\$1")


def wikilink_alias(c: Column) -> Column:
    return F.translate(text_of(c), "|]#\n\r", "｜］＃  ")


def safe_name_part(c: Column) -> Column:
    t = F.regexp_replace(nfkc(text_of(c)), r'[\x00-\x1f\x7f/\\:*?"<>|]+', "-")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", ""), "-+", "-")
    t = F.regexp_replace(t, r"^[-. ]+|[-. ]+$", "")
    return F.when(t == "", UNCATEGORIZED).otherwise(t)


def trim_utf8(c: Column, most: int) -> Column:
    """The longest beginning of at most `most` bytes, without trailing -, _, . and spaces."""
    fits = F.filter(F.sequence(F.lit(0), F.length(c)), lambda n: F.octet_length(F.substr(c, F.lit(1), n)) <= most)
    return F.regexp_replace(F.substr(c, F.lit(1), F.array_max(fits)), r"[-_. ]+$", "")


def attachment_name(problem_id: Column, index: Column, suffix: str = ".png") -> Column:
    return F.concat(F.lit("resource-"), F.regexp_replace(problem_id, "[^A-Za-z0-9_-]", ""), F.lit("-"), F.format_string("%02d", index), F.lit(suffix))


def country_labels(c: Column) -> Column:
    """Letters listed after 国家 or 区域, in order, each once."""
    listed = F.regexp_extract(text_of(c), r"(?:国家|区域)[^A-Za-z。！？!?]{0,12}((?:[A-Z][、,，和\s]*)+)", 1)
    return F.array_distinct(F.regexp_extract_all(listed, F.lit("[A-Z]"), 0))


def display_title(structured: Column, text: Column, number: Column, longest: int = 30) -> Column:
    """A problem's title: the structured one unless nameless, else a leading 【…】, else its number."""
    found = F.regexp_extract(text_of(text), rf"^\s*(【[^】]{{1,{longest}}}】)", 1)
    return F.coalesce(F.when((structured != "") & (structured != NAMELESS_TITLE), structured), F.when(found != "", found), F.concat(F.lit("题目 "), number.cast("string")))


def legacy_category(c: Column) -> Column:
    """struct<group, key> for the names of an earlier one-level scheme."""
    from folioflow.operators.classify import TAXONOMY

    v = F.trim(text_of(c))
    key = F.substr(v, F.lit(4))
    counting = F.struct(F.lit("计数").alias("group"), F.when(key.isin(list(TAXONOMY["计数"])), key).otherwise("计数综合").alias("key"))
    # Earlier names and where they belong now.
    known = {"抽屉原理": ("组合", "抽屉原理"), "比例问题": ("应用", "比例问题"), "应用题": ("应用", "应用题"), "数论问题": ("数论", "数论综合"), "几何问题": ("几何", "几何综合"), "行程问题": ("行程", "行程综合"), "计数问题": ("计数", "计数综合")}
    pair = lambda g, k: F.struct(F.lit(g).alias("group"), F.lit(k).alias("key"))
    out = F.when(v.startswith("计数·"), counting)
    for name, (g, k) in known.items():
        out = out.when(v == name, pair(g, k))
    return out.otherwise(pair(UNCATEGORIZED, UNCATEGORIZED))


def formula_id(crop: Column, x0: Column, y0: Column) -> Column:
    """A formula's name from its picture's bytes and place."""
    return F.concat(F.lit("formula-"), F.left(F.sha2(crop, 256), F.lit(12)), F.lit("-"), x0.cast("string"), F.lit("-"), y0.cast("string"))


@F.pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON with sorted keys and one space behind each comma and colon, non-ASCII letters as they are; null where it can't be read."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True)
        except ValueError:
            return None

    return s.map(one)


def wrapped(c: Column, width_of, most: float | Column) -> Column:
    """Lines of at most `most` wide, broken between any two characters; a wider character has a line of its own, and empty lines go.

    `width_of` gives a character's width as a column.
    """
    limit = F.lit(most).cast("double") if not isinstance(most, Column) else most.cast("double")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("line"), F.lit(0.0).alias("wide"))
    flushed = lambda s: F.when(s["line"] != "", F.concat(s["out"], F.array(s["line"]))).otherwise(s["out"])

    def step(s: Column, ch: Column) -> Column:
        w = width_of(ch).cast("double")
        turn = (s["line"] != "") & (s["wide"] + w > limit)
        grown = F.struct(s["out"].alias("out"), F.concat(s["line"], ch).alias("line"), (s["wide"] + w).alias("wide"))
        return F.when(ch == "\n", F.struct(flushed(s).alias("out"), F.lit("").alias("line"), F.lit(0.0).alias("wide"))).when(turn, F.struct(flushed(s).alias("out"), ch.alias("line"), w.alias("wide"))).otherwise(grown)

    return F.aggregate(F.filter(F.split(text_of(c), ""), lambda ch: ch != ""), start, step, flushed)


def display_width(ch: Column) -> Column:
    """2 for wide characters (Chinese, full-width forms), 1 for others."""
    return F.when(ch.rlike("[\\u1100-\\u115F\\u2E80-\\uA4CF\\uAC00-\\uD7A3\\uF900-\\uFAFF\\uFE30-\\uFE6F\\uFF00-\\uFF60\\uFFE0-\\uFFE6]"), 2).otherwise(1)
