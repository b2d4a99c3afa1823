"""Text, agreement and classification on literal cases."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import similarity as S
from folioflow.functions import text as T
from folioflow.operators import classify as K


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def texts(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_fingerprint_folds_form_case_and_signs(spark):
    a, b, c, d, e = texts(spark, ["【例题 8】 共有多少种？", "[例题8]共有多少种?", "İ ﬁ Ⅷ ２×１０", None, ""], T.content_fingerprint(F.col("t")))
    assert a == b and d == e and len({a, c, d}) == 3
    f, g = (one(spark, T.content_fingerprint(F.lit("x"), F.lit(k))) for k in ("grid_2x10", " none "))
    assert f != g == one(spark, T.content_fingerprint(F.lit("X!")))


def test_fingerprint_matches_python(spark):
    import hashlib
    import re

    cases = ["ﬁ Ａ１ ß", "é É", "a_b-c", "हिन्दी", "１２３"]
    want = [hashlib.sha256((re.sub(r"[\s\W_]+", "", unicodedata.normalize("NFKC", c).lower()) + "|none").encode()).hexdigest() for c in cases if "हि" not in c]
    assert [x for x, c in zip(texts(spark, cases, T.content_fingerprint(F.col("t"))), cases, strict=True) if "हि" not in c] == want


def test_substring_search_folds_ascii_alone(spark):
    found = texts(spark, ["ABC%", "abc", "É", "a\\_", None], T.contains_ascii_folded(F.col("t"), "aBc%"))
    assert found == [True, False, False, False, False]
    assert texts(spark, ["É", "é"], T.contains_ascii_folded(F.col("t"), "É")) == [True, False]


def test_paths_lose_climbing_and_keep_their_end(spark):
    assert texts(spark, ["..\\a/./b//c", "", None, "x" * 600], T.safe_relative_path(F.col("t"))) == ["a/b/c", "", "", "x" * 500]


def test_fragment_runs_from_number_to_terminal(spark):
    out = texts(spark, ["页眉 例题10 小明有多少\n个？ 求解", "没有题号", "1、abc", None], T.question_fragment(F.col("t")))
    assert out[0]["fragment"] == "例题10 小明有多少个？" and out[0]["reasons"] == []
    assert out[1] == ("", [T.REASON_NO_NUMBER]) and out[3] == ("", [T.REASON_NO_NUMBER])
    assert out[2]["reasons"] == [T.REASON_NO_QUESTION_MARK]
    hinted = texts(spark, ["1、火车长190米，求速度。尾", "火车？"], T.question_fragment(F.col("t"), F.lit("【第1题】")))
    assert hinted[0]["fragment"] == "【第1题】 火车长190米，求速度。" and hinted[1]["fragment"] == "【第1题】 火车？"


@pytest.mark.parametrize(("text", "kind"), [("三个圆圈互相交叠", "three_overlapping_circles"), ("地图上五个国家", "five_country_map"), ("2 × 10 方格", "grid_2x10"), ("别的", "none")])
def test_figure_kind(spark, text, kind):
    assert one(spark, T.figure_kind(F.lit(text))) == kind


def test_ellipsis_comes_back_from_a_like_alternative(spark):
    def chosen(primary, *alternatives, confidence=0.82):
        alts = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in alternatives]) if alternatives else F.lit(None).cast("array<struct<text:string,confidence:double>>")
        return one(spark, T.punctuation_candidate(F.lit(primary), F.lit(confidence), alts))

    assert chosen("13、 •，那么多", ("13、……，那么多", 0.80)) == "13、……，那么多"
    assert chosen("13、...，那么") == "13、……，那么"
    assert chosen("13、 •，那么", ("14、……，那么", 0.80)) == "13、 •，那么"
    assert chosen("13、 •，那么", ("13、……，那么", 0.70)) == "13、 •，那么"
    better, worse = (one(spark, T.ocr_candidate_score(F.lit(t))) for t in ("1、……？", "1、•？"))
    assert tuple(better) > tuple(worse)


def test_small_scalars(spark):
    assert one(spark, T.numbers(F.lit("37:25 和 ３7 7"))) == ["37:25", "３7", "7"]
    assert one(spark, T.normalize_category(F.lit("  "))) == T.UNCATEGORIZED
    assert one(spark, T.normalized_name(F.lit(" ＡＢ "), 12)) == "AB"
    assert texts(spark, ["a/b", "未分类", "", "x" * 13, "题型１２"], T.normalized_name(F.col("t"), 12)) == [None, None, None, None, "题型12"]
    assert one(spark, T.escape_markdown(F.lit("a*b_[c]\\"))) == "a\\*b\\_\\[c\\]\\\\"
    assert one(spark, T.wikilink_alias(F.lit("a|b]#\n"))) == "a｜b］＃ "
    assert one(spark, T.trim_utf8(F.lit("计数-组合"), 7)) == "计数"
    assert one(spark, T.safe_name_part(F.lit(" a/b: c "))) == "a-b-c"
    assert one(spark, T.attachment_name(F.lit("a b/1"), F.lit(3))) == "resource-ab1-03.png"
    assert one(spark, T.country_labels(F.lit("五个国家A、B、C和B的地图"))) == ["A", "B", "C"]
    assert texts(spark, ['{"a":1}', 'x {"a":2} y', "no"], T.lenient_json(F.col("t")).cast("string")) == ['{"a":1}', '{"a":2}', None]
    assert tuple(one(spark, T.legacy_category(F.lit("计数·数位进位")))) == ("计数", "数位进位")


def structured(spark, primary, secondary="", hint=None):
    df = spark.createDataFrame([(primary, secondary, hint)], "p string, s string, h string")
    return df.select(S.structured_problem(F.col("p"), F.col("s"), F.col("h")).alias("x")).first()["x"]


def test_two_readings_conflict_only_when_alike(spark):
    text = "例题1 小明用去22元，小红比小明多用了三分之一，问小红一共用去多少元？"
    assert T.REASON_NUMBERS in structured(spark, text, text.replace("22", "27"))["review_reasons"]
    unlike = structured(spark, text, "例题1 别的10？")
    assert unlike["text_similarity"] < 0.82 and T.REASON_NUMBERS not in unlike["review_reasons"]


def test_structured_title_body_and_figure(spark):
    s = structured(spark, "页眉\n【例题S】 三个圆圈互相交叠，七个区域染色，共有多少种方法？\n草稿")
    assert (s["title"], s["figure"], s["review_reasons"]) == ("【例题5】", "three_overlapping_circles", [])
    assert s["body"].startswith("三个圆圈") and s["body"].endswith("？")
    s = structured(spark, "1、火车长190米，每秒行20米，多少秒通过大桥？", hint="【第1题】")
    assert s["title"] == "【第1题】" and s["body"].startswith("火车长190米")
    assert structured(spark, "无")["title"] == T.NAMELESS_TITLE


def test_ratio_is_difflibs(spark):
    import difflib

    pairs = [("abcd", "bcde"), ("", "a"), ("ab" * 150, "ba" * 140), ("x", "x")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", S.matching_ratios("a", "b")["ratio"].alias("r")).collect()
    assert [r["r"] for r in sorted(rows)] == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


@pytest.mark.parametrize(
    ("text", "group", "category"),
    [("与456相加至少发生一次进位", "计数", "数位进位"), ("三个圆的七个区域有多少种染色方法", "计数", "染色问题"), ("至少有多少列的颜色完全相同", "组合", "抽屉原理"), ("原来钱数之比是37比25", "应用", "比例问题")],
)
def test_rules_classify(spark, text, group, category):
    c = one(spark, K.classify_by_rules(F.lit(text)))
    assert (c["group"], c["category"]) == (group, category) and c["confidence"] >= 0.75 and c["reasons"] == []


def test_rules_know_when_they_dont(spark):
    c = one(spark, K.classify_by_rules(F.lit("求下面问题的结果")))
    assert (c["group"], c["confidence"], c["reasons"]) == (T.UNCATEGORIZED, 0.0, [K.REASON_UNSTABLE])
    allowed = {"计数": ("数位进位",), "组合": ("抽屉原理",)}
    assert one(spark, K.classify_by_rules(F.lit("有多少种染色方法"), allowed=allowed))["category"] == T.UNCATEGORIZED
    assert one(spark, K.classify_by_rules(F.lit("x"), allowed={"a": ()}))["reasons"] == [K.REASON_NO_RULES]
    assert one(spark, K.classify_by_rules(F.lit(None).cast("string")))["category"] == T.UNCATEGORIZED


def test_cascade_takes_a_surer_model(spark):
    df = spark.createDataFrame([(1, "求结果"), (2, "染色"), (3, "求结果")], "id int, t string")
    said = spark.createDataFrame([(1, "g", "m", 0.9), (2, "g", "m", 0.9), (3, "g", "m", 0.01)], "id int, group string, category string, confidence double")
    got = {r["id"]: r["classification"]["category"] for r in K.cascade(df, "id", "t", said).collect()}
    assert got == {1: "m", 2: "m", 3: T.UNCATEGORIZED} or got == {1: "m", 2: "染色问题", 3: T.UNCATEGORIZED}


def test_confidence_and_reasons(spark):
    lines = F.array(F.struct(F.lit("ab").alias("text"), F.lit(0.5).alias("confidence")), F.struct(F.lit("").alias("text"), F.lit(1.0).alias("confidence")))
    assert one(spark, K.weighted_confidence(lines)) == pytest.approx(2 / 3)
    assert one(spark, K.boosted_confidence(F.lit(0.9), F.lit("例题1"))) == 0.95
    c = K.classify_by_rules(F.lit("短"))
    assert one(spark, K.recognition_reasons(F.lit("短"), F.lit(0.1), c)) == [K.REASON_OCR_UNSURE, K.REASON_OCR_SHORT, K.REASON_UNSTABLE]
