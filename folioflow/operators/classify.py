"""Weighted keyword rules over a two-level taxonomy, and the cascade to a model."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

# The default taxonomy, the rules in the order that breaks ties, and their messages.
TAXONOMY: Mapping[str, tuple[str, ...]] = {
    "计数": ("染色问题", "数位进位", "组数问题", "排列问题", "组合计数", "计数综合"),
    "组合": ("抽屉原理", "容斥原理"),
    "数论": ("整除余数", "质因数", "数论综合"),
    "几何": ("面积周长", "图形计数", "几何综合"),
    "应用": ("比例问题", "工程问题", "浓度利润", "应用题"),
    "行程": ("相遇追及", "行程综合"),
    "逻辑": ("逻辑推理",),
    "未分类": ("未分类",),
}


@dataclass(frozen=True)
class Rule:
    group: str
    category: str
    terms: tuple[tuple[str, int], ...]

    def score(self, text: Column) -> Column:
        """Each pattern that occurs counts once with its weight."""
        total = F.lit(0)
        for pattern, weight in self.terms:
            total = total + F.when(text.rlike(pattern), weight).otherwise(0)
        return total


RULES = (
    Rule("组合", "抽屉原理", (("至少", 2), ("完全相同|相同", 4), ("列", 2), ("2[×xX*]10", 1))),
    Rule("计数", "染色问题", (("染色", 5), ("涂色", 5), ("颜色", 2), ("彩笔", 1))),
    Rule("计数", "数位进位", (("进位", 5), ("相加", 1), ("三位数|四位数", 1))),
    Rule("计数", "组数问题", (("组成", 3), ("三位数|四位数|多位数", 3), ("卡片.*数字|数字.*卡片", 2))),
    Rule("应用", "比例问题", (("之比|钱数比", 5), ("钱数", 2), ("售价|买", 1))),
    Rule("计数", "排列问题", (("排列|排成|站队|顺序", 4), ("多少种|共有多少", 2))),
    Rule("计数", "组合计数", (("组合|选出|取出|选法", 4), ("多少种|共有多少", 2))),
    Rule("组合", "容斥原理", (("至少一个|都不|重复计算", 3), ("容斥", 5))),
    Rule("数论", "整除余数", (("整除|余数", 5), ("倍数|约数|因数", 3))),
    Rule("数论", "质因数", (("质数|合数|质因数", 5),)),
    Rule("几何", "面积周长", (("面积|周长", 5), ("三角形|正方形|长方形|圆", 1))),
    Rule("几何", "图形计数", (("多少个.*(?:三角形|正方形|长方形|图形)", 5),)),
    Rule("行程", "相遇追及", (("相遇|追及", 5), ("路程|速度|时间", 2))),
    Rule("行程", "行程综合", (("路程|速度", 3), ("时间", 2))),
    Rule("应用", "工程问题", (("工程|工作效率|完成.*工作", 5),)),
    Rule("应用", "浓度利润", (("浓度|利润|成本", 5),)),
    Rule("逻辑", "逻辑推理", (("一定|可能|真假|推理", 3), ("条件", 1))),
    Rule("计数", "计数综合", (("共有多少|有多少种|多少种不同", 2), ("方法|方案|种", 2))),
    Rule("应用", "应用题", (("鸡兔同笼|一共.*还剩|售价", 3),)),
)
LEAST_SCORE = 3
REVIEW_BELOW = 0.75
MODEL_MARGIN = 0.05
REASON_NO_RULES = "需要人工选择题型"
REASON_UNSTABLE = "未识别出稳定题型"
REASON_UNSURE = "分类置信度较低"
REASON_OCR_UNSURE = "题干 OCR 置信度较低"
REASON_OCR_SHORT = "识别出的有效题干过短"


def classify_by_rules(text: Column, rules: Iterable[Rule] = RULES, allowed: Mapping[str, Iterable[str]] | None = None, spaceless: bool = True) -> Column:
    """struct<group, category, confidence, source, reasons, best, second> from the two best rules.

    Rules outside `allowed` don't run. Below `LEAST_SCORE` the text stays
    uncategorised; ties go to the earlier rule. The whole rule table is one
    expression, so texts are read once and nothing is exploded.
    """
    usable = [r for r in rules if allowed is None or r.category in tuple(allowed.get(r.group, ()))]
    no_reason = F.array().cast("array<string>")
    out = lambda g, c, conf, reasons, best, second: F.struct(g.alias("group"), c.alias("category"), conf.cast("double").alias("confidence"), F.lit("rules").alias("source"), reasons.alias("reasons"), best.alias("best"), second.alias("second"))
    none = F.lit(T.UNCATEGORIZED)
    if not usable:
        return out(none, none, F.lit(0.0), F.array(F.lit(REASON_NO_RULES)), F.lit(0), F.lit(0))
    def rank(t: Column) -> Column:
        return F.array_sort(F.array(*[F.struct((-r.score(t)).alias("s"), F.lit(i).alias("i"), F.lit(r.group).alias("g"), F.lit(r.category).alias("c")) for i, r in enumerate(usable)]))

    def read(a: Column) -> Column:
        best, second = -a[0]["s"], (-a[1]["s"] if len(usable) > 1 else F.lit(0))
        conf = F.round(F.least(F.lit(0.98), F.lit(0.55) + F.lit(0.08) * (best - LEAST_SCORE) + F.lit(0.04) * (best - second)), 4)
        low = best < LEAST_SCORE
        reasons = F.when(low, F.array(F.lit(REASON_UNSTABLE))).when(conf < REVIEW_BELOW, F.array(F.lit(REASON_UNSURE))).otherwise(no_reason)
        return out(F.when(low, none).otherwise(a[0]["g"]), F.when(low, none).otherwise(a[0]["c"]), F.when(low, 0.0).otherwise(conf), reasons, best, second)

    # bound once each: the folded text would else be made anew for every pattern, and the ranking for each of its uses
    return T.let(T.compact(text) if spaceless else T.text_of(text), lambda t: T.let(rank(t), read))


def cascade(df: DataFrame, key: str, text: str, model: DataFrame | None = None, rules: Iterable[Rule] = RULES, allowed: Mapping[str, Iterable[str]] | None = None, spaceless: bool = True) -> DataFrame:
    """`df` with its classification by rules, or by a model where rules are unsure and the model is surer by the margin.

    `model` has `key`, group, category and confidence for what `unsure` asked
    about; it stands for any provider, so only those rows ever reach it.
    """
    ruled = df.withColumn("classification", classify_by_rules(F.col(text), rules, allowed, spaceless))
    if model is None:
        return ruled
    said = model.select(F.col(key), F.struct("group", "category", "confidence").alias("__m"))
    c, m = F.col("classification"), F.col("__m")
    better = (c["confidence"] < REVIEW_BELOW) & (m["confidence"] >= c["confidence"] + MODEL_MARGIN)
    chosen = F.struct(m["group"].alias("group"), m["category"].alias("category"), m["confidence"].alias("confidence"), F.lit("model").alias("source"), F.array().cast("array<string>").alias("reasons"), c["best"].alias("best"), c["second"].alias("second"))
    return ruled.join(said, key, "left").withColumn("classification", F.when(better, chosen).otherwise(c)).drop("__m")


def unsure(df: DataFrame, text: str, rules: Iterable[Rule] = RULES, allowed: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """The rows that a model should see."""
    return df.withColumn("classification", classify_by_rules(F.col(text), rules, allowed)).where(F.col("classification.confidence") < REVIEW_BELOW)


def recognition_reasons(text: Column, confidence: Column, classified: Column) -> Column:
    """Why a recognised text needs review: unsure reading, too short, and the classification's own reasons."""
    short = F.length(F.regexp_replace(T.text_of(text), r"[^\p{L}\p{N}]", "")) < 8
    own = F.array(F.when(confidence < REVIEW_BELOW, REASON_OCR_UNSURE), F.when(short, REASON_OCR_SHORT))
    return F.array_distinct(F.concat(F.array_compact(own), classified["reasons"]))


def weighted_confidence(lines: Column) -> Column:
    """Mean confidence of array<struct<text, confidence>> weighted by text length, at least 1 each; 0 without lines."""
    w = lambda x: F.greatest(F.lit(1), F.length(T.text_of(x["text"])))
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + w(x))
    return F.when(total > 0, F.aggregate(lines, F.lit(0.0), lambda a, x: a + w(x) * F.coalesce(x["confidence"], F.lit(0.0))) / total).otherwise(0.0)


def boosted_confidence(mean: Column, text: Column) -> Column:
    """A reading's confidence with credit for Chinese text and a printed title, at most 0.95."""
    return F.least(F.lit(0.95), mean + F.least(F.lit(0.3), T.hanzi_count(text) / 240.0) + F.when(T.text_of(text).rlike(T.QUESTION_START), 0.1).otherwise(0.0))


def manual_override(group: Column, key: Column, active: Column, classified: Column) -> Column:
    """A reviewer's pair, if both parts are given and the pair is active; else the classification."""
    chosen = F.struct(group.alias("group"), key.alias("category"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.array().cast("array<string>").alias("reasons"), classified["best"].alias("best"), classified["second"].alias("second"))
    return F.when((T.text_of(group) != "") & (T.text_of(key) != "") & active, chosen).otherwise(classified)
