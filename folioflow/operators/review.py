"""Review: diagnostics, reasons, gates, edits of formulas, and the review transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Reasons, in the order of the tests, with severity, title and detail.
REASON_NO_TRUTH = "尚未建立该题的人工真值，禁止自动通过"
REASON_HIDDEN = "第二 OCR 未识别到完整题干"
CRITICAL_MARKERS = ("未定位到印刷题号", "题号格式未可靠恢复", "重建题干过短", "题干差异过大", "图", "结构", "拓扑", "数字", "比例")
DETAIL_NO_TRUTH = ("尚无人工标准答案", "当前结果没有经过人工确认，因此系统不会自动标记为通过；这不表示题目内容已识别错误。")
DETAIL_NUMBERS = "两套 OCR 识别出的数字不一致"
DETAIL_FORMULA_REVIEW = ("公式识别需要校正", "请对照公式原图修改 LaTeX，实时预览通过后保存。")
DETAIL_FORMULA_IMAGE = ("公式已保留为原图", "模型未生成可安全渲染的 LaTeX，请在公式编辑器中手动校正。")
DETAIL_FORMULA_MODEL = ("公式识别模型不可用", "已保留原有内容块，请运行公式模型安装脚本后重新处理。")
DETAIL_CRITICAL = "该问题可能改变题目内容或条件，需要对照原图核查。"
DETAIL_WARNING = "该项会阻止系统自动通过，但尚不能据此判断重建内容存在错误。"
TITLE_FAILED = "处理失败"
UNRESOLVED = ("needs_review", "image_fallback")
STATES = ("auto_verified", "needs_review", "image_fallback", "human_verified", "human_verified_image")
ALIGNMENTS = ("aligned", "text_preserved", "standalone", "unaligned")
BLUR_BELOW = 80.0


def _say(severity: str, title: Column | str, detail: Column | str) -> Column:
    c = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(F.lit(severity).alias("severity"), c(title).alias("title"), c(detail).alias("detail"))


def diagnostic(reason: Column, primary_numbers: Column, secondary_numbers: Column) -> Column:
    """What a reason means to a reviewer; the first test that fits decides."""
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    differ = F.concat(F.lit("主 OCR："), listed(primary_numbers), F.lit("；辅助 OCR："), listed(secondary_numbers), F.lit("。数字差异可能改变题意，需要核对原图。"))
    critical = F.lit(False)
    for marker in CRITICAL_MARKERS:
        critical = critical | reason.contains(marker)
    formula = reason.startswith("Formula ")
    return (
        F.when(reason == REASON_NO_TRUTH, _say("warning", *DETAIL_NO_TRUTH))
        .when(reason == T.REASON_NUMBERS, _say("critical", DETAIL_NUMBERS, differ))
        .when(formula & reason.contains("requires review"), _say("warning", *DETAIL_FORMULA_REVIEW))
        .when(formula & reason.contains("no safe LaTeX"), _say("warning", *DETAIL_FORMULA_IMAGE))
        .when(reason.startswith("Formula OCR unavailable"), _say("warning", *DETAIL_FORMULA_MODEL))
        .when(critical, _say("critical", reason, DETAIL_CRITICAL))
        .otherwise(_say("warning", reason, DETAIL_WARNING))
    )


def diagnostics(reasons: Column, primary_numbers: Column, secondary_numbers: Column, error: Column | None = None, review_status: Column | None = None) -> Column:
    """array<struct<severity, title, detail>> for the shown reasons, then the error; none once accepted or excluded."""
    none = F.array().cast("array<struct<severity:string,title:string,detail:string>>")
    shown = F.filter(F.coalesce(reasons, F.array().cast("array<string>")), lambda r: (F.trim(r) != "") & (r != REASON_HIDDEN))
    out = F.transform(shown, lambda r: diagnostic(r, primary_numbers, secondary_numbers))
    if error is not None:
        out = F.concat(out, F.when(T.text_of(error) != "", F.array(_say("critical", TITLE_FAILED, error))).otherwise(none))
    if review_status is not None:
        out = F.when(review_status.isin("accepted", "excluded"), none).otherwise(out)
    return out


def resolve_reasons(reasons: Column, resolved: Column) -> Column:
    """struct<review_reasons, resolved_review_reasons, human_verified> after a reviewer accepted: all reasons are resolved, first seen first."""
    none = F.array().cast("array<string>")
    return F.struct(none.alias("review_reasons"), F.array_distinct(F.concat(F.coalesce(resolved, none), F.coalesce(reasons, none))).alias("resolved_review_reasons"), F.lit(True).alias("human_verified"))


def status_decision(reasons: Column, error: Column) -> Column:
    """struct<status, review_status, error>: failed, to review, or ready."""
    failed, some = T.text_of(error) != "", F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0
    return F.struct(
        F.when(failed, "failed").when(some, "needs_review").otherwise("ready").alias("status"),
        F.when(failed | some, "pending").otherwise("not_required").alias("review_status"),
        F.when(failed, error).alias("error"),
    )


def quality_gate(reasons: Column, verified: Column) -> Column:
    """struct<gate, review_reasons>: what isn't verified gets a reason, and any reason means manual review."""
    own = F.array_distinct(F.concat(F.coalesce(reasons, F.array().cast("array<string>")), F.when(~verified, F.array(F.lit(REASON_NO_TRUTH))).otherwise(F.array().cast("array<string>"))))
    return F.struct(F.when(F.size(own) > 0, "manual_review_required").otherwise("dual_ocr_consistent").alias("gate"), own.alias("review_reasons"))


def blur_reason(score: Column, reason: str) -> Column:
    return F.when(score < BLUR_BELOW, reason)


def has_unresolved(blocks: Column) -> Column:
    """Whether any formula block still waits for review; such a problem can't be accepted."""
    return F.exists(F.coalesce(blocks, F.array().cast("array<struct<type:string,recognition_state:string>>")), lambda b: (b["type"] == "latex") & b["recognition_state"].isin(*UNRESOLVED))


def state_histogram(df: DataFrame, state: str, domain: tuple[str, ...], by: str) -> DataFrame:
    """A count per state of a fixed domain, zeros included."""
    return df.groupBy(by).agg(*[F.count_if(F.coalesce(F.col(state) == s, F.lit(False))).alias(s) for s in domain])


def carry_over(new: DataFrame, previous: DataFrame, key: tuple[str, ...] = ("problem_id", "formula_id")) -> DataFrame:
    """Regenerated formulas with earlier human edits kept: a human-verified formula's latex and state replace the new ones."""
    human = previous.where(F.col("recognition_state").isin("human_verified", "human_verified_image")).select(*key, F.col("latex").alias("__l"), F.col("recognition_state").alias("__s"))
    return new.join(human, list(key), "left").withColumns({"latex": F.when(F.col("__s").isNotNull(), F.col("__l")).otherwise(F.col("latex")), "recognition_state": F.coalesce("__s", "recognition_state")}).drop("__l", "__s")


def edit_formulas(formulas: DataFrame, edits: DataFrame, valid, key: tuple[str, ...] = ("problem_id", "formula_id")) -> tuple[DataFrame, DataFrame]:
    """Formulas after `edits` (key, latex, as_image), and the rejected edits with their cause: repeated, unknown or invalid.

    `valid(column)` is the LaTeX check. A problem with any rejected edit keeps all its formulas.
    """
    n = edits.groupBy(*key).agg(F.count("*").alias("__n"), F.first("latex").alias("__latex"), F.first("as_image").alias("__image"))
    there = n.join(formulas.select(*key, F.lit(True).alias("__there")).distinct(), list(key), "left")
    cause = F.when(F.col("__n") > 1, "repeated").when(F.col("__there").isNull(), "unknown").when(~F.coalesce(F.col("__image"), F.lit(False)) & ~valid(F.col("__latex")), "invalid")
    checked = there.withColumn("cause", cause)
    rejected = checked.where("cause is not null").select(*key, "cause")
    good = checked.join(rejected.select(key[0]).distinct(), key[0], "left_anti")
    image = F.coalesce(F.col("__image"), F.lit(False))
    out = formulas.join(good.select(*key, "__latex", "__image", F.lit(True).alias("__hit")), list(key), "left")
    out = out.withColumns(
        {
            "latex": F.when(F.col("__hit") & ~image, F.col("__latex")).otherwise(F.col("latex")),
            "recognition_state": F.when(F.col("__hit"), F.when(image, "human_verified_image").otherwise("human_verified")).otherwise(F.col("recognition_state")),
        }
    ).drop("__latex", "__image", "__hit")
    return out, rejected


def without_formula_reasons(reasons: Column, unresolved: Column) -> Column:
    """Once no formula waits, reasons about formulas go."""
    return F.when(unresolved, reasons).otherwise(F.filter(reasons, lambda r: ~r.startswith("Formula ")))


def review(problems: DataFrame, actions: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """The outcome of reviewers' actions, one per problem: `id`, `outcome` and the new row's fields.

    `actions` has id, action (accept, exclude, set_category), expected (the
    version seen), group and category. Outcomes: excluded, accepted,
    categorised, or refused as missing, conflict, unresolved_formula or
    inactive_category, tested in this order. `active` has group_name and category_name.
    """
    known = active.select(F.col("group_name").alias("__g"), F.col("category_name").alias("__k"), F.lit(True).alias("__active")).distinct()
    p = problems.withColumn("__there", F.lit(True))
    j = actions.join(p, "id", "left")
    wants = F.col("action") == "set_category"
    group, key = F.when(wants, F.col("group")).otherwise(F.col("category_group")), F.when(wants, F.col("category_new")).otherwise(F.col("category_key"))
    j = j.withColumns({"__group": group, "__key": key}).join(known, (F.col("__group") == F.col("__g")) & (F.col("__key") == F.col("__k")), "left")
    outcome = (
        F.when(F.col("__there").isNull(), "missing")
        .when(F.col("action") == "exclude", "excluded")
        .when(~F.col("expected").eqNullSafe(F.col("updated_at")), "conflict")
        .when((F.col("action") == "accept") & F.col("unresolved"), "unresolved_formula")
        .when(F.col("__active").isNull(), "inactive_category")
        .when(F.col("action") == "accept", "accepted")
        .otherwise("categorised")
    )
    j = j.withColumn("outcome", outcome)
    done = F.col("outcome").isin("accepted", "categorised")
    return j.select(
        "id",
        "outcome",
        F.when(done, F.col("__group")).otherwise(F.col("category_group")).alias("category_group"),
        F.when(done, F.col("__key")).otherwise(F.col("category_key")).alias("category_key"),
        F.when(F.col("outcome") == "accepted", "accepted").otherwise(F.col("review_status")).alias("review_status"),
        F.when(done, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def repair_reasons(reasons: Column, text: Column, similarity: Column) -> Column:
    """Reasons of earlier versions put right: a number that is there was a second reading's lack, and an unlike second reading says nothing."""
    titled = T.text_of(text).rlike("(?iu)[【\\[(（]?(?:例题|练习)\\s*[0-9S]+")
    renamed = F.when(titled, F.transform(reasons, lambda r: F.when(r == T.REASON_NO_NUMBER, REASON_HIDDEN).otherwise(r))).otherwise(reasons)
    unlike = F.coalesce(similarity, F.lit(0.0)) < T.RELIABLE_SIMILARITY
    return F.when(unlike, F.filter(renamed, lambda r: ~r.isin(REASON_HIDDEN, T.REASON_NUMBERS))).otherwise(renamed)


def evaluation_report(df: DataFrame, passed: Column, review: Column, by: list[str] | None = None) -> DataFrame:
    """sample_count, passed_count and review_count, over all rows or per group."""
    counts = [F.count("*").alias("sample_count"), F.count_if(F.coalesce(passed, F.lit(False))).alias("passed_count"), F.count_if(F.coalesce(review, F.lit(False))).alias("review_count")]
    return df.groupBy(*(by or [])).agg(*counts)
