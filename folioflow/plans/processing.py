"""The whole way of a problem: recognised lines to a classified, gated, fingerprinted row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import similarity as S
from folioflow.functions import text as T
from folioflow.operators import blocks as B
from folioflow.operators import catalog as C
from folioflow.operators import classify as K
from folioflow.operators import latex as L
from folioflow.operators import layout as G
from folioflow.operators import review as V
from folioflow.operators import taxonomy as Y

REASON_INACTIVE = "题型已停用"


def process(problems: DataFrame, lines: DataFrame, secondary: DataFrame, taxonomy: DataFrame, rules: Iterable[K.Rule] = K.RULES, verified: bool = False) -> DataFrame:
    """Problems (`id`, `split_label`) with everything their readings say.

    `lines` has id, text, confidence, x, y, w and h, one row per recognised
    line; `secondary` id and text of the second reading; `taxonomy` is flat. A
    problem without lines keeps its row and says why. One shuffle by id serves
    the reading order and both joins.
    """
    ordered = G.ordered_text(lines, "id").withColumnRenamed("text", "ocr_text")
    total = F.sum(F.greatest(F.lit(1), F.length("text")))
    sure = lines.groupBy("id").agg((F.sum(F.coalesce("confidence", F.lit(0.0)) * F.greatest(F.lit(1), F.length("text"))) / total).alias("mean"))
    read = problems.join(ordered, "id", "left").join(sure, "id", "left").join(secondary.select("id", F.col("text").alias("__second")), "id", "left")
    read = read.withColumns({"ocr_text": T.text_of(F.col("ocr_text")), "mean": F.coalesce("mean", F.lit(0.0))})
    found = read.withColumn("structured", S.structured_problem(F.col("ocr_text"), F.col("__second"), F.col("split_label")))
    found = found.withColumn("classification", K.classify_by_rules(F.col("ocr_text"), rules))
    found = found.withColumn("confidence", K.boosted_confidence(F.col("mean"), F.col("ocr_text")))
    reasons = F.array_distinct(F.concat(F.col("structured.review_reasons"), K.recognition_reasons(F.col("ocr_text"), F.col("confidence"), F.col("classification"))))
    rows = found.withColumns({"review_reasons": reasons, "category_group": F.col("classification.group"), "category_key": F.col("classification.category"), "category_confidence": F.col("classification.confidence"), "content_fingerprint": T.content_fingerprint(F.col("ocr_text"), F.col("structured.figure"))})
    rows = Y.deactivated_override(rows, taxonomy, REASON_INACTIVE)
    gate = V.quality_gate(F.col("review_reasons"), F.lit(verified))
    rows = rows.withColumn("gate", gate).withColumn("review_reasons", F.col("gate.review_reasons"))
    state = V.status_decision(F.col("review_reasons"), F.lit(None).cast("string"))
    return rows.withColumns({"status": state["status"], "review_status": state["review_status"], "gate": F.col("gate.gate"), "content_blocks": B.build(F.col("structured.body"))}).drop("__second", "mean")


def finish_batches(batches: DataFrame, problems: DataFrame) -> DataFrame:
    """Batches with their status after all their problems."""
    return C.batch_status(batches, problems)


# Limits of formulas on a page, and the reasons that they give.
MOST_FORMULAS = 64
LEAST_AREA = 64
MOST_COVERED = 0.25
REASON_MANY_FORMULAS = "Formula count exceeds 64; lowest-confidence boxes were omitted"
REASON_NO_DETECTOR = "Formula OCR unavailable: "
REASON_FORMULA_REVIEW = " requires review"
REASON_FORMULA_UNSAFE = " has no safe LaTeX result"
REASON_UNALIGNED = " 个公式无法与原题文字精确对齐，已保留原始文字或公式行图像，未执行推测性替换"


def formula_crops(pages: DataFrame, detected: DataFrame) -> DataFrame:
    """The boxes to recognise: page_id, formula_no (from 1), x0, y0, x1, y1, score and `omitted`, the page's boxes beyond the cap.

    `pages` has page_id, width, height and figure_box (a struct of x0, y0, x1, y1,
    or null); `detected` page_id, seq, x0, y0, x1, y1 and score (of one seq, place decides). Of more than
    `MOST_FORMULAS` boxes the surest stay, in order of place. Boxes grow by a
    margin; small ones and those that a figure covers more than a quarter of go.
    """
    page = Window.partitionBy("page_id")
    ranked = detected.withColumns({"__rank": F.row_number().over(page.orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "seq", "y0", "x0", "y1", "x1")), "__n": F.count("*").over(page)}).where(F.col("__rank") <= MOST_FORMULAS)
    many = F.col("__n") > MOST_FORMULAS
    place = F.struct(F.when(many, F.col("y0")).otherwise(0), F.when(many, F.col("x0")).otherwise(0), F.col("seq"), F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))
    x, y = F.greatest(F.lit(2.0), F.rint(F.col("height") * 0.0005)), F.greatest(F.lit(4.0), F.rint(F.col("height") * 0.001))
    box = F.struct(F.greatest(F.lit(0.0), F.col("x0") - x).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - y).alias("y0"), F.least("width", F.col("x1") + x).alias("x1"), F.least("height", F.col("y1") + y).alias("y1"))
    grown = ranked.join(pages.select("page_id", "width", "height", "figure_box"), "page_id").select("page_id", place.alias("__place"), box.alias("b"), "score", (F.col("__n") - F.least("__n", F.lit(MOST_FORMULAS))).alias("omitted"), "figure_box")
    b, f = F.col("b"), F.col("figure_box")
    covered = F.when(f.isNotNull(), G.intersection(b, f) > G.area(b) * MOST_COVERED).otherwise(False)
    kept = grown.where((G.area(b) >= LEAST_AREA) & ~covered)
    return kept.select("page_id", F.row_number().over(page.orderBy("__place")).alias("formula_no"), *[b[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "score", "omitted")


def recognised_formulas(crops: DataFrame, recognised: DataFrame) -> DataFrame:
    """A row per crop with formula_id, latex, recognition_state and what the surer variant said.

    `recognised` has page_id, formula_no, `first` and `second` (structs of latex,
    mean, p05, eos and unk; the clean and the contrast picture), `crop` (the clean
    picture's bytes) and the names of both pictures; crops without a row count as
    not recognised.
    """
    j = crops.join(recognised, ["page_id", "formula_no"], "left")
    first, second = F.col("first"), F.col("second")
    surer = F.when(F.coalesce(second["mean"], F.lit(0.0)) > F.coalesce(first["mean"], F.lit(0.0)), second).otherwise(first)
    out = j.withColumns({"__v": L.verification(first, second), "__p": surer})
    number = F.concat(F.lit("Formula "), F.col("formula_no").cast("string"))
    state = F.col("__v.state")
    return out.select(
        "page_id", "formula_no", "x0", "y0", "x1", "y1", "omitted", T.formula_id(F.coalesce("crop", F.lit(b"")), F.col("x0"), F.col("y0")).alias("formula_id"), F.col("__v.latex").alias("latex"), state.alias("recognition_state"),
        F.coalesce(L.validated(F.col("__p.latex")), F.lit("")).alias("model_latex"), T.text_of(F.col("__p.latex")).alias("source_text"), F.round("score", 6).alias("detector_confidence"),
        F.round(F.coalesce("__p.mean", F.lit(0.0)), 6).alias("mean_token_probability"), F.round(F.coalesce("__p.p05", F.lit(0.0)), 6).alias("p05_token_probability"), F.coalesce("__p.eos", F.lit(False)).alias("eos_reached"),
        F.when(state == "needs_review", F.concat(number, F.lit(REASON_FORMULA_REVIEW))).when(state == "image_fallback", F.concat(number, F.lit(REASON_FORMULA_UNSAFE))).alias("reason"), "clean_crop_asset", "original_crop_asset",
    )


def process_formulas(pages: DataFrame, detected: DataFrame, recognised: DataFrame, lines: DataFrame) -> DataFrame:
    """Per page: version, blocks, review_reasons, formula_count, and counts by state and by alignment.

    `pages` has page_id, width, height, text, figure (an asset or null), figure_box
    and detector_error; the others are what `formula_crops`, `recognised_formulas`
    and `blocks.merge_components` take. Pages without formulas, with an unaligned
    one, or whose detector failed keep the blocks of their text (version 1).
    """
    usable = pages.where("detector_error is null")
    crops = formula_crops(usable, detected)
    formulas = recognised_formulas(crops, recognised)
    boxes = formulas.select("page_id", "formula_id", "latex", L.visible(F.col("latex")).alias("visible"), "x0", "y0", "x1", "y1")
    merged = B.merge_components(lines, boxes)
    blocks = B.assemble(merged, formulas, pages.select("page_id", "text"))
    placed = merged.where("type = 'latex'").select("page_id", "formula_id", "alignment")
    counted = formulas.join(placed, ["page_id", "formula_id"], "left").withColumn("alignment", F.coalesce("alignment", F.lit("text_preserved")))
    per = counted.groupBy("page_id").agg(
        F.count("*").alias("formula_count"), F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("formula_no", "reason")))), lambda r: r["reason"]).alias("__reasons"),
        F.struct(*[F.count_if(F.col("recognition_state") == s).alias(s) for s in ("auto_verified", "needs_review", "image_fallback", "human_verified")]).alias("formula_states"),
        F.struct(*[F.count_if(F.col("alignment") == s).alias(s) for s in V.ALIGNMENTS]).alias("formula_alignment"),
    )
    many = detected.groupBy("page_id").agg((F.count("*") > MOST_FORMULAS).alias("__many"))
    none = F.array().cast("array<string>")
    some = lambda c, text: F.when(c, F.array(text)).otherwise(none)
    unaligned = F.coalesce("formula_alignment.unaligned", F.lit(0))
    failed = F.col("detector_error").isNotNull()
    reasons = F.concat(
        some(failed, F.concat(F.lit(REASON_NO_DETECTOR), T.text_of(F.col("detector_error")))), some(F.coalesce("__many", F.lit(False)) & ~failed, F.lit(REASON_MANY_FORMULAS)),
        F.coalesce("__reasons", none), some(unaligned > 0, F.concat(unaligned.cast("string"), F.lit(REASON_UNALIGNED))),
    )
    j = pages.join(blocks, "page_id").join(per, "page_id", "left").join(many, "page_id", "left")
    image = B.block("image", asset=F.col("figure"), alt=F.lit("question figure"), source_box=F.when(F.col("figure_box").isNotNull(), F.array(*[F.col(f"figure_box.{c}") for c in ("x0", "y0", "x1", "y1")])).otherwise(F.array().cast("array<int>")))
    there = F.exists("blocks", lambda x: (x["type"] == "image") & (x["asset"] == F.col("figure")))
    shown = F.when((T.text_of(F.col("figure")) != "") & ~F.coalesce(there, F.lit(False)), F.concat("blocks", F.array(image))).otherwise(F.col("blocks"))
    return j.select("page_id", "version", shown.alias("blocks"), reasons.alias("review_reasons"), F.coalesce("formula_count", F.lit(0)).alias("formula_count"), "formula_states", "formula_alignment")
