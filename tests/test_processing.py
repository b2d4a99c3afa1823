"""The whole way of a problem, settings, and files committed on the driver."""

from __future__ import annotations

import json

import pytest

from folioflow.functions import text as T
from folioflow.operators import image as Im
from folioflow.operators import taxonomy as Y
from folioflow.plans.processing import REASON_INACTIVE, finish_batches, process
from folioflow.sources import files
from folioflow.sources.settings import Settings


def test_lines_become_gated_rows(spark):
    p = spark.createDataFrame([(1, None), (2, "【第2题】"), (3, None)], "id long, split_label string")
    rows = [(1, "例题7 三个圆圈互相交叠，七个区域", 0.9), (1, "染色，共有多少种方法？", 0.85), (2, "2、原来钱数之比是37比25，后来多少？", 0.9)]
    lines = spark.createDataFrame([(i, t, 0.95, 0.1, y, 0.7, 0.03) for i, t, y in rows], "id long, text string, confidence double, x double, y double, w double, h double")
    second = spark.createDataFrame([(1, "例题7 三个圆圈互相交叠，八3个区域染色，共有多少种方法？")], "id long, text string")
    off = Y.seed(spark)
    out = {r["id"]: r for r in process(p, lines, second, off, verified=True).collect()}
    assert (out[1]["category_key"], out[1]["structured"]["title"], out[1]["structured"]["figure"]) == ("染色问题", "【例题7】", "three_overlapping_circles")
    assert T.REASON_NUMBERS in out[1]["review_reasons"] and out[1]["status"] == "needs_review"
    assert out[2]["structured"]["title"] == "【第2题】" and out[2]["status"] == "ready" and out[2]["gate"] == "dual_ocr_consistent"
    assert T.REASON_NO_NUMBER in out[3]["review_reasons"] and out[3]["ocr_text"] == ""
    no_colours = off.withColumn("category_active", off["category_name"] != "染色问题")
    again = {r["id"]: r for r in process(p, lines, second, no_colours).collect()}
    assert again[1]["category_key"] == T.UNCATEGORIZED and REASON_INACTIVE in again[1]["review_reasons"] and again[2]["gate"] == "manual_review_required"
    b = spark.createDataFrame([("b",)], "id string")
    assert finish_batches(b, spark.createDataFrame([("b", "ready", "pending")], "batch_id string, status string, review_status string")).first()["rolled_status"] == "needs_review"


def test_settings():
    s = Settings.of({"FOLIOFLOW_DATA_DIR": "x", "FOLIOFLOW_FORMULAS": "no"})
    assert (s.data_dir, s.formulas, s.pipeline) == ("x", False, "v2")
    with pytest.raises(ValueError):
        Settings.of({"FOLIOFLOW_PIPELINE": "v3"})


def test_taxonomy_commit_keeps_a_backup(spark, tmp_path):
    path = str(tmp_path / "t.json")
    files.write_taxonomy({"version": 1, "revision": 0, "groups": []}, path)
    files.write_taxonomy({"version": 1, "revision": 1, "groups": []}, path)
    assert json.loads((tmp_path / "t.json").read_text())["revision"] == 1 and json.loads((tmp_path / "t.json.bak").read_text())["revision"] == 0
    df = spark.createDataFrame([(1,)], "id int")
    assert files.backup_once(df, "id", str(tmp_path / "b")) is None
    assert spark.read.parquet(files.backup_once(df, "new", str(tmp_path / "b"))).count() == 1


def test_pictures_of_questions():
    import numpy as np

    x = np.full((100, 120, 3), 200, np.uint8)
    assert Im.question_picture(x, (0, 0, 50, 20), (0, 50, 80, 90)).shape == (20 + 40 + 72, 80 + 48, 3)
    mask = np.zeros((100, 120))
    mask[10:20, 10:20] = 0.9
    out = Im.erased(x, mask)
    assert (out[12, 12] == 255).all() and (out[50, 50] == 200).all()
    x[40:44, 10:100] = 20
    layer = Im.print_layer(x)
    assert (layer[41, 50] == 0).all() and (layer[80, 50] == 255).all()


def test_the_formula_chain(spark):
    """Detected boxes to blocks: two sure formulas, one to review, one without a result, one that a figure covers, one too small; a page whose detector failed."""
    from pyspark.sql import functions as F

    from folioflow.plans import processing as P

    box = "page_id string, seq int, x0 int, y0 int, x1 int, y1 int, score double"
    detected = spark.createDataFrame([("a", 0, 100, 100, 160, 130, 0.9), ("a", 1, 700, 100, 760, 130, 0.8), ("a", 2, 520, 520, 560, 560, 0.7), ("a", 3, 0, 0, 1, 1, 0.9), ("b", 0, 100, 300, 160, 330, 0.6), ("c", 0, 5, 5, 90, 90, 0.5)], box)
    pages = spark.createDataFrame(
        [("a", 1000, 2000, "x+1 的值 是", "fig.png", (500, 500, 600, 600), None), ("b", 1000, 1000, "求 y", None, None, None), ("c", 1000, 1000, "没有", None, None, "no model"), ("d", 100, 100, "纯文字", "f.png", None, None)],
        "page_id string, width int, height int, text string, figure string, figure_box struct<x0:int,y0:int,x1:int,y1:int>, detector_error string",
    )
    crops = {(r["page_id"], r["formula_no"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in P.formula_crops(pages, detected).collect()}
    assert crops == {("a", 1): (98, 96, 162, 134), ("a", 2): (698, 96, 762, 134), ("b", 1): (98, 296, 162, 334), ("c", 1): (3, 1, 92, 94)}
    reading = "struct<latex:string,mean:double,p05:double,eos:boolean,unk:boolean>"
    good, other, bad = ("x+1", 0.95, 0.9, True, False), ("x+2", 0.9, 0.9, True, False), ("\\evil{", 0.99, 0.9, True, False)
    recognised = spark.createDataFrame([("a", 1, good, good, bytearray(b"1"), "c1", "o1"), ("a", 2, good, other, bytearray(b"2"), "c2", "o2"), ("b", 1, bad, bad, bytearray(b"3"), "c3", "o3")], f"page_id string, formula_no int, first {reading}, second {reading}, crop binary, clean_crop_asset string, original_crop_asset string")
    lines = spark.createDataFrame([("a", "x+1 的值", 100, 95, 400, 135), ("b", "求 y", 100, 100, 300, 130)], "page_id string, text string, x0 int, y0 int, x1 int, y1 int")
    out = {r["page_id"]: r for r in P.process_formulas(pages, detected, recognised, lines).collect()}
    assert out["a"]["version"] == 2 and out["a"]["review_reasons"] == ["Formula 2 requires review"] and out["a"]["formula_count"] == 2
    assert [(b["type"], b["latex"], b["text"]) for b in out["a"]["blocks"]] == [("latex", "x+1", None), ("text", None, "的值"), ("latex", "x+1", None), ("image", None, None)]
    assert out["a"]["formula_states"]["auto_verified"] == 1 and out["a"]["formula_alignment"]["aligned"] == 1 and out["a"]["formula_alignment"]["standalone"] == 1
    assert out["b"]["review_reasons"] == ["Formula 1 has no safe LaTeX result"] and out["b"]["formula_states"]["image_fallback"] == 1
    assert out["c"]["review_reasons"] == ["Formula OCR unavailable: no model"] and out["c"]["version"] == 1 and out["c"]["formula_count"] == 0
    assert [b["type"] for b in out["d"]["blocks"]] == ["text", "image"] and out["d"]["review_reasons"] == []
    many = spark.range(70).select(F.lit("b").alias("page_id"), F.col("id").cast("int").alias("seq"), F.lit(0).alias("x0"), (F.col("id") * 10).cast("int").alias("y0"), F.lit(50).alias("x1"), (F.col("id") * 10 + 9).cast("int").alias("y1"), (F.col("id") / 100).alias("score"))
    kept = P.formula_crops(pages, many).orderBy("formula_no").collect()
    assert len(kept) == 64 and kept[0]["y0"] == 56 and kept[0]["omitted"] == 6
