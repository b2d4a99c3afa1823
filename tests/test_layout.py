"""Layout, blocks, LaTeX and exports."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import blocks as B
from folioflow.operators import exports as X
from folioflow.operators import latex as L
from folioflow.operators import layout as G

LINE = "struct<text:string,confidence:double,box:struct<x:double,y:double,w:double,h:double>>"


def line(text, y, x=0.1, confidence=0.8, w=0.72):
    return (text, confidence, (x, y, w, 0.035))


def anchors(spark, lines, width=1000, height=1400):
    df = spark.createDataFrame([(lines, width, height)], f"l array<{LINE}>, w int, h int")
    return [a["label"] for a in df.select(G.anchors(F.col("l"), F.col("w"), F.col("h")).alias("a")).first()["a"]]


def test_anchors(spark):
    assert anchors(spark, [line("例6、求", 0.86), line("例7、求", 0.66), line("列8、求", 0.46), line("1、求", 0.26)]) == ["【例题6】", "【例题7】", "【例题8】", "【第1题】"]
    assert anchors(spark, [line("【预习5】", 0.8), line("【预习6】", 0.4)]) == ["【预习5】", "【预习6】"]
    assert anchors(spark, [line("【练习7】", 0.9), line("1、2、3、", 0.8), line("【练习8】", 0.6), line("5. 6. 7", 0.5)]) == ["【练习7】", "【练习8】"]
    assert anchors(spark, [line("例1、", 0.8), line("例2、", 0.795), line("例3、", 0.5, x=0.5)]) == ["【例题1】"]
    assert anchors(spark, [line("例6、", 0.8), line("17、", 0.4)]) == ["【例题6】", "【例题7】"]
    assert anchors(spark, []) == []


def test_boxes(spark):
    df = spark.createDataFrame([((0.1, 0.7, 0.5, 0.2),)], "b struct<x:double,y:double,w:double,h:double>")
    assert tuple(df.select(G.pixel_box(F.col("b"), F.lit(200), F.lit(100)).alias("x")).first()["x"]) == (20, 10, 120, 30)
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((20.0, 10.0), (120.0, 10.0), (120.0, 30.0), (20.0, 30.0))])
    assert [round(v, 6) for v in spark.range(1).select(G.polygon_box(points, F.lit(200), F.lit(100)).alias("x")).first()["x"]] == [0.1, 0.7, 0.5, 0.2]
    lines = spark.createDataFrame([([line("页眉", 0.95), line("例题1 多少", 0.87), line("颜色？", 0.82), line("草稿", 0.45)],)], f"l array<{LINE}>")
    box = lines.select(G.question_box(F.col("l"), F.lit(1000), F.lit(1000)).alias("x")).first()["x"]
    assert box["y0"] < 100 and box["y1"] < 220
    assert spark.createDataFrame([([line("例题1 多少", 0.87)],)], f"l array<{LINE}>").select(G.question_box(F.col("l"), F.lit(10), F.lit(10)).alias("x")).first()["x"] is None
    tall = spark.createDataFrame([([("ab", 0.9, (0.1, 0.1, 0.02, 0.5))],)], f"l array<{LINE}>")
    assert tall.select(G.rotation_hint(F.col("l"))).first()[0] == -90
    b = spark.createDataFrame([([(0, 0, 10, 10), (0, 0, 20, 20)], [(0, 0, 6, 6)])], "b array<struct<x0:int,y0:int,x1:int,y1:int>>, f array<struct<x0:int,y0:int,x1:int,y1:int>>")
    assert len(b.select(G.without_covered(F.col("b"), F.col("f"))).first()[0]) == 1


def test_reading_order_rows_and_stray_lines():
    mk = lambda t, x, y, c=0.9: {"text": t, "confidence": c, "x": x, "y": y, "w": 0.3, "h": 0.03}
    page = [mk("页眉", 0.1, 0.95), mk("B", 0.5, 0.90), mk("例题1 A", 0.1, 0.902), mk("多少？", 0.1, 0.86), mk("补充", 0.1, 0.83), mk("草稿", 0.1, 0.5)]
    want = "例题1 AB\n补充\n多少？"
    assert G.reading_order(page) == want and G.reading_order(page[::-1]) == want
    assert G.reading_order([mk("无", 0.1, 0.5)]) == "" and G.reading_order([]) == ""


def test_pages_split_at_anchors(spark):
    lines = [line("【练习1】求圆的周长r，", 0.86), line("求r的值。", 0.8), line("【练习2】求圆的面积s，", 0.4), line("求s的值。尾", 0.36)]
    df = spark.createDataFrame([(1, lines, 1000, 1400, None), (2, lines[:2], 1000, 1400, None), (3, [], 1000, 1400, [])], f"page_id int, lines array<{LINE}>, width int, height int, formula_boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")
    out = G.page_regions(df).orderBy("page_id", "region_index").collect()
    assert [(r["page_id"], r["label"], r["ocr_text"][-1]) for r in out] == [(1, "【练习1】", "。"), (1, "【练习2】", "。")]


def test_starts_move_off_formulas(spark):
    df = spark.createDataFrame([([10, 100, 300], [(0, 90, 5, 130)])], "s array<int>, b array<struct<x0:int,y0:int,x1:int,y1:int>>")
    assert df.select(G.adjusted_starts(F.col("s"), F.col("b"), F.lit(1000))).first()[0] == [10, 86, 300]


def test_folds_and_windows(spark):
    assert spark.createDataFrame([([1.0, 3.0, 6.0, 10.0, 11.0],)], "a array<double>").select(G.far_from_last_kept(F.col("a"), F.lit(5.0))).first()[0] == [1.0, 6.0, 11.0]
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 6.0), (1, 8.0, 9.0), (2, 0.0, 1.0)], "k int, a double, b double")
    assert sorted(map(tuple, G.merge_intervals(df, ["k"], "a", "b", 1).collect())) == [(1, 0.0, 6.0, 2), (1, 8.0, 9.0, 1), (2, 0.0, 1.0, 1)]
    assert sorted((r["a"], r["cluster"]) for r in G.gap_clusters(df.where("k = 1"), ["k"], "a", 4).collect()) == [(0.0, 0), (4.0, 0), (8.0, 0)]
    grid = F.array(F.lit(0.0), F.lit(10.0))
    assert spark.range(1).select(G.nearest(F.lit(9.0), grid, F.lit(2.0)), G.nearest(F.lit(5.0), grid, F.lit(2.0))).first()[:] == (10.0, 5.0)


def blocks(spark, column):
    return [(b["type"], b["text"] if b["type"] == "text" else b["latex"]) for b in spark.range(1).select(column.alias("b")).first()["b"]]


def test_blocks_tokenise_arithmetic(spark):
    assert blocks(spark, B.build(F.lit("方格是2×10，比是37:25，求答案。"))) == [("text", "方格是"), ("latex", "2 \\times 10"), ("text", "，比是"), ("latex", "37:25"), ("text", "，求答案。")]
    assert blocks(spark, B.build(F.lit(" x+y "), F.lit("f.png"))) == [("latex", "\\times +y"), ("image", None)]
    assert blocks(spark, B.build(F.lit(None).cast("string"))) == []
    text = "求2×10与a+b，12-3=9和x。"
    joined = F.array_join(F.transform(B.build(F.lit(text)), lambda b: F.coalesce(b["text"], b["source_text"])), "")
    assert spark.range(1).select(joined).first()[0] == text


def test_unsupported_maths_becomes_a_picture(spark):
    lines = F.array(F.struct(F.lit("√16=4").alias("text"), F.array(*map(F.lit, (1, 2, 3, 4))).alias("box")))
    assert [k for k, _ in blocks(spark, B.with_fallbacks(F.lit("已知√16=4成立"), lines))] == ["text", "image", "text"]


def test_question_blocks_and_text(spark):
    def made(*parts):
        return F.array(*[B.block(k, text=F.lit(t), latex=F.lit(x), row_index=F.lit(r), display=F.lit(False), recognition_state=F.lit(s)) for k, t, x, r, s in parts])

    raw = made(("text", "页眉", None, 0, None), ("text", "【例题1】在", None, 1, None), ("latex", None, "r", 1, "auto_verified"), ("text", "进制中计算，求结果。", None, 1, None), ("text", "页脚", None, 3, None), ("image", None, None, None, None))
    only = B.question_only(raw, F.lit("【例题1】"))
    assert blocks(spark, only) == [("text", "在"), ("latex", "r"), ("text", "进制中计算，求结果。"), ("image", None)]
    assert spark.range(1).select(B.to_text(only, F.lit("【例题1】"))).first()[0] == "【例题1】 在\\(r\\)进制中计算，求结果。"
    assert len(blocks(spark, B.question_only(made(("text", "无", None, 0, None)), F.lit("【例题9】")))) == 1
    picture = made(("text", "【例题1】", None, 0, None), ("latex", None, "r", 0, "human_verified_image"))
    assert B.IMAGE_MARK in spark.range(1).select(B.to_text(picture, F.lit("t"))).first()[0]
    gap = made(("text", "在", None, 0, None), ("text", "进制", None, 0, None))
    assert blocks(spark, B.restore_radix_variable(gap, F.lit("在r进制")))[0] == ("text", "在r")


def test_rows_of_blocks(spark):
    df = spark.createDataFrame([(1, i, k, r, d) for i, (k, r, d) in enumerate([("text", 0, None), ("latex", 0, False), ("text", None, None), ("latex", 1, True), ("text", 1, None), ("image", None, None), ("text", 2, None)])], "p int, i int, type string, row int, display boolean")
    assert [r["row_no"] for r in B.rows(df, ["p"], ["i"], row="row").orderBy("i").collect()] == [1, 1, 1, 2, 3, 4, 5]


def test_components_merge(spark):
    lines = spark.createDataFrame([("p", "前r进制N=(12345654321)&后", 0, 0, 1000, 40), ("p", "末行", 0, 100, 200, 140)], "page_id string, text string, x0 int, y0 int, x1 int, y1 int")
    f = spark.createDataFrame([("p", "f1", "N=(12345654321)_{8}", "N=(12345654321)8", 300, 2, 800, 38), ("p", "f2", "r", "r", 50, 2, 90, 38), ("p", "f3", "z+1", "z+1", 500, 300, 600, 330)], "page_id string, formula_id string, latex string, visible string, x0 int, y0 int, x1 int, y1 int")
    out = B.merge_components(lines, f).orderBy("seq").collect()
    assert [(r["type"], r["text"] or r["formula_id"], r["row_index"]) for r in out] == [("text", "前r进制", 0), ("latex", "f1", 0), ("text", "后", 0), ("text", "末行", 1), ("latex", "f3", 2)]
    assert [(r["display"], r["alignment"]) for r in out if r["type"] == "latex"] == [(False, "aligned"), (True, "standalone")]


def test_blocks_fall_back_where_a_formula_has_no_place(spark):
    merged = spark.createDataFrame([("p", 0, "text", "前", None, 0, None, None, None), ("p", 1, "latex", None, "f1", 0, 40, False, "aligned"), ("q", 0, "latex", None, "f1", 0, 40, True, "unaligned")], B.MERGED)
    f = spark.createDataFrame([("p", "f1", "x^2", "auto_verified", "c.png"), ("q", "f1", "y", "needs_review", "c.png")], "page_id string, formula_id string, latex string, recognition_state string, clean_crop_asset string")
    t = spark.createDataFrame([("p", "前x2"), ("q", "1+2"), ("r", "z")], "page_id string, text string")
    out = {r["page_id"]: (r["version"], [(b["type"], b["text"] or b["latex"]) for b in r["blocks"]]) for r in B.assemble(merged, f, t).collect()}
    assert out == {"p": (2, [("text", "前"), ("latex", "x^2")]), "q": (1, [("latex", "1+2")]), "r": (1, [("text", "z")])}


@pytest.mark.parametrize("source", ["\\frac{1}{2}", "x^{2}+y_{1}", "\\begin{matrix}1&2\\end{matrix}", "\\sqrt{16}=4", "a", "\\left(\\frac{1}{2}\\right)"])
def test_latex_accepted(spark, source):
    assert spark.range(1).select(L.validated(F.lit(source))).first()[0] == source


@pytest.mark.parametrize("source", ["\\input{x}", "\\href{u}{v}", "\\newcommand{\\a}{b}", "{" * 33 + "}" * 33, "}{", "{", "", "x" * 8193, "\\begin{tikz}\\end{tikz}"])
def test_latex_refused(spark, source):
    assert spark.range(1).select(L.validated(F.lit(source))).first()[0] is None


def test_latex_forms(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(L.normalize(F.lit("$$ \\frac {1} { 2 } $$"))) == "\\frac{1}{2}"
    assert get(L.normalize(F.lit("\\bigl ( 4 8 \\bigr ) _ { 1 0 }"))).endswith("\\bigl ( 4 8 \\bigr )_{1 0}")
    assert get(L.printable(F.lit("2 \\times 10"))) == "2×10" and get(L.printable(F.lit("\\sqrt{2}"))) is None
    assert get(L.visible(F.lit("\\frac{1}{2}\\leq\\sqrt{x}"))) == "1/2≤√(x)"
    assert get(L.simple(F.lit("r"))) and not get(L.simple(F.lit("r+1")))
    v = lambda latex, mean=0.9, p05=0.5, eos=True: F.struct(F.lit(latex).alias("latex"), F.lit(mean).alias("mean"), F.lit(p05).alias("p05"), F.lit(eos).alias("eos"), F.lit(False).alias("unk"))
    assert tuple(get(L.verification(v("a"), v("a")))) == ("auto_verified", "a")
    assert tuple(get(L.verification(v("a", 0.7), v("b", 0.9)))) == ("needs_review", "b")
    assert tuple(get(L.verification(v("\\input{a}"), v("")))) == ("image_fallback", "")
    assert tuple(get(L.token_probabilities(F.array(*map(F.lit, (0.9, 0.1, 0.5)))))) == (0.5, 0.1)
    assert get(L.token_probabilities(F.array().cast("array<double>")))["p05"] is None


def problems(spark, groups):
    return spark.createDataFrame([(i, "b", g, f"k{g}", f"【题{i}】 文", "") for i, g in enumerate(groups)], "id int, batch_id string, category_group string, category_key string, ocr_text string, title string")


def test_eligibility(spark):
    ddl = "id int, status string, review_status string, selected_kind string, selected_artifact string, category_group string, category_key string, category string, ocr_text string, accepted_at string, updated_at string"
    df = spark.createDataFrame([(1, "ready", "accepted", "reconstructed", "x/question.png", "g", "k", "k", "t", None, "1"), (2, "ready", "pending", "normalized", "x/question.png", "g", "k", "j", "t", None, "1"), (3, "failed", "pending", None, "x", "", "k", "k", "t", None, None)], ddl)
    got = [tuple(r) for r in df.orderBy("id").select(X.pdf_eligible(), X.docx_eligible(), X.markdown_eligible()).collect()]
    assert got == [(True, True, True), (True, False, False), (False, False, False)]
    with pytest.raises(X.NotExportable, match="1 "):
        X.strict_or_partial(df, X.pdf_eligible())
    assert X.strict_or_partial(df, X.pdf_eligible(), partial=True).count() == 2
    with pytest.raises(X.NotExportable, match="no problem"):
        X.strict_or_partial(df.where("id = 3"), X.pdf_eligible(), partial=True)


def test_outline_keeps_first_appearance(spark):
    o = X.outline(problems(spark, ["计数", "应用", "计数", "计数", ""]), ["id"], ["batch_id"]).orderBy("number").collect()
    assert [(r["id"], r["export_group"], r["break_after"]) for r in o] == [(0, "计数", False), (2, "计数", True), (3, "计数", False), (1, "应用", True), (4, T.UNCATEGORIZED, False)]


def test_pdf_and_docx_layouts(spark):
    o = X.outline(problems(spark, ["计数"] * 5), ["id"], ["batch_id"])
    assert [r["page"] for r in X.pdf_layout(o, "batch_id").orderBy("number").collect()] == [2, 2, 3, 3, 4]
    styles = [r["style"] for r in X.docx_layout(o).orderBy("number", "rank").collect()]
    assert styles.count("Page break") == 2 and styles.count("Heading 1") == 1 and styles.count("Heading 3") == 5


def test_basename(spark):
    tops = X.top_groups(problems(spark, ["计数", "应用", "组合", "数论", "计数"]), ["batch_id"], "category_group")
    name = tops.select(X.export_basename(F.col("parts"), F.col("remain"), F.lit("2026-07-24 11:23:00").cast("timestamp"), F.lit("K7M2"))).first()[0]
    assert name == "20260724-1123-计数2-应用1-数论1-等1类-K7M2"
    assert [r[0] for r in spark.createDataFrame([("K7M2",), ("K7M1",), ("k7m2",)], "c string").select(X.valid_code(F.col("c"))).collect()] == [True, False, False]


def test_markdown_note_and_archive(spark):
    p = problems(spark, ["计数", "应用"]).withColumn("body", F.array(F.lit("求$2 \\times 10$。")))
    note = X.markdown_note(X.markdown_lines(X.outline(p, ["id"], ["batch_id"])), "b", "2026")
    assert note.count("#### ") == 2 and "problem_count: 2" in note and "## 计数 ^mb-" in note and note.index("## 计数") < note.index("## 应用")
    for target in {x.split("^")[1].split("|")[0] for x in note.splitlines() if "[[#^" in x}:
        assert f" ^{target}\n" in note
    data = X.markdown_zip("n", note, [("a.png", b"x")])
    assert sorted(zipfile.ZipFile(io.BytesIO(data)).namelist()) == [".obsidian/snippets/question-book-print.css", "attachments/a.png", "n.md"]
    with pytest.raises(ValueError, match="Duplicate attachment"):
        X.markdown_zip("n", note, [("a.png", b"x"), ("a.png", b"y")])
    b = F.array(B.block("text", text=F.lit("【题】a*b")), B.block("latex", latex=F.lit("r"), display=F.lit(False), recognition_state=F.lit("human_verified_image"), clean_crop_asset=F.lit("c.png")), B.block("latex", latex=F.lit("x+1"), display=F.lit(True)), B.block("text", text=F.lit("尾")))
    assert spark.range(1).select(X.render_blocks(b, F.array(F.lit("r-01.png")), F.lit("【题】"))).first()[0] == ["a\\*b![[attachments/r-01.png]]", "$$x+1$$", "尾"]
    assert [r[0] for r in spark.createDataFrame([("a.png",), ("../a",), ("",)], "c string").select(X.safe_resource(F.col("c"))).collect()] == [True, False, False]
    names = X.attachments(spark.createDataFrame([("p", ["x", "y"]), ("p!", ["z"])], "id string, assets array<string>"))
    assert [r["name"] for r in X.duplicate_attachments(names).collect()] == ["resource-p-01.png"]
