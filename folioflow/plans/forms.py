"""More named queries: text forms, titles, boxes, formulas and reasons, over values made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import blocks as B
from folioflow.operators import classify as K
from folioflow.operators import exports as X
from folioflow.operators import latex as L
from folioflow.operators import layout as G
from folioflow.operators import review as V
from folioflow.plans.catalogue import PROBLEMS, problems, query, table
from folioflow.sources import files


def case(column: str, n: int, *values):
    """`values` in turn by the column modulo n."""
    out = F
    for i, v in enumerate(values):
        out = out.when(F.col(column) % n == i, v)
    return out


# ---- texts


@query("""SELECT p_partkey, regexp_replace(p_name || CASE p_partkey % 4 WHEN 0 THEN '...' WHEN 1 THEN '⋯⋯x' WHEN 2 THEN '…' ELSE '·' END || p_type, '([.…⋯·•]{2,}|…)', '……', 'g') AS t FROM part""")
def canonical_ellipses(spark, d):
    text = F.concat("p_name", case("p_partkey", 4, "...", "⋯⋯x", "…", "·"), "p_type")
    return table(spark, d, "part").select("p_partkey", T.canonical_ellipsis(text).alias("t"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a……b' WHEN 1 THEN 'a·b' WHEN 2 THEN 'a……b' ELSE 'ab' END AS t FROM part""")
def punctuation_choices(spark, d):
    """A bullet that an alternative reads as an ellipsis; one whose alternative is too unsure; an ellipsis of its own; nothing suspicious."""
    text = case("p_partkey", 4, "a·b", "a·b", "a...b", "ab")
    other = F.array(F.struct(F.lit("a…b").alias("text"), F.when(F.col("p_partkey") % 4 == 1, 0.5).otherwise(0.85).alias("confidence")))
    return table(spark, d, "part").select("p_partkey", T.punctuation_candidate(text, F.lit(0.9), other).alias("t"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[？?]') THEN 1 ELSE 0 END AS question, len(list_distinct(regexp_extract_all(text, '[0-9]+(?::[0-9]+)?'))) AS numbers,
CASE WHEN regexp_matches(text, '(?:……|⋯|\.{3,})') THEN 1 WHEN regexp_matches(text, '[·•]') THEN -1 ELSE 0 END AS ellipsis FROM documents""")
def candidate_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ocr_candidate_score(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE NULL END AS a FROM part")
def lenient_json_values(spark, d):
    body = F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit("}"))
    text = case("p_partkey", 4, body, F.concat(F.lit("so: "), body, F.lit(" ok")), F.lit("{no"), F.lit(None))
    return table(spark, d, "part").select("p_partkey", F.try_variant_get(T.lenient_json(text), "$.a", "int").alias("a"))


@query("SELECT p_partkey, CASE WHEN left(regexp_replace(x, '[^一-鿿A-Za-z0-9·]', '', 'g'), 12) = '' THEN '未分类' ELSE left(regexp_replace(x, '[^一-鿿A-Za-z0-9·]', '', 'g'), 12) END AS c FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' / ' ELSE '数 ·' || p_type || '！' END AS x FROM part)")
def category_names(spark, d):
    text = F.when(F.col("p_partkey") % 5 == 0, " / ").otherwise(F.concat(F.lit("数 ·"), "p_type", F.lit("！")))
    return table(spark, d, "part").select("p_partkey", T.normalize_category(text).alias("c"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '【例题' || p_size || '】' WHEN 1 THEN '【第一】' ELSE '题目 ' || p_size END AS t FROM part")
def problem_titles(spark, d):
    structured = case("p_partkey", 3, F.concat(F.lit("【例题"), F.col("p_size").cast("string"), F.lit("】")), F.lit(T.NAMELESS_TITLE), F.lit(""))
    text = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" 【第一】"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.display_title(structured, text, F.col("p_size")).alias("t"))


@query("SELECT 'o/' || o_orderkey || '_x' AS id, i AS image_index, 'pic' || i AS asset, 'resource-o' || o_orderkey || '_x-0' || i || '.png' AS name FROM orders, (SELECT unnest([1, 2]) AS i)")
def attachment_names(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"), F.lit("_x")).alias("id"), F.array(F.lit("pic1"), F.lit("pic2")).alias("assets"))
    return X.attachments(o)


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'A,B,C' WHEN 1 THEN 'D' ELSE '' END AS labels FROM part")
def country_labels(spark, d):
    text = case("p_size", 3, "地图上有五个国家：A、B，C和A。", "区域 D、要涂色", "国家。A、B")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.country_labels(text), ",").alias("labels"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^一-鿿A-Za-z0-9]', '', 'g')) + 2 AS meaningful, CAST(2 AS INTEGER) AS hanzi, sha256(lower(regexp_replace(text || '汉字', '[^一-鿿A-Za-z0-9]', '', 'g'))) AS compared FROM documents""")
def text_measures(spark, d):
    t = F.concat("text", F.lit("汉字"))
    return table(spark, d, "documents").select("doc_id", T.meaningful_length(t).cast("long").alias("meaningful"), T.hanzi_count(t).alias("hanzi"), F.sha2(T.normalize_for_compare(t), 256).alias("compared"))


@query("SELECT p_partkey, p_partkey % 4 <> 3 AS needed, CASE p_partkey % 4 WHEN 0 THEN 'three_overlapping_circles' WHEN 1 THEN 'five_country_map' WHEN 2 THEN 'grid_2x10' ELSE 'none' END AS kind FROM part")
def figure_kinds(spark, d):
    t = case("p_partkey", 4, "如图，三个 圆圈互相交叠", "地图上有 五个国家", "2×10 方格图", "共有多少种")
    return table(spark, d, "part").select("p_partkey", T.figure_needed(t).alias("needed"), T.figure_kind(t).alias("kind"))


# ---- classification and reasons


@query(f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size / 50.0 < 0.75 THEN '{K.REASON_OCR_UNSURE}' END, CASE WHEN p_size % 10 < 8 THEN '{K.REASON_OCR_SHORT}' END, CASE WHEN p_partkey % 2 = 0 THEN '{K.REASON_UNSURE}' END], lambda x: x IS NOT NULL), '|') AS reasons,
  least(0.95, p_size / 100.0 + least(0.3, (p_size * 2 + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END) / 240.0) + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END) AS boosted FROM part""")
def recognition_reasons(spark, d):
    """Reasons of a reading, and its confidence with credit for Chinese text and a printed title."""
    even = F.col("p_partkey") % 2 == 0
    titled = F.concat(F.when(even, "例题3 ").otherwise(""), F.repeat(F.lit("汉"), F.col("p_size") * 2))
    classified = F.struct(F.when(even, F.array(F.lit(K.REASON_UNSURE))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    reasons = K.recognition_reasons(F.repeat(F.lit("汉"), F.col("p_size") % 10), F.col("p_size") / 50.0, classified)
    return table(spark, d, "part").select("p_partkey", F.array_join(reasons, "|").alias("reasons"), K.boosted_confidence(F.col("p_size") / 100.0, titled).alias("boosted"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'manual:' || p_brand ELSE 'rules:x' END AS c FROM part")
def manual_overrides(spark, d):
    ruled = F.struct(F.lit("g").alias("group"), F.lit("x").alias("category"), F.lit(0.5).alias("confidence"), F.lit("rules").alias("source"), F.array().cast("array<string>").alias("reasons"), F.lit(1).alias("best"), F.lit(0).alias("second"))
    given = F.when(F.col("p_partkey") % 3 == 0, F.lit("组"))
    c = K.manual_override(given, F.col("p_brand"), F.col("p_size") % 2 == 0, ruled)
    return table(spark, d, "part").select("p_partkey", F.concat(c["source"], F.lit(":"), c["category"]).alias("c"))


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{V.REASON_HIDDEN}|其他' WHEN 1 THEN '其他' WHEN 2 THEN '{T.REASON_NO_NUMBER}|其他' ELSE '{T.REASON_NO_NUMBER}|其他' END AS r,
  CASE WHEN p_size % 2 = 0 THEN 'Formula 1 requires review|其他' ELSE '其他' END AS f FROM part""")
def repaired_reasons(spark, d):
    """A titled text's missing number is a hidden second reading, unless that reading is unlike; formula reasons go once none waits."""
    reasons = F.array(F.lit(T.REASON_NO_NUMBER), F.lit("其他"))
    text, like = case("p_partkey", 4, "例题3 求", "练习2 求", "求", "求"), case("p_partkey", 4, 0.9, 0.1, 0.9, 0.1)
    formula = F.array(F.lit("Formula 1 requires review"), F.lit("其他"))
    return table(spark, d, "part").select("p_partkey", F.array_join(V.repair_reasons(reasons, text, like), "|").alias("r"), F.array_join(V.without_formula_reasons(formula, F.col("p_size") % 2 == 0), "|").alias("f"))


@query(f"""WITH {PROBLEMS} SELECT id FROM problems WHERE review_status = 'accepted' AND created_at % 3 = 0""")
def partial_export(spark, d):
    return X.strict_or_partial(problems(spark, d), (F.col("review_status") == "accepted") & (F.col("created_at") % 3 == 0), partial=True).select("id")


# ---- files


@query("""WITH f AS (SELECT 'in/../b/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.jpg' END AS path, p_partkey, sha256(p_name) AS h, CASE WHEN p_partkey % 5 = 0 THEN 40000000 ELSE 10 END AS n FROM part),
ok AS (SELECT *, 'in/b/' || split_part(path, '/', 4) AS rel FROM f WHERE p_partkey % 3 <> 1 AND n < 31457280)
SELECT left(sha256('batch' || chr(31) || rel || chr(31) || h), 32) AS id, split_part(path, '/', 4) AS filename, rel AS source_relative_path, h AS source_sha256, left(h, 12) || '.' || lower(split_part(path, '.', 4)) AS stored_name FROM ok""")
def ingested_files(spark, d):
    part = table(spark, d, "part")
    path = F.concat(F.lit("in/../b/"), F.col("p_partkey").cast("string"), case("p_partkey", 3, ".PNG", ".txt", ".jpg"))
    found = part.select(path.alias("path"), F.when(F.col("p_partkey") % 5 == 0, 40_000_000).otherwise(10).alias("length"), F.encode("p_name", "UTF-8").alias("content"))
    return files.ingest(found, F.lit("batch"), F.lit("now")).select("id", "filename", "source_relative_path", "source_sha256", "stored_name")


# ---- boxes


def _boxes(spark, d):
    """Each order's lineitems as boxes with scores."""
    b = F.struct((F.col("l_partkey") % 50).alias("x0"), (F.col("l_suppkey") % 50).alias("y0"), (F.col("l_partkey") % 50 + 5).alias("x1"), (F.col("l_suppkey") % 50 + 10).alias("y1"), F.col("l_quantity").cast("double").alias("score"), F.col("l_linenumber").alias("n"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(b).alias("boxes"))


_BOXES = "b AS (SELECT l_orderkey, l_partkey % 50 AS x0, l_suppkey % 50 AS y0, l_partkey % 50 + 5 AS x1, l_suppkey % 50 + 10 AS y1, l_quantity AS score, l_linenumber AS n FROM lineitem)"


@query(f"WITH {_BOXES} SELECT l_orderkey, greatest(0, min(x0) - 3) AS x0, greatest(0, min(y0) - 2) AS y0, least(52, max(x1) + 3) AS x1, least(60, max(y1) + 2) AS y1 FROM b GROUP BY 1")
def bounding_boxes(spark, d):
    u = G.union_box(F.col("boxes"), F.lit(3), F.lit(2), F.lit(52), F.lit(60))
    return _boxes(spark, d).select("l_orderkey", *[u[c].cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""WITH {_BOXES}, p AS (SELECT l_orderkey, count(*) AS n FROM (SELECT *, greatest(0, least(x1, 30) - greatest(x0, 10)) * greatest(0, least(y1, 40) - greatest(y0, 10)) AS shared FROM b) WHERE shared <= 0.25 * 50 GROUP BY 1)
SELECT DISTINCT b.l_orderkey, coalesce(p.n, 0) AS kept FROM b LEFT JOIN p USING (l_orderkey)""")
def uncovered_boxes(spark, d):
    figure = F.array(F.struct(F.lit(10).alias("x0"), F.lit(10).alias("y0"), F.lit(30).alias("x1"), F.lit(40).alias("y1")))
    return _boxes(spark, d).select("l_orderkey", F.size(G.without_covered(F.col("boxes"), figure, least_area=50)).cast("long").alias("kept"))


@query(f"""WITH {_BOXES}, t AS (SELECT x.l_orderkey FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey WHERE least(x.x1, y.x1) > greatest(x.x0, y.x0) AND least(x.y1, y.y1) > greatest(x.y0, y.y0))
SELECT l_orderkey, count(*) AS met FROM t GROUP BY 1""")
def overlapping_lines(spark, d):
    """How many (line, box) pairs of each page overlap, each page's boxes being its lines too."""
    met = G.overlapping(F.col("boxes"), F.col("boxes"))
    return _boxes(spark, d).select("l_orderkey", F.aggregate(met, F.lit(0), lambda a, x: a + F.size(x)).cast("long").alias("met"))


@query(f"""WITH {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS k FROM b)
SELECT l_orderkey, CAST(sum(score) FILTER (k <= 2) AS DOUBLE) AS best FROM r GROUP BY 1""")
def best_boxes(spark, d):
    """The scores of each page's two surest boxes, added up."""
    return _boxes(spark, d).select("l_orderkey", F.aggregate(G.best_boxes(F.col("boxes"), 2), F.lit(0.0), lambda a, b: a + b["score"]).alias("best"))


@query(f"""WITH {_BOXES}, w AS (SELECT l_orderkey, sum(greatest(1, n) * (1.0 + score / 10) / 5) / sum(greatest(1, n)) AS ratio FROM b GROUP BY 1) SELECT l_orderkey, CASE WHEN ratio < 1.2 THEN -90 ELSE 0 END AS turn FROM w WHERE abs(ratio - 1.2) > 1e-9""")
def rotation_hints(spark, d):
    """Lines as wide as their scores say, weighted by the lengths of their texts; pages on the very threshold are left out on both sides."""
    lines = F.transform("boxes", lambda b: F.struct(F.repeat(F.lit("x"), b["n"].cast("int")).alias("text"), F.struct((1.0 + b["score"] / 10).alias("w"), F.lit(5.0).alias("h")).alias("box")))
    total = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + F.greatest(F.lit(1), b["n"]))
    ratio = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + F.greatest(F.lit(1), b["n"]) * (1.0 + b["score"] / 10) / 5) / total
    return _boxes(spark, d).where(F.abs(ratio - 1.2) > 1e-9).select("l_orderkey", G.rotation_hint(lines).alias("turn"))


# ---- formulas


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b×' || p_size WHEN 1 THEN '√(x)≤2' WHEN 2 THEN 'x2+y' ELSE 'n' END AS seen, p_partkey % 4 = 3 AS simple FROM part""")
def visible_formulas(spark, d):
    latex = case("p_partkey", 4, F.concat(F.lit(r"\frac{a}{b}\times"), F.col("p_size").cast("string")), F.lit(r"\sqrt{x}\leq2"), F.lit(r"x^{2}+\left y"), F.lit(r"\mathrm{n}"))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(L.visible(latex), r"\s+", "").alias("seen"), L.simple(latex).alias("simple"))


@query("""SELECT p_partkey, 'text:求' || '|latex:' || p_size || '+3=' || (p_size + 3) || '|text:的值' AS parts FROM part""")
def inline_formulas(spark, d):
    text = F.concat(F.lit("求"), F.col("p_size").cast("string"), F.lit(" + 3 = "), (F.col("p_size") + 3).cast("string"), F.lit("的值"))
    parts = F.transform(B.split_text_and_latex(text), lambda b: F.concat(b["type"], F.lit(":"), F.coalesce(b["text"], b["latex"])))
    return table(spark, d, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"))


@query("SELECT p_partkey, 'formula-' || left(sha256(p_name), 12) || '-' || p_size || '-' || p_partkey % 9 AS id FROM part")
def formula_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", T.formula_id(F.encode("p_name", "UTF-8"), F.col("p_size"), F.col("p_partkey") % 9).alias("id"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '【例题】 求 \\(x+1\\)?' WHEN 1 THEN '【例题】 甲' || chr(10) || '\\[x+1\\]乙' ELSE '【例题】 甲［公式图像］' END AS t FROM part""")
def blocks_as_text(spark, d):
    text = lambda t, row=None: B.block("text", text=F.lit(t), row_index=F.lit(row).cast("int"))
    maths = lambda display, row=None, state=None: B.block("latex", latex=F.lit("x+1"), display=F.lit(display), row_index=F.lit(row).cast("int"), recognition_state=F.lit(state).cast("string"))
    of = case("p_partkey", 3, F.array(text("求 "), maths(False), text("?后面")), F.array(text("甲", 0), maths(True, 1), text("乙", 1)), F.array(text("甲"), maths(False, None, "human_verified_image")))
    return table(spark, d, "part").select("p_partkey", B.to_text(of, F.lit("【例题】")).alias("t"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'in:在n|进制' WHEN 1 THEN 'in:在|进制' ELSE 'in:在n进制' END AS t FROM part""")
def radix_variables(spark, d):
    """A letter lost between two blocks comes back where the source has one; blocks that still have it stay."""
    text = lambda t: B.block("text", text=F.lit(t))
    blocks = case("p_partkey", 3, F.array(text("in:在"), text("进制")), F.array(text("in:在"), text("进制")), F.array(text("in:在n进制")))
    out = B.restore_radix_variable(blocks, case("p_partkey", 3, "数在 n 进制中", "数在进制中", "数在 n 进制中"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(out, lambda b: b["text"]), "|").alias("t"))
