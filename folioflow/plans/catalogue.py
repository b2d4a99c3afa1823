"""Named queries over the test tables and their DuckDB equivalents.

The tables stand in for the catalogue's: documents with labels are problems
(sources are batches, languages groups), regions and nations a taxonomy,
orders versioned rows, events block rows and intervals, lineitem boxes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import similarity as S
from folioflow.functions import text as T
from folioflow.operators import blocks as B
from folioflow.operators import catalog as C
from folioflow.operators import classify as K
from folioflow.operators import exports as X
from folioflow.operators import figures as Fg
from folioflow.operators import latex as L
from folioflow.operators import layout as G
from folioflow.operators import review as V
from folioflow.operators import taxonomy as Y

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def problems(spark, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    q, t = F.col("quality"), F.col("toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("source").alias("batch_id"), F.col("lang").alias("category_group"), F.concat(F.lit("k"), F.col("doc_id") % 5).alias("category_key"), F.col("text").alias("ocr_text"),
        F.concat(F.lit("Doc-"), "doc_id", F.lit(".PNG")).alias("filename"), F.when(q == 1, "accepted").when(q == 0, "pending").otherwise("not_required").alias("review_status"), F.when(t == 1, "failed").otherwise("ready").alias("status"),
        (F.col("doc_id") % 97).alias("created_at"),
    )


PROBLEMS = """problems AS (
  SELECT d.doc_id AS id, d.source AS batch_id, d.lang AS category_group, 'k' || (d.doc_id % 5) AS category_key, d.text AS ocr_text, 'Doc-' || d.doc_id || '.PNG' AS filename,
    CASE WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'pending' ELSE 'not_required' END AS review_status,
    CASE WHEN toxic = 1 THEN 'failed' ELSE 'ready' END AS status, d.doc_id % 97 AS created_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
FP_SQL = r"sha256(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') || '|none')"


# ---- catalogue reads


@query(f"""
SELECT fp, max(doc_id) AS doc_id, count(*) AS copies
FROM (SELECT doc_id, {FP_SQL} AS fp FROM documents) GROUP BY fp""")
def publish_dedup_latest(spark, d):
    """Keep the latest document of each content fingerprint; texts stay out of the shuffle."""
    rows = table(spark, d, "documents").select("doc_id", T.content_fingerprint(F.col("text")).alias("fp"))
    return C.keep_latest(rows, F.col("fp"), ["doc_id"]).select("fp", "doc_id", "copies")


@query(f"""
SELECT content_fingerprint, count(*) AS n FROM (SELECT {FP_SQL} AS content_fingerprint FROM documents)
GROUP BY 1 HAVING count(*) > 1""")
def fingerprint_uniqueness_violations(spark, d):
    rows = table(spark, d, "documents").select(F.lit("published").alias("asset_state"), T.content_fingerprint(F.col("text")).alias("content_fingerprint"))
    return C.fingerprint_violations(rows)


@query(f"""WITH {PROBLEMS} SELECT id, created_at, category_group FROM problems ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20""")
def problem_page_newest(spark, d):
    return C.page(problems(spark, d), "created_at", "id", "newest", 50, 20).select("id", "created_at", "category_group")


@query(f"""WITH {PROBLEMS} SELECT id, created_at, category_group FROM problems WHERE category_group = 'en' AND category_key = 'k1' ORDER BY created_at NULLS FIRST, id NULLS FIRST LIMIT 30""")
def problem_page_oldest(spark, d):
    return C.page(C.search(problems(spark, d), "en", "k1"), "created_at", "id", "oldest", 30).select("id", "created_at", "category_group")


_LIKE = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH {PROBLEMS} SELECT id FROM problems WHERE contains({_LIKE.format(c='filename')}, 'erin') OR contains({_LIKE.format(c='ocr_text')}, 'erin')""")
def problem_search_like(spark, d):
    return C.search(problems(spark, d), q="  eRiN ").select("id")


@query(f"""WITH {PROBLEMS} SELECT count(*) AS total FROM problems WHERE category_group = 'fr' AND contains({_LIKE.format(c='ocr_text')}, 'que')""")
def problem_search_total(spark, d):
    return C.search(problems(spark, d), group="fr", q="QUE", fields=("ocr_text",)).agg(F.count("*").alias("total"))


@query(f"""WITH {PROBLEMS}, a AS (
  SELECT id, created_at, sha256(regexp_replace(lower(ocr_text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') || '|none') AS fp FROM problems WHERE review_status = 'accepted'
), k AS (SELECT fp, max({{'c': created_at, 'i': id}}) AS m, count(*) AS copies FROM a GROUP BY fp)
SELECT m.i AS id, m.c AS created_at, copies FROM k ORDER BY 2 DESC, 1 DESC LIMIT 50 OFFSET 10""")
def asset_page(spark, d):
    rows = C.assets(problems(spark, d).withColumn("asset_state", F.lit("published"))).select("id", "created_at", T.content_fingerprint(F.col("ocr_text")).alias("fp"))
    return C.page(C.keep_latest(rows, F.col("fp"), ["created_at", "id"]), "created_at", "id", "newest", 50, 10).select("id", "created_at", "copies")


@query("SELECT DISTINCT p_brand AS category_group, p_type AS category_key FROM part WHERE p_brand <> '' AND p_type <> ''")
def category_pairs(spark, d):
    return Y.pairs(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT p_brand AS category_group, p_type AS category_key, count(*) AS usage_count FROM part GROUP BY 1, 2")
def category_usage(spark, d):
    return Y.usage(table(spark, d, "part"), "p_brand", "p_type")


@query(f"""WITH {PROBLEMS}, r AS (
  SELECT batch_id, max(CASE WHEN review_status = 'pending' THEN 1 ELSE 0 END) p, max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) f FROM problems GROUP BY 1)
SELECT b.batch_id, CASE WHEN p IS NULL THEN 'empty' WHEN p = 1 THEN 'needs_review' WHEN f = 1 THEN 'partial' ELSE 'ready' END AS rolled_status
FROM (SELECT DISTINCT source AS batch_id FROM documents UNION ALL SELECT 'none') b LEFT JOIN r USING (batch_id)""")
def batch_status_rollup(spark, d):
    p = problems(spark, d)
    batches = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().unionByName(spark.createDataFrame([("none",)], "id string"))
    return C.batch_status(batches, p)


@query(f"""WITH {PROBLEMS} SELECT batch_id AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS ids FROM problems GROUP BY 1""")
def batch_with_problems(spark, d):
    p = problems(spark, d)
    nested = C.batch_with_problems(p.select(F.col("batch_id").alias("id")).distinct(), p)
    return nested.select("id", F.array_join(F.transform("problems", lambda x: x["id"].cast("string")), ",").alias("ids"))


# ---- taxonomy


def _nations(spark, d) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.concat(F.lit("g"), F.col("r_regionkey")).alias("group_id"), F.col("r_name").alias("group_name"), F.lit("builtin").alias("group_source"), (F.col("r_regionkey") != 3).alias("group_active"), F.col("r_regionkey").alias("group_pos"),
        F.concat(F.lit("c"), F.col("n_nationkey")).alias("category_id"), F.col("n_name").alias("category_name"), F.lit("builtin").alias("category_source"), ((F.col("n_nationkey") % 4 != 0) & (F.col("r_regionkey") != 3)).alias("category_active"), F.col("n_nationkey").alias("category_pos"),
    )


def _used(spark, d) -> DataFrame:
    """Customers' regions and nations; every tenth customer's nation has a name that the taxonomy lacks."""
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_custkey", F.col("r_name").alias("category_group"), F.when(F.col("c_custkey") % 10 == 0, F.concat("n_name", F.lit("?"))).otherwise(F.col("n_name")).alias("category_key"))


_USED = """used AS (SELECT c_custkey, r_name AS category_group, CASE WHEN c_custkey % 10 = 0 THEN n_name || '?' ELSE n_name END AS category_key
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_USED}, u AS (SELECT category_group, category_key, count(*) AS n FROM used GROUP BY 1, 2)
SELECT 'c' || n_nationkey AS category_id, coalesce(n, 0) AS category_usage, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY r_regionkey) AS BIGINT) AS group_usage
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN u ON category_group = r_name AND category_key = n_name""")
def taxonomy_usage_rollup(spark, d):
    return Y.usage_rollup(_nations(spark, d), Y.usage(_used(spark, d))).select("category_id", "category_usage", "group_usage")


@query(f"""WITH {_USED} SELECT DISTINCT category_group, category_key FROM used WHERE (category_group, category_key) NOT IN (SELECT (r_name, n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def taxonomy_unknown_pairs(spark, d):
    return Y.unknown_pairs(Y.pairs(_used(spark, d)), _nations(spark, d))


@query(f"""WITH {_USED}, m AS (SELECT DISTINCT category_group, category_key FROM used WHERE category_key LIKE '%?')
SELECT n_name AS category_name, 'builtin' AS category_source, n_nationkey AS category_pos FROM nation
UNION ALL SELECT category_key, 'historical', CAST(last + row_number() OVER (PARTITION BY category_group ORDER BY category_key) AS INTEGER) FROM m
JOIN (SELECT r_name, max(n_nationkey) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) ON r_name = category_group""")
def taxonomy_with_historical(spark, d):
    return Y.with_historical(_nations(spark, d), _used(spark, d)).select("category_name", "category_source", "category_pos")


@query(f"""WITH {_USED} SELECT c_custkey FROM used WHERE (category_group, category_key) IN (
  SELECT (r_name, n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 AND r_regionkey <> 3)""")
def active_pair_filter(spark, d):
    return Y.active_pairs(_used(spark, d), _nations(spark, d)).select("c_custkey")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_custkey AS c FROM orders),
n AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS s, o_custkey AS c FROM orders)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed'
  WHEN o.s IS NOT DISTINCT FROM n.s AND o.c IS NOT DISTINCT FROM n.c THEN 'same' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.id = n.id""")
def taxonomy_update_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    new = o.withColumns({"s": F.when(F.col("id") % 7 != 0, F.col("s")), "id": F.when(F.col("id") % 13 == 0, -1 - F.col("id")).otherwise(F.col("id"))})
    return Y.diff(o, new)


@query("SELECT 'name not normal' AS rule, n_name || '/' AS item FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'active category in inactive group', 'c' || n_nationkey FROM nation WHERE n_regionkey = 3 AND n_nationkey % 4 = 1")
def taxonomy_violations(spark, d):
    bad = _nations(spark, d).withColumns({"category_name": F.when(F.col("category_pos") == 3, F.concat("category_name", F.lit("/"))).otherwise(F.col("category_name")), "category_active": F.col("category_active") | ((F.col("group_pos") == 3) & (F.col("category_pos") % 4 == 1))})
    return Y.violations(bad)


# ---- classification, text, agreement of two readings

#: A rule pack in the test tables' languages.
_word = lambda w: rf"(?i)(?:^|[^\p{{L}}])(?:{w})(?:[^\p{{L}}]|$)"
PACK = (
    K.Rule("english", "articles", ((_word("the"), 2), (_word("and"), 1), ("tion", 2))),
    K.Rule("romance", "french", ((_word("les"), 3), ("eaux", 3), (_word("que"), 1))),
    K.Rule("romance", "spanish", ((_word("los"), 3), ("ción", 4), (_word("que"), 1))),
    K.Rule("german", "german", ((_word("und"), 3), ("sch", 2), ("keit", 2))),
)


def _pack_sql() -> str:
    score = lambda r: " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in r.terms)
    rules = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{r.group}' AS g, '{r.category}' AS c, {score(r)} AS s FROM documents" for i, r in enumerate(PACK))
    return f"""WITH r AS ({rules}), k AS (
  SELECT doc_id, g, c, s, row_number() OVER w AS n, lead(s) OVER w AS second FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY s DESC, i))
, f AS (SELECT doc_id, CASE WHEN s < 3 THEN '未分类' ELSE g END AS "group", CASE WHEN s < 3 THEN '未分类' ELSE c END AS category,
  CASE WHEN s < 3 THEN 0.0 ELSE round(CAST(least(0.98, 0.55 + 0.08 * (s - 3) + 0.04 * (s - second)) AS DOUBLE), 4) END AS confidence FROM k WHERE n = 1)"""


@query(f"""{_pack_sql()} SELECT doc_id, "group", category, confidence FROM f""")
def classify_rules(spark, d):
    c = K.classify_by_rules(F.col("text"), PACK, spaceless=False)
    return table(spark, d, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.group", "c.category", "c.confidence")


@query(f"""{_pack_sql()} SELECT doc_id, CASE WHEN confidence < 0.75 AND doc_id % 3 = 0 AND 0.8 >= confidence + 0.05 THEN 'model' ELSE category END AS category FROM f""")
def classify_cascade(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    said = docs.select("doc_id", F.lit("m").alias("group"), F.lit("model").alias("category"), F.when(F.col("doc_id") % 3 == 0, 0.8).otherwise(0.01).alias("confidence"))
    return K.cascade(docs, "doc_id", "text", said, PACK, spaceless=False).select("doc_id", "classification.category")


def _lines() -> Column:
    return F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), ((F.length(t) % 10) / 10.0).alias("confidence")))


@query("""SELECT doc_id, round(sum((len(t) % 10) / 10.0 * greatest(1, len(t))) / sum(greatest(1, len(t))), 6) AS confidence
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id""")
def ocr_weighted_confidence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(K.weighted_confidence(_lines()), 6).alias("confidence"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?::[0-9]+)?'), ',') AS numbers, len(list_distinct(regexp_extract_all(text, '[0-9]+(?::[0-9]+)?'))) AS n_distinct FROM documents")
def number_tokens(spark, d):
    n = T.numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(n, ",").alias("numbers"), F.size(F.array_distinct(n)).cast("long").alias("n_distinct"))


def _turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    a, b = c.where("role = 'user'").alias("a"), c.where("role <> 'user'").alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.col("a.text").alias("p"), F.col("b.text").alias("s"))


@query()
def similarity_ratio(spark, d):
    return _turns(spark, d).select("conv_id", "turn", S.similarity(F.col("p"), F.col("s"))["rounded"].alias("similarity"))


@query()
def number_conflicts(spark, d):
    j = _turns(spark, d).withColumn("like", S.text_similarity(F.col("p"), F.col("s")))
    return j.select("conv_id", "turn", S.number_conflict(F.col("p"), F.col("s"), F.col("like")).alias("conflict"))


@query("""WITH q AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents)
SELECT doc_id, '【练习' || (doc_id % 40) || '5】' AS title, len(regexp_replace(ltrim(t), '^[、，,. \\t]+', '')) + 1 AS n_body FROM q""")
def structured_problem(spark, d):
    """Whole documents as questions: the tables' prose has no question mark of its own."""
    head = F.regexp_replace("text", r"\s+", " ")
    rows = table(spark, d, "documents")
    text = F.concat(F.lit("眉【练习"), F.col("doc_id") % 40, F.lit("S】 "), head, F.lit("？尾"))
    p = S.structured_problem(text, F.lit(""))
    return rows.select("doc_id", p.alias("p")).select("doc_id", "p.title", F.length("p.body").cast("long").alias("n_body"))


@query()
def question_reading(spark, d):
    """Ellipsis repair, candidate scores and figure kinds on lines with punctuation put in."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("1、"), "text", F.when(F.col("doc_id") % 2 == 0, "•，那么2×10方格").otherwise("...多少？")).alias("t"))
    alternatives = F.array(F.struct(F.replace("t", F.lit("•"), F.lit("……")).alias("text"), F.lit(0.8).alias("confidence")))
    chosen = T.punctuation_candidate(F.col("t"), F.lit(0.82), alternatives)
    return docs.select("doc_id", chosen.alias("chosen"), T.ocr_candidate_score(chosen)["ellipsis"].alias("ellipsis"), T.figure_kind(F.col("t")).alias("figure"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '计数' WHEN p_partkey % 4 = 1 THEN '计数' WHEN p_partkey % 4 = 2 THEN '组合' ELSE '未分类' END AS "group",
CASE WHEN p_partkey % 4 = 0 THEN '染色问题' WHEN p_partkey % 4 = 1 THEN '计数综合' WHEN p_partkey % 4 = 2 THEN '抽屉原理' ELSE '未分类' END AS "key" FROM part""")
def legacy_categories(spark, d):
    name = F.element_at(F.array(F.lit("计数·染色问题"), F.lit("计数·别的"), F.lit(" 抽屉原理 "), F.lit("其他")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.legacy_category(name).alias("c")).select("p_partkey", "c.group", "c.key")


@query("SELECT p_partkey, 'a/' || p_brand || '/c.png' AS path, regexp_replace(p_name, '\\s+', '', 'g') || '-' AS part FROM part")
def safe_names(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", T.safe_relative_path(F.concat(F.lit("../a\\.\\"), "p_brand", F.lit("//c.png"))).alias("path"), F.concat(T.safe_name_part(F.concat(F.lit("/ "), "p_name", F.lit(" :*?"))), F.lit("-")).alias("part"))


# ---- blocks and layout


@query()
def formula_tokens(spark, d):
    b = B.split_text_and_latex(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.filter(b, lambda x: x["type"] == "latex")).alias("b")).select("doc_id", "b.source_text", "b.latex")


@query("""WITH e AS (SELECT user_id, event_type, sum(CASE WHEN event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT user_id, CAST(island AS BIGINT) AS island, any_value(event_type) AS event_type, count(*) AS n FROM e GROUP BY 1, 2""")
def content_rows(spark, d):
    e = B.change_islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""WITH RECURSIVE o AS (SELECT user_id, array_agg(CAST(value AS DOUBLE) ORDER BY value) AS a FROM events GROUP BY 1),
k AS (SELECT user_id, a, a[1] AS v, 1 AS n FROM o
  UNION ALL SELECT user_id, a, list_min(list_filter(a, lambda x: x - v >= 5.0)), n + 1 FROM k WHERE len(list_filter(a, lambda x: x - v >= 5.0)) > 0)
SELECT user_id, CAST(max(n) AS BIGINT) AS kept, round(max(v), 6) AS last FROM k GROUP BY 1""")
def anchor_dedup(spark, d):
    """Values at least 5 after the last kept one, per user; the arrays hold one user's events."""
    k = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value").cast("double")).alias("a")).select("user_id", G.far_from_last_kept(F.col("a"), F.lit(5.0)).alias("k"))
    return k.select("user_id", F.size("k").cast("long").alias("kept"), F.round(F.element_at("k", -1), 6).alias("last"))


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@query("SELECT event_id, round(coalesce(lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts), epoch(ts) + 60) - epoch(ts), 3) AS span FROM events")
def region_spans(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", _seconds("ts").alias("s"))
    return G.spans(e, ["user_id"], "s", F.col("s") + 60).select("event_id", F.round(F.col("span_end") - F.col("s"), 3).alias("span"))


@query("""WITH g AS (SELECT user_id, epoch(ts) AS s, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200 THEN 1 ELSE 0 END AS j FROM events),
c AS (SELECT user_id, s, sum(j) OVER (PARTITION BY user_id ORDER BY s) AS cluster FROM g)
SELECT user_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n FROM c GROUP BY 1, 2""")
def gap_clusters(spark, d):
    e = table(spark, d, "events").select("user_id", _seconds("ts").alias("s"))
    return G.gap_clusters(e, ["user_id"], "s", 43200).groupBy("user_id", F.col("cluster").cast("long").alias("cluster")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT user_id, epoch(ts) AS a, epoch(ts) + 21600 AS b FROM events),
n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600 THEN 1 ELSE 0 END AS j FROM i),
c AS (SELECT user_id, a, b, sum(j) OVER (PARTITION BY user_id ORDER BY a, b) AS k FROM n)
SELECT user_id, round(min(a), 3) AS a, round(max(b), 3) AS b, count(*) AS parts FROM c GROUP BY user_id, k""")
def interval_merge(spark, d):
    i = table(spark, d, "events").select("user_id", _seconds("ts").alias("a")).withColumn("b", F.col("a") + 21600)
    return G.merge_intervals(i, ["user_id"], "a", "b", 3600).select("user_id", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "parts")


def _page_lines(spark, d) -> DataFrame:
    """Documents' lines as a page: two to a row, numbered as a question, in a place that the row's number gives."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("lines")).select("page_id", (F.lit(0.9) / F.ceil(F.size("lines") / 2)).alias("step"), F.posexplode("lines").alias("i", "t"))
    text = F.when(F.col("i") == 0, F.concat(F.lit("例题3 "), "t")).when(F.col("i") == 3, F.concat("t", F.lit("？"))).otherwise(F.col("t"))
    row = F.floor(F.col("i") / 2)
    return rows.select("page_id", text.alias("text"), F.lit(0.9).alias("confidence"), (0.08 + 0.45 * (F.col("i") % 2)).alias("x"), (0.96 - (row + 1) * F.col("step")).alias("y"), F.lit(0.4).alias("w"), (F.col("step") * 0.75).alias("h"))


@query()
def reading_order(spark, d):
    return G.ordered_text(_page_lines(spark, d))


@query()
def page_regions(spark, d):
    """Pages of two numbered questions each, split at their anchors."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("t"))
    line = lambda text, y: F.struct(text.alias("text"), F.lit(0.9).alias("confidence"), F.struct(F.lit(0.1).alias("x"), F.lit(y).alias("y"), F.lit(0.72).alias("w"), F.lit(0.035).alias("h")).alias("box"))
    lines = F.array(line(F.lit("例题6、求和。"), 0.86), line(F.concat("t", F.lit("？")), 0.8), line(F.concat(F.lit("例题7、"), "t", F.lit("多少？")), 0.4))
    pages = docs.select(F.col("doc_id").alias("page_id"), lines.alias("lines"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), F.lit(None).cast("array<struct<x0:int,y0:int,x1:int,y1:int>>").alias("formula_boxes"))
    return G.page_regions(pages)


def _box(c: str) -> Column:
    v = F.col(c)
    return F.struct((v % 50).cast("int").alias("x0"), (v % 30).cast("int").alias("y0"), (v % 50 + 10).cast("int").alias("x1"), (v % 30 + 5).cast("int").alias("y1"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, least(l_partkey % 50, l_suppkey % 50) + 10 - greatest(l_partkey % 50, l_suppkey % 50)) * greatest(0, least(l_partkey % 30, l_suppkey % 30) + 5 - greatest(l_partkey % 30, l_suppkey % 30)) AS overlap
FROM lineitem""")
def box_overlap(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", G.intersection(_box("l_partkey"), _box("l_suppkey")).cast("long").alias("overlap"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 10 <= 3 THEN p_size - p_size % 10 WHEN p_size % 10 >= 7 THEN p_size - p_size % 10 + 10 ELSE p_size END AS DOUBLE) AS snapped FROM part")
def nearest_snap(spark, d):
    grid = F.array(*[F.lit(float(v)) for v in range(0, 110, 10)])
    return table(spark, d, "part").select("p_partkey", G.nearest(F.col("p_size").cast("double"), grid, F.lit(3.0)).alias("snapped"))


@cache
def _room_edges(columns: int, rows: int, side: int = 40) -> str:
    """The pairs of rooms that share a wall in a drawing of a grid, found from its pixels; a worker draws each size once."""
    xs, ys = [10 + side * i for i in range(columns + 1)], [10 + side * i for i in range(rows + 1)]
    walls = np.zeros((ys[-1] + 11, xs[-1] + 11), bool)
    for x in xs:
        walls[10 : ys[-1] + 1, x - 1 : x + 2] = True
    for y in ys:
        walls[y - 1 : y + 2, 10 : xs[-1] + 1] = True
    labels, inside = Fg.interior_regions(walls)
    names = {label: f"r{i:02}" for i, (label, _) in enumerate(sorted(inside.items(), key=lambda r: (r[1][1], r[1][0])), 1)}
    pairs = Fg.adjacency(labels, names, [(xs[0], y, xs[-1], y) for y in ys], [(x, ys[0], x, ys[-1]) for x in xs])
    return ",".join(f"{a}-{b}" for a, b in pairs)


def _edges(columns: pd.Series, rows: pd.Series) -> pd.Series:
    """Each row's pairs; a grid whose sizes are null or under one has no rooms, so no pairs."""
    return pd.Series([_room_edges(int(c), int(r)) if c > 0 and r > 0 else "" for c, r in zip(columns, rows, strict=True)], dtype="str")


@query("""WITH g AS (SELECT p_partkey, 1 + p_size % 4 AS columns, 1 + p_partkey % 3 AS rows FROM part),
c AS (SELECT p_partkey, columns, rows, y, x, y * columns + x + 1 AS i FROM (SELECT *, unnest(range(columns)) AS x FROM (SELECT *, unnest(range(rows)) AS y FROM g)))
SELECT p_partkey, coalesce(string_agg(e, ',' ORDER BY e), '') AS edges FROM (
  SELECT p_partkey, columns, rows FROM g) LEFT JOIN (
  SELECT p_partkey, 'r' || lpad(CAST(i AS VARCHAR), 2, '0') || '-r' || lpad(CAST(i + 1 AS VARCHAR), 2, '0') AS e FROM c WHERE x + 1 < columns
  UNION ALL SELECT p_partkey, 'r' || lpad(CAST(i AS VARCHAR), 2, '0') || '-r' || lpad(CAST(i + columns AS VARCHAR), 2, '0') FROM c WHERE y + 1 < rows) USING (p_partkey) GROUP BY p_partkey""")
def adjacency_edges(spark, d):
    """Which regions of a drawn map face each other across a line: each part is a grid of rooms of its size."""
    part = table(spark, d, "part").select("p_partkey", (1 + F.col("p_size") % 4).alias("columns"), (1 + F.col("p_partkey") % 3).alias("rows"))
    return part.select("p_partkey", F.pandas_udf(_edges, "string")("columns", "rows").alias("edges"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean, round(CAST(list_sort(embedding)[CAST(floor((len(embedding) - 1) * 0.05) AS INTEGER) + 1] AS DOUBLE), 6) AS p05 FROM embeddings""")
def token_probability_stats(spark, d):
    p = L.token_probabilities(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round("p.mean", 6).alias("mean"), F.round("p.p05", 6).alias("p05"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unbalanced' WHEN 2 THEN 'nesting' WHEN 3 THEN 'command' WHEN 4 THEN 'environment' ELSE NULL END AS problem,
CASE p_partkey % 6 WHEN 0 THEN '\\frac{' || p_size || '}{2}' WHEN 5 THEN '3 \\times ' || p_size END AS latex FROM part""")
def latex_validation(spark, d):
    n = F.col("p_size").cast("string")
    source = F.element_at(F.array(F.concat(F.lit("$\\frac {"), n, F.lit(" } {2}$")), F.concat(n, F.lit("}{")), F.concat(F.lit("{"), n), F.concat(F.lit("\\input{"), n, F.lit("}")), F.concat(F.lit("\\begin{tikz}"), n, F.lit("\\end{tikz}")), F.concat(F.lit("3  \\times "), n)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", L.problem(L.normalize(source)).alias("problem"), L.validated(source).alias("latex"))


# ---- review


def _reasons() -> Column:
    k = F.col("doc_id") % 6
    return F.array_compact(F.array(F.when(k == 0, V.REASON_NO_TRUTH), F.when(k.isin(0, 1), T.REASON_NUMBERS), F.when(k == 2, "Formula 1 requires review"), F.when(k == 3, "重建题干过短"), F.when(k == 4, V.REASON_HIDDEN), F.when(k < 3, "别的")))


@query(f"""WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 6 = 0 THEN 'warning|{V.DETAIL_NO_TRUTH[0]}' END, CASE WHEN doc_id % 6 IN (0, 1) THEN 'critical|{V.DETAIL_NUMBERS}' END,
  CASE WHEN doc_id % 6 = 2 THEN 'warning|{V.DETAIL_FORMULA_REVIEW[0]}' END, CASE WHEN doc_id % 6 = 3 THEN 'critical|重建题干过短' END, CASE WHEN doc_id % 6 < 3 THEN 'warning|别的' END,
  CASE WHEN doc_id % 10 = 0 THEN 'critical|{V.TITLE_FAILED}' END], lambda x: x IS NOT NULL)) AS x FROM documents)
SELECT split_part(x, '|', 1) AS severity, split_part(x, '|', 2) AS title, count(*) AS n FROM r GROUP BY 1, 2""")
def review_diagnostics(spark, d):
    none = F.array().cast("array<string>")
    said = V.diagnostics(_reasons(), none, none, F.when(F.col("doc_id") % 10 == 0, "ValueError: x"))
    return table(spark, d, "documents").select(F.explode(said).alias("x")).groupBy("x.severity", "x.title").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, array_to_string(list_filter(['旧', CASE WHEN doc_id % 6 = 0 THEN '{V.REASON_NO_TRUTH}' END, CASE WHEN doc_id % 6 IN (0, 1) THEN '{T.REASON_NUMBERS}' END, CASE WHEN doc_id % 6 = 2 THEN 'Formula 1 requires review' END,
  CASE WHEN doc_id % 6 = 3 THEN '重建题干过短' END, CASE WHEN doc_id % 6 = 4 THEN '{V.REASON_HIDDEN}' END, CASE WHEN doc_id % 6 < 3 THEN '别的' END], lambda x: x IS NOT NULL), ';') AS resolved,
  CASE WHEN doc_id % 6 = 5 THEN 'dual_ocr_consistent' ELSE 'manual_review_required' END AS gate, CASE WHEN doc_id % 6 = 5 THEN 'ready' ELSE 'needs_review' END AS status FROM documents""")
def resolve_reasons(spark, d):
    r = _reasons()
    return table(spark, d, "documents").select("doc_id", F.array_join(V.resolve_reasons(r, F.array(F.lit("旧")))["resolved_review_reasons"], ";").alias("resolved"), V.quality_gate(r, F.lit(True))["gate"].alias("gate"), V.status_decision(r, F.lit(None).cast("string"))["status"].alias("status"))


@query("""WITH last AS (SELECT user_id, max(event_id) AS v FROM events GROUP BY 1),
c AS (SELECT user_id, event_id - event_id % 3 AS expected, min(event_id) AS nv, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT user_id, max(CASE WHEN expected = v THEN nv END) AS nv, sum(n) AS asked FROM c LEFT JOIN last USING (user_id) GROUP BY 1)
SELECT user_id, coalesce(nv, v) AS version, CASE WHEN asked IS NULL THEN 'unchanged' WHEN nv IS NOT NULL THEN 'applied' ELSE 'conflict' END AS outcome,
CAST(coalesce(asked, 0) - CASE WHEN nv IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS refused FROM last LEFT JOIN m USING (user_id)""")
def cas_apply(spark, d):
    e = table(spark, d, "events")
    current = e.groupBy("user_id").agg(F.max("event_id").alias("version"), F.lit("old").alias("state"))
    changes = e.select("user_id", (F.col("event_id") - F.col("event_id") % 3).alias("expected"), F.col("event_id").alias("new_version"), F.lit("new").alias("state"))
    return C.apply_cas(current, changes, "user_id", "version", ["state"]).select("user_id", "version", "outcome", "refused")


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey || '-' || lpad(CAST(i AS VARCHAR), 2, '0') AS id, CAST(l_orderkey AS VARCHAR) AS parent_source_id, CAST(i AS INTEGER) AS page_index, CAST(n AS INTEGER) AS page_total FROM l JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)""")
def split_children(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    regions = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("parent_id"), *order, F.lit("x").alias("split_label"))
    return C.split_children(parents, regions, order).select("id", "parent_source_id", "page_index", "page_total")


@query("""WITH e AS (SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'auto_verified' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'human_verified' ELSE 'other' END AS s FROM events)
SELECT event_type, count(*) FILTER (s = 'auto_verified') AS auto_verified, count(*) FILTER (s = 'needs_review') AS needs_review, count(*) FILTER (s = 'image_fallback') AS image_fallback,
count(*) FILTER (s = 'human_verified') AS human_verified, count(*) FILTER (s = 'human_verified_image') AS human_verified_image FROM e GROUP BY 1""")
def state_histogram(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("auto_verified", "needs_review", "human_verified", "other", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    return V.state_histogram(table(spark, d, "events").select("event_type", s.alias("s")), "s", V.STATES, "event_type")


# ---- exports


def _export(spark, d) -> DataFrame:
    p = problems(spark, d)
    return p.withColumns({"selected_artifact": F.when(F.col("id") % 9 != 0, "a/question.png"), "category": F.when(F.col("id") % 2 == 0, F.col("category_key")).otherwise("x"), "selected_kind": F.when(F.col("id") % 3 == 0, "reconstructed").otherwise("cleaned"), "accepted_at": F.lit(None).cast("string"), "updated_at": F.col("created_at").cast("string"), "title": F.lit("")})


@query(f"""WITH {PROBLEMS}, s AS (SELECT *, status = 'ready' OR review_status = 'accepted' AS settled, id % 9 <> 0 AS art, ocr_text <> '' AS txt FROM problems)
SELECT category_group, count(*) FILTER (art AND txt AND settled) AS pdf, count(*) FILTER (art AND txt AND settled AND id % 2 = 0) AS docx, count(*) FILTER (review_status = 'accepted' AND id % 3 = 0 AND art AND txt) AS markdown FROM s GROUP BY 1""")
def export_eligibility(spark, d):
    return _export(spark, d).groupBy("category_group").agg(F.count_if(X.pdf_eligible()).alias("pdf"), F.count_if(X.docx_eligible()).alias("docx"), F.count_if(X.markdown_eligible()).alias("markdown"))


_OUTLINE = f"""WITH {PROBLEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) AS pos FROM problems),
g AS (SELECT *, min(pos) OVER (PARTITION BY batch_id, category_group) AS g, min(pos) OVER (PARTITION BY batch_id, category_group, category_key) AS c FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY g, c, pos) AS number, count(*) OVER (PARTITION BY batch_id) AS total FROM g)"""


@query(f"""{_OUTLINE} SELECT id, CAST(number AS INTEGER) AS number, number % 2 = 0 AND number < total AS break_after FROM o""")
def export_outline(spark, d):
    return X.outline(_export(spark, d).drop("ocr_text"), ["created_at", "id"], ["batch_id"]).select("id", "number", "break_after")


@query(f"""WITH {PROBLEMS}, n AS (SELECT batch_id, category_group AS g, count(*) AS n FROM problems GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, g) AS k FROM n)
SELECT batch_id, '20260724-1123-' || string_agg(g || n, '-' ORDER BY k) FILTER (k <= 3) || CASE WHEN max(k) > 3 THEN '-等' || (max(k) - 3) || '类' ELSE '' END || '-K7M2' AS name FROM r GROUP BY 1""")
def export_basename(spark, d):
    tops = X.top_groups(problems(spark, d), ["batch_id"], "category_group")
    return tops.select("batch_id", X.export_basename(F.col("parts"), F.col("remain"), F.lit("2026-07-24 11:23:00").cast("timestamp"), F.lit("K7M2")).alias("name"))


@query()
def pdf_layout(spark, d):
    return X.pdf_layout(X.outline(_export(spark, d).drop("ocr_text"), ["created_at", "id"], ["batch_id"]), "batch_id")


_HEADED = f"""{_OUTLINE}, h AS (SELECT batch_id, CAST(number AS INTEGER) AS number, CAST(id AS VARCHAR) AS id, coalesce(nullif(category_group, ''), '未分类') AS g, category_key AS c, coalesce(ocr_text, '') AS body, number % 2 = 0 AND number < total AS breaks,
  category_group IS DISTINCT FROM lag(category_group) OVER w AS ng, category_group IS DISTINCT FROM lag(category_group) OVER w OR category_key IS DISTINCT FROM lag(category_key) OVER w AS nc FROM o WINDOW w AS (PARTITION BY batch_id ORDER BY number))"""


@query(f"""{_HEADED}, p AS (
  SELECT batch_id, number, 1 AS rank, 'Heading 1' AS style, g AS text FROM h WHERE ng UNION ALL SELECT batch_id, number, 2, 'Heading 2', c FROM h WHERE nc
  UNION ALL SELECT batch_id, number, 3, 'Heading 3', '题目 ' || number FROM h UNION ALL SELECT batch_id, number, 4, 'Normal', body FROM h
  UNION ALL SELECT batch_id, number, 5, 'Space 45mm', '' FROM h UNION ALL SELECT batch_id, number, 6, 'Page break', '' FROM h WHERE breaks)
SELECT batch_id, number, rank, style, sha256(text) AS text_sha256 FROM p""")
def docx_layout(spark, d):
    """Every paragraph of every export; whole texts go into a hash."""
    rows = X.docx_layout(X.outline(_export(spark, d), ["created_at", "id"], ["batch_id"]))
    return rows.select("batch_id", "number", "rank", "style", F.sha2("text", 256).alias("text_sha256"))


@query(f"""{_HEADED}, k AS (SELECT *, 'mb-' || left(sha256('group' || chr(31) || g), 16) AS ag, 'mb-' || left(sha256('category' || chr(31) || g || chr(31) || c), 16) AS ac, 'mb-' || left(sha256('problem' || chr(31) || id), 16) AS ap FROM h),
l AS (SELECT batch_id, 0 AS part, number, 0 AS rank, '- [[#^' || ag || '|' || g || ']]' AS line FROM k WHERE ng
  UNION ALL SELECT batch_id, 0, number, 1, '  - [[#^' || ac || '|' || c || ']]' FROM k WHERE nc UNION ALL SELECT batch_id, 0, number, 2, '    - [[#^' || ap || '|题目 ' || number || ']]' FROM k
  UNION ALL SELECT batch_id, 1, number, 0, chr(10) || '## ' || g || ' ^' || ag FROM k WHERE ng UNION ALL SELECT batch_id, 1, number, 1, chr(10) || '### ' || c || ' ^' || ac FROM k WHERE nc
  UNION ALL SELECT batch_id, 1, number, 2, chr(10) || '#### 题目 ' || number || ' ^' || ap FROM k UNION ALL SELECT batch_id, 1, number, 3, chr(10) || body FROM k
  UNION ALL SELECT batch_id, 1, number, 4, chr(10) || '{X.ANSWER_SPACE}' FROM k UNION ALL SELECT batch_id, 1, number, 5, chr(10) || '{X.PAGE_BREAK}' FROM k WHERE breaks)
SELECT batch_id, part, number, rank, sha256(line) AS line_sha256 FROM l""")
def markdown_lines(spark, d):
    """Every line of every note, contents and body; whole texts go into a hash."""
    o = X.outline(_export(spark, d).withColumn("body", F.array(T.text_of(F.col("ocr_text")))), ["created_at", "id"], ["batch_id"])
    return X.markdown_lines(o).select("batch_id", "part", "number", "rank", F.sha2("line", 256).alias("line_sha256"))


@query("SELECT n_nationkey, 'mb-' || left(sha256('group' || chr(31) || n_name), 16) AS anchor, '\\*' || replace(n_name, '_', '\\_') || '\\_' AS escaped FROM nation")
def anchors_sha(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.anchor_id(F.lit("group"), F.col("n_name")).alias("anchor"), T.escape_markdown(F.concat(F.lit("*"), "n_name", F.lit("_"))).alias("escaped"))


@query()
def process_problems(spark, d):
    """Recognised lines to gated rows, for all documents as pages."""
    from folioflow.plans.processing import process

    p = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("split_label"))
    lines = _page_lines(spark, d).withColumnRenamed("page_id", "id")
    second = lines.where("x < 0.1").groupBy("id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("o"), "text"))), lambda z: z["text"])).alias("text"))
    out = process(p, lines, second, Y.seed(spark))
    return out.select("id", "category_group", "category_key", "status", "gate", "content_fingerprint", F.col("structured.title").alias("title"), F.array_join("review_reasons", ";").alias("reasons"), F.size("content_blocks").alias("n_blocks"))


@query(f"""WITH {PROBLEMS} SELECT batch_id, count(*) AS sample_count, count(*) FILTER (review_status = 'accepted') AS passed_count, count(*) FILTER (review_status = 'pending') AS review_count FROM problems GROUP BY 1""")
def evaluation_report(spark, d):
    return V.evaluation_report(problems(spark, d), F.col("review_status") == "accepted", F.col("review_status") == "pending", ["batch_id"])


# ---- writes as snapshots


@query(f"""WITH d AS (SELECT doc_id, {FP_SQL} AS fp FROM documents), old AS (SELECT fp, max(doc_id) AS o FROM d GROUP BY 1),
new AS (SELECT fp, max(doc_id) AS n FROM d JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT coalesce(n, o) AS id, CAST(CASE WHEN n IS NOT NULL AND o <> n THEN 1 ELSE 0 END AS BIGINT) AS n_replaced FROM old LEFT JOIN new USING (fp)""")
def publish_replace(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.content_fingerprint(F.col("text")).alias("content_fingerprint"))
    published = C.keep_latest(docs, F.col("content_fingerprint"), ["id"]).drop("copies")
    accepted = docs.join(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id")
    out = C.publish(published.withColumn("id", F.col("id").cast("string")), accepted.withColumn("id", F.col("id").cast("string")).withColumn("n", F.col("id").cast("long")), ["n"])
    return out.select(F.col("id").cast("long").alias("id"), F.size("replaced_ids").cast("long").alias("n_replaced"))


@query(f"""WITH {PROBLEMS}, p AS (SELECT id, created_at, review_status, sha256(regexp_replace(lower(ocr_text), '[^\\p{{L}}\\p{{N}}]+', '', 'g') || '|none') AS fp, id % 4 = 0 AS was FROM problems),
a AS (SELECT fp, max({{'c': created_at, 'i': id}}) AS m FROM p WHERE review_status = 'accepted' GROUP BY 1)
SELECT m.i AS id, 'published' AS asset_state FROM a UNION ALL SELECT id, 'workbench' FROM p WHERE review_status <> 'accepted'""")
def migrate_assets(spark, d):
    p = problems(spark, d).withColumns({"updated_at": F.col("created_at"), "accepted_at": F.lit(None).cast("long"), "asset_state": F.when(F.col("id") % 4 == 0, "published").otherwise("workbench"), "figure": F.lit(""), "selected_artifact": F.lit("question.png"), "selected_kind": F.lit(""), "content_fingerprint": F.lit(None).cast("string")})
    return C.migrate_assets(p).select("id", "asset_state")


@query("""WITH c AS (SELECT l_orderkey, max(l_returnflag) AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, coalesce(f, o_orderstatus) AS status, CASE WHEN f IS NULL THEN 'old' ELSE 'new' END AS updated_at FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def allow_list_update(spark, d):
    now = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("old").alias("updated_at"))
    changes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_returnflag").alias("status"), F.lit("x").alias("id_of_nobody"))
    return C.apply_updates(now, changes, "id", F.lit("new"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_cascade(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("a").alias("source_path"), F.lit("b").alias("selected_artifact"))
    left, _ = C.delete(p, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))
    return left.select("id")


@query("SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT trim(left(p_type, 24)) FROM part")
def ensure_categories(spark, d):
    part = table(spark, d, "part")
    known = part.select(F.sha2("p_brand", 256).alias("id"), F.col("p_brand").alias("name"), F.lit("").alias("description"), F.lit("0").alias("created_at")).distinct()
    return C.ensure_categories(part.select(F.col("p_type").alias("name")), known, F.lit("1")).select("name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)")
def reference_violations(spark, d):
    """Orders of customers that are not there: every eleventh is taken away, since the tables have no orphans."""
    from folioflow.sources.schema import orphans

    return orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_custkey % 11 <> 0"), "c_custkey").select("o_orderkey")


# ---- taxonomy views and review


@query("SELECT 'c' || n_nationkey AS category_id FROM nation WHERE n_nationkey % 4 <> 0 AND n_regionkey <> 3")
def active_categories(spark, d):
    return Y.active(_nations(spark, d), builtin_only=True).select("category_id")


@query(f"""WITH {_USED}, k AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 AND r_regionkey <> 3)
SELECT c_custkey, CASE WHEN n_name IS NULL THEN '未分类' ELSE category_key END AS category_key, CASE WHEN n_name IS NULL THEN '停用' ELSE '' END AS reasons FROM used LEFT JOIN k ON r_name = category_group AND n_name = category_key""")
def deactivated_override(spark, d):
    used = _used(spark, d).withColumn("review_reasons", F.array().cast("array<string>"))
    return Y.deactivated_override(used, _nations(spark, d), "停用").select("c_custkey", "category_key", F.array_join("review_reasons", ";").alias("reasons"))


@query(f"""WITH {_USED}, k AS (SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 0 AND r_regionkey <> 3)
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'excluded' WHEN c_custkey % 7 = 0 THEN 'conflict' WHEN c_custkey % 3 = 0 THEN 'unresolved_formula' WHEN n_name IS NULL THEN 'inactive_category' ELSE 'accepted' END AS outcome
FROM used LEFT JOIN k ON r_name = category_group AND n_name = category_key""")
def review_outcomes(spark, d):
    k = F.col("c_custkey")
    p = _used(spark, d).select(k.alias("id"), "category_group", "category_key", F.lit("pending").alias("review_status"), F.lit("1").alias("updated_at"), (k % 3 == 0).alias("unresolved"))
    actions = table(spark, d, "customer").select(k.alias("id"), F.when(k % 5 == 0, "exclude").otherwise("accept").alias("action"), F.when(k % 7 == 0, "0").otherwise("1").alias("expected"), F.lit(None).cast("string").alias("group"), F.lit(None).cast("string").alias("category_new"))
    return V.review(p, actions, Y.active(_nations(spark, d)), F.lit("2")).select("id", "outcome")


def _formulas(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("problem_id"), F.col("event_id").alias("formula_id"), F.lit("a").alias("latex"), F.when(F.col("event_type") == "click", "needs_review").otherwise("auto_verified").alias("recognition_state"))


@query("SELECT event_id AS formula_id, CASE WHEN event_id % 3 = 0 THEN 'kept' ELSE 'a' END AS latex, CASE WHEN event_id % 3 = 0 THEN 'human_verified' WHEN event_type = 'click' THEN 'needs_review' ELSE 'auto_verified' END AS recognition_state FROM events")
def human_edits_carried_over(spark, d):
    new = _formulas(spark, d)
    before = new.withColumns({"latex": F.lit("kept"), "recognition_state": F.when(F.col("formula_id") % 3 == 0, "human_verified").otherwise("needs_review")})
    return V.carry_over(new, before).select("formula_id", "latex", "recognition_state")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END AS bad FROM events), b AS (SELECT user_id, max(bad) AS bad FROM e GROUP BY 1)
SELECT event_id AS formula_id, CASE WHEN b.bad = 0 THEN 'x+1' ELSE 'a' END AS latex FROM e JOIN b USING (user_id)""")
def formula_edits(spark, d):
    """Every formula edited; a problem with one refused edit keeps all its formulas."""
    f = _formulas(spark, d)
    edits = f.select("problem_id", "formula_id", F.when(F.col("formula_id") % 997 == 0, "\\input{x}").otherwise("x+1").alias("latex"), F.lit(False).alias("as_image"))
    return V.edit_formulas(f, edits, L.valid)[0].select("formula_id", "latex")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size >= 10 THEN 'auto_verified' WHEN p_partkey % 3 = 2 THEN 'image_fallback' ELSE 'needs_review' END AS state FROM part""")
def formula_verification(spark, d):
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    mean = F.when(n >= 10, 0.9).otherwise(0.7)
    variant = lambda latex: F.struct(latex.alias("latex"), mean.alias("mean"), F.lit(0.5).alias("p05"), F.lit(True).alias("eos"), F.lit(False).alias("unk"))
    first = F.when(k == 2, "\\input{a}").otherwise(F.concat(F.lit("x^{"), n.cast("string"), F.lit("}")))
    second = F.when(k == 1, F.concat(F.lit("y^{"), n.cast("string"), F.lit("}"))).otherwise(first)
    return table(spark, d, "part").select("p_partkey", L.verification(variant(first), variant(second))["state"].alias("state"))


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'image' ELSE 'text' END AS t, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS r FROM events),
w AS (SELECT *, lag(t) OVER o AS pt, last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CASE WHEN pt IS NULL OR t = 'image' OR pt = 'image' OR (r IS NOT NULL AND pr IS NOT NULL AND r <> pr) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS row_no FROM w""")
def block_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "click", "image").otherwise("text").alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5).alias("r"))
    return B.rows(e, ["user_id"], ["ts", "event_id"], row="r").select("event_id", F.col("row_no").cast("long").alias("row_no"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_discount * 1000, 0) AS INTEGER) AS x0, CAST(least(1000, round_even((l_discount + l_tax) * 1000, 0)) AS INTEGER) AS x1 FROM lineitem""")
def pixel_boxes(spark, d):
    box = F.struct(F.col("l_discount").alias("x"), F.lit(0.25).alias("y"), F.col("l_tax").alias("w"), F.lit(0.5).alias("h"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", G.pixel_box(box, F.lit(1000), F.lit(800)).alias("b")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.x0", "b.x1")


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS passed FROM nation")
def grid_figures(spark, d):
    """A drawn grid per nation, every second one with a line too few, through the figure kernels and their gate."""
    import numpy as np
    import pandas as pd

    from folioflow.operators import figures as Fig
    from folioflow.operators.image import encode_png

    def draw(batches):
        for b in batches:
            out = []
            for k in b["n_nationkey"]:
                xs = range(30, 331, 30) if k % 2 == 0 else range(30, 301, 30)
                lines = [(30, y, xs[-1], y) for y in (40, 70, 100)] + [(x, 40, x, 100) for x in xs]
                picture = np.full((140, 360, 3), 255, np.uint8)
                picture[Fig.line_mask((140, 360), lines, 4)] = 0
                out.append((k, encode_png(picture), "grid_2x10", None, None))
            yield pd.DataFrame(out, columns=["n_nationkey", "content", "kind", "expected", "places"])

    drawn = table(spark, d, "nation").select("n_nationkey").mapInPandas(draw, "n_nationkey int, content binary, kind string, expected array<string>, places map<string,array<int>>")
    return Fig.reconstruct_images(drawn, "n_nationkey", "content").select("n_nationkey", Fig.passed().alias("passed"))


# ---- lookups, public views, canonical forms


@query(f"""WITH {PROBLEMS} SELECT id, batch_id, category_group, filename, created_at FROM problems WHERE id = 17""")
def problem_by_id(spark, d):
    return C.lookup(problems(spark, d), "id", 17).select("id", "batch_id", "category_group", "filename", "created_at")


@query(f"""WITH {PROBLEMS} SELECT id, status FROM problems WHERE id IN (SELECT l_orderkey FROM lineitem)""")
def problems_by_ids(spark, d):
    return C.lookup_many(problems(spark, d), "id", table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))).select("id", "status")


@query(f"""WITH {PROBLEMS} SELECT d.source AS batch_id, id, status FROM (SELECT DISTINCT source FROM documents UNION SELECT 'none') d LEFT JOIN problems ON d.source = batch_id""")
def batch_listing(spark, d):
    p = problems(spark, d)
    batches = p.select(F.col("batch_id").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("none").alias("id")))
    return C.batch_listing(batches, p, ("id", "status")).select("batch_id", "id", "status")


@query(f"""WITH {_USED} SELECT c_custkey FROM used WHERE (category_group, category_key) IN (SELECT (r_name, n_name) FROM nation JOIN region ON n_regionkey = r_regionkey)
  OR (category_group, category_key) IN (SELECT (category_group, category_key) FROM used WHERE c_custkey % 20 = 0)""")
def known_pairs(spark, d):
    used = _used(spark, d)
    return C.known_pairs(used, _nations(spark, d), used.where("c_custkey % 20 = 0")).select("c_custkey")


@query(f"""WITH {PROBLEMS}, a AS (SELECT * FROM (VALUES ('en', 'k1'), ('fr', 'k2')) t(g, k)),
s AS (SELECT *, CASE id % 3 WHEN 0 THEN [{V.REASON_NO_TRUTH!r}] WHEN 1 THEN ['Formula 1 requires review', '其他'] ELSE [] END AS reasons FROM problems)
SELECT id, category_group || '/' || category_key || '/' || CASE WHEN (category_group, category_key) IN (SELECT (g, k) FROM a) THEN 'true' ELSE 'false' END AS tags, id % 4 = 0 AS markdown_exportable,
  CASE WHEN id % 2 = 0 THEN 'f' || id ELSE '' END AS formulas,
  CASE WHEN review_status = 'accepted' THEN '' ELSE array_to_string(list_concat(CASE id % 3 WHEN 0 THEN [{V.DETAIL_NO_TRUTH[0]!r}] WHEN 1 THEN [{V.DETAIL_FORMULA_REVIEW[0]!r}, '其他'] ELSE [] END, CASE WHEN id % 5 = 0 THEN [{V.TITLE_FAILED!r}] ELSE [] END), ',') END AS diagnostics
FROM s""")
def public_problems(spark, d):
    """Tags with whether they are active, exportability, formulas and diagnostics of every problem."""
    formula = lambda kind, i: B.block(kind, formula_id=i, latex=F.lit("x"))
    of = F.col("id") % 3
    p = problems(spark, d).withColumns(
        {
            "content_blocks": F.array(B.block("text", text=F.lit("t")), formula("latex", F.lit("")), formula("latex", F.when(F.col("id") % 2 == 0, F.concat(F.lit("f"), F.col("id"))))),
            "review_reasons": F.when(of == 0, F.array(F.lit(V.REASON_NO_TRUTH))).when(of == 1, F.array(F.lit("Formula 1 requires review"), F.lit("其他"))).otherwise(F.array().cast("array<string>")),
            "error": F.when(F.col("id") % 5 == 0, "no"), "source_path": F.lit("a"), "selected_artifact": F.lit("b"),
        }
    )
    active = spark.createDataFrame([("en", "k1"), ("fr", "k2")], "group_name string, category_name string")
    out = C.public_view(p, active, F.col("id") % 4 == 0)
    tags = F.concat_ws("/", "tags.category_group", "tags.category_key", F.col("tags.active").cast("string"))
    return out.select("id", tags.alias("tags"), "markdown_exportable", F.array_join(F.transform("formulas", lambda b: b["formula_id"]), ",").alias("formulas"), F.array_join(F.transform("review_diagnostics", lambda r: r["title"]), ",").alias("diagnostics"))


@query("""SELECT o_orderkey, '{"a": [' || o_custkey || ', "é"], "b": {"x": null, "y": "' || o_orderpriority || '"}, "z": true}' AS canonical FROM orders""")
def canonical_json(spark, d):
    raw = F.concat(F.lit('{"z":true,"b":{"y":"'), "o_orderpriority", F.lit('","x":null},"a":['), F.col("o_custkey").cast("string"), F.lit(',"\\u00e9"]}'))
    return table(spark, d, "orders").select("o_orderkey", T.canonical_json(raw).alias("canonical"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(0, CAST(ceil(length(p_name) / 7.0) AS BIGINT)), lambda i: substr(p_name, 7 * i + 1, 7)), '|') AS lines FROM part""")
def wrapped_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.wrapped(F.col("p_name"), T.display_width, 7), "|").alias("lines"))


@query("""WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS seq, l_partkey % 50 AS x0, l_suppkey % 50 AS y0, l_partkey % 50 + 1 + CAST(l_quantity AS BIGINT) AS x1, l_suppkey % 50 + 1 + CAST(l_quantity AS BIGINT) % 13 AS y1 FROM lineitem),
e AS (SELECT page_id, seq, y0 AS a, x0 AS b, y1 AS c, x1 AS d, greatest(0, x0 - 2) AS x0, greatest(0, y0 - 4) AS y0, least(60, x1 + 2) AS x1, least(100, y1 + 4) AS y1 FROM b),
k AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM e WHERE (x1 - x0) * (y1 - y0) >= 64),
f AS (SELECT * FROM k WHERE greatest(0, least(x1, 40) - greatest(x0, 20)) * greatest(0, least(y1, 60) - greatest(y0, 20)) <= 0.25 * area)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY seq, a, b, c, d) AS INTEGER) AS formula_no, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1 FROM f""")
def formula_crops(spark, d):
    """Lineitems as detected formulas, orders as pages of 60 by 100 with a figure in the middle."""
    from folioflow.plans import processing as P

    box = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 50).alias("x0"), (F.col("l_suppkey") % 50).alias("y0"), F.col("l_quantity").cast("long").alias("q"))
    detected = box.select("page_id", "seq", "x0", "y0", (F.col("x0") + 1 + F.col("q")).alias("x1"), (F.col("y0") + 1 + F.col("q") % 13).alias("y1"), F.lit(0.5).alias("score"))
    figure = F.struct(*[F.lit(v).alias(c) for c, v in (("x0", 20), ("y0", 20), ("x1", 40), ("y1", 60))])
    pages = box.select("page_id").distinct().select("page_id", F.lit(60).alias("width"), F.lit(100).alias("height"), figure.alias("figure_box"))
    return P.formula_crops(pages, detected).select("page_id", "formula_no", "x0", "y0", "x1", "y1")
