"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of `documents`; the last returns token counts and
hashes. `labels` is read from `sf_dir`. SQL can't express the stages; tests
hold them against brute-force versions on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm import bpe, jaccard_join, mixing, pii, toxicity
from folioflow.llm._tables import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees hold for toxic (0.5 or more) go; the score travels with the text, so there is no join."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    scored = toxicity.with_score(docs.select(*COLUMNS), "text", model)
    return scored.where(F.col("toxicity_score") < 0.5).select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that with the smallest id. Of its rows in the class one stays, and an id with texts of several classes may stay in each; rows without an id all stay."""
    classes = jaccard_join.joined_rows(docs)
    stay = classes.where(F.col("doc_id") == F.col("class_id")).groupBy("doc_id", "class_set").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key").distinct()
    kept = docs.select(*COLUMNS, jaccard_join.text_key("text").alias("text_key")).join(stay, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; all documents stay."""
    out = pii.redact_column(docs.select(*COLUMNS), "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded at random, says: none, one or several rows."""
    mixed = written(mixing.mix(docs, _labels(spark, sf_dir)).select(F.col("doc_id").alias("id"), "copies"))
    times = mixed.groupBy("id").agg(F.max("copies").alias("copies"))
    rows = docs.select(*COLUMNS).join(times, docs["doc_id"].eqNullSafe(F.col("id"))).where("copies > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every row. Few words are remembered: workers come here from other stages with less memory left."""
    return bpe.digest(docs, kept=40_000)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
