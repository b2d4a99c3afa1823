"""A bounded sample of labelled documents: classifiers are fitted from features that executors compute of it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import slices


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n: what splits training rows from held-out ones."""
    return F.crc32(key.cast("string").cast("binary")) % n


def labelled_rows(docs: DataFrame, labels: DataFrame, label: Column, fold: tuple[int, int] | None, limit: int, beside: tuple[str, ...] = ()) -> DataFrame:
    """`id`, `y`, the whole `text` and the columns `beside` of at most `limit` labelled documents.

    The ids with the lowest seeded hashes are taken, after leaving out the held-out
    `fold` (n, r): rows whose crc32 remainder modulo n is r. Null labels and ids are
    left out; of several labels of a document the lowest counts, of several
    documents with one id the lowest text.
    """
    rows = labels.select(F.col("doc_id").alias("__id"), label.cast("double").alias("__y")).where("__id is not null and __y is not null")
    if fold:
        rows = rows.where(remainder(F.col("__id"), fold[0]) != fold[1])
    rows = rows.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id", F.lit(11)), "__id").limit(limit)
    texts = docs.select(F.col("doc_id").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"), *[F.col(c).alias(f"__{c}") for c in beside])
    # at most `limit` ids and labels are broadcast
    found = texts.join(F.broadcast(rows), "__id").groupBy("__id").agg(F.min("__text").alias("text"), F.first("__y").alias("y"), *[F.min_by(f"__{c}", "__text").alias(c) for c in beside])
    return found.select(F.col("__id").cast("long").alias("id"), "y", "text", *beside)


def collected_features(sample: DataFrame, make: Callable[[], Callable[[int, str], np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, labels, and one vector a row of the sample; texts stay on the executors.

    `make` is called once per task and returns a function of an id and its text.
    """

    def work(batches):
        of = make()
        for b in slices(batches):
            ids, ys, texts = (c.to_pylist() for c in b.columns)
            made = [np.asarray(of(i, t), np.float32).tobytes() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["id", "y", "x"])

    got = sorted(sample.select("id", "y", "text").mapInArrow(work, "id long, y double, x binary").collect(), key=lambda r: r["id"])
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), -1) if got else np.zeros((0, 0), np.float32)
    return np.array([r["id"] for r in got], np.int64), np.array([r["y"] for r in got], float), x
