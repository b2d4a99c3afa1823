"""Intermediate tables in the cluster's shared folder, and connected components on them."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of tables that `written` made


def shared_folder(spark) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset in a local session, as in tests, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset on {master}: intermediate tables need a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _at(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark) -> str:
    """A path for a table of this session, deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/folioflow-{uuid.uuid4().hex}"
    fs, p = _at(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of their own: lineage is cut, and lost executors don't lose them.

    A written table rather than checkpoint(), which computes its last stage twice.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            fs, p = _at(df.sparkSession, path)
            fs.delete(p, True)


def splittable(column: str):
    """A join key that nothing is dealt by yet.

    Where one side comes from a grouping by the key itself, Spark joins in the
    grouping's partitions and can't split a hot one; a key of its own gives
    both sides a shuffle that adaptive execution may split.
    """
    return F.col(column).bitwiseXOR(F.lit(1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`id` and `root` (the smallest id of its component) of every node of the edges (`u`, `v`).

    By contraction: each node goes along smallest neighbours to where that chain
    ends, edges move to where their ends went, and those within one node go.
    Every round at least halves the nodes that still have edges, and stars are
    done in one; only whether anything moved or is left comes to the driver.
    """
    e = written(edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    roots, last = None, []
    for _ in range(rounds):
        near = e.select(F.col("b").alias("id"), F.col("a").alias("near")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("near")))
        step = near.groupBy("id").agg(F.min("near").alias("via"))
        while True:  # to the end of each chain, doubling the way
            known = step.select(splittable("id").alias("__k"), F.col("via").alias("far"))
            jumped = written(step.withColumn("__k", splittable("via")).join(known, "__k").select("id", F.col("far").alias("via"), (F.col("far") < F.col("via")).alias("moved")))
            discard(*last)
            last, step = [jumped], jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        step = step.withColumnRenamed("via", "to")
        moved = step.select(splittable("id").alias("__k"), "to")
        before = roots
        if roots is None:
            roots = written(step.select("id", F.col("to").alias("root")))
        else:
            roots = written(roots.withColumn("__k", splittable("root")).join(moved, "__k", "left").select("id", F.coalesce("to", "root").alias("root")))
            discard(before)
        first = e.withColumn("__k", splittable("a")).join(moved, "__k").select(F.col("to").alias("x"), splittable("b").alias("__k"))
        both = first.join(moved, "__k").select("x", F.col("to").alias("y")).where("x <> y")
        done, e = e, written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(done)
        if e.isEmpty():
            discard(e, *last)
            return roots
    raise RuntimeError(f"components not settled after {rounds} rounds")
