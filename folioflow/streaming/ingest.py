"""Problems as a stream: arriving files, late and repeated content, running counts, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.catalog import keep_latest


def arriving(spark: SparkSession, path: str, ddl: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Rows of files as they appear in a folder."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def fingerprinted(df: DataFrame, text: str = "ocr_text") -> DataFrame:
    return df.withColumn("content_fingerprint", T.content_fingerprint(F.col(text)))


def first_within(df: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each fingerprint within the watermark; state is dropped behind it, so it stays bounded."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(["content_fingerprint"])


def counts(df: DataFrame, time: str, by: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per window and value; rows later than the watermark are left out."""
    return df.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(df: DataFrame, time: str, by: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Runs of events of one key with no pause of `gap`."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Snapshots:
    """A foreachBatch writer that keeps the latest row per fingerprint, in versions below `root`.

    Rows lie in `buckets` by fingerprint. A batch writes anew only the buckets that
    it touches, below `data/<batch>`, and then a manifest of where each bucket of
    the new version lies, `versions/<batch>`. All state is there: after a restart
    the writer goes on from the newest whole manifest before the batch, and a batch
    that is run again writes the same version again, since the latest row is chosen
    by `by` alone. `seed` is what the first version begins with.
    """

    def __init__(self, root: str, by: list[str], seed: DataFrame | None = None, buckets: int = 64):
        self.root, self.by, self.seed, self.buckets = root.rstrip("/"), by, seed, buckets

    def versions(self, spark: SparkSession) -> list[int]:
        """Batches whose manifest is whole, in order."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _manifest(self, spark: SparkSession, version: int) -> dict[int, str]:
        return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{self.root}/versions/{version}").collect()}  # one row a bucket

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = max((v for v in self.versions(spark) if v < number), default=None)
        where = self._manifest(spark, before) if before is not None else {}
        if before is None and self.seed is not None:
            batch = self.seed.unionByName(batch, allowMissingColumns=True)
        bucket = F.pmod(F.xxhash64("content_fingerprint"), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
        old = [where[b] for b in touched if b in where]
        rows = spark.read.option("mergeSchema", True).parquet(*old).unionByName(batch, allowMissingColumns=True) if old else batch
        data = f"{self.root}/data/{number}"
        latest = keep_latest(rows, F.col("content_fingerprint"), self.by).drop("copies")
        latest.withColumn("__bucket", bucket).write.mode("overwrite").partitionBy("__bucket").parquet(data)
        where |= {b: f"{data}/__bucket={b}" for b in touched}
        spark.createDataFrame(sorted(where.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/{number}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The newest snapshot; None before the first."""
        found = self.versions(spark)
        paths = list(self._manifest(spark, found[-1]).values()) if found else []
        return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def snapshots(root: str, by: list[str], seed: DataFrame | None = None, buckets: int = 64) -> Snapshots:
    """The writer of `Snapshots`."""
    return Snapshots(root, by, seed, buckets)
