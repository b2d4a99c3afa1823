"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

Pass one scatters records by seeded hashes into buckets of at most about
`rows_per_bucket` records and `bytes_per_bucket` bytes; the bucket's shard comes
from rendezvous hashing of the key (the highest of one seeded hash per shard
wins), so the key and the number of shards alone decide it and a further shard
takes records only into itself. Pass two permutes each bucket, by sorting it on
a seeded random rank of each place, and numbers it behind the buckets before it.
Sorts spill, and no bucket is ever one value.

Defined results: null text has size 1 and CRC 0; a null key goes where the
hash of null sends it; repeated rows each get a slot of their own; an empty
table gives no rows; columns may have any names and types (maps count as their
text in hashes), since records travel as one struct.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType, VariantType

from folioflow.llm._tables import new_path

SEED = 20240229
BUCKET_BYTES = 8 << 20  # of records in a bucket, as expected


def rendezvous(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """The shard of a key: the shard whose seeded hash of the key is highest."""
    return F.greatest(*[F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(n_shards)])["s"]


def record_bytes(df: DataFrame) -> Column:
    """About how many bytes a record takes: those of its strings, arrays, maps and structs as text, and 8 for each other value."""
    sizes = [F.lit(0).cast("long")]
    for f in df.schema:
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))
        column = F.col(f"`{f.name}`").cast("string") if nested else F.col(f"`{f.name}`")
        sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) if nested or isinstance(f.dataType, (StringType, BinaryType)) else F.lit(8))
    return reduce(Column.__add__, sizes)


def buckets_per_shard(n_rows: int, n_shards: int, rows_per_bucket: int, n_bytes: int = 0, bytes_per_bucket: int = BUCKET_BYTES) -> int:
    return max(1, -(-n_rows // (n_shards * rows_per_bucket)), -(-n_bytes // (n_shards * bytes_per_bucket)))


def record_digest(df: DataFrame, names: list[str], seed: int) -> Column:
    """A seeded hash of a record's columns; maps and variants, which have no hash of their own, count as their text."""
    plain = [F.col(f"`{n}`") if _hashable(df.schema[n].dataType) else F.to_json(F.struct(F.col(f"`{n}`").alias("v"))) for n in names]
    return F.xxhash64(F.lit(seed), *plain)


def _hashable(kind) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (MapType, VariantType))


def two_pass_shuffle(df: DataFrame, key: str, carry: list[str], n_shards: int = 16, rows_per_bucket: int = 2048, seed: int = SEED, bytes_per_bucket: int = BUCKET_BYTES) -> DataFrame:
    """Every record as the struct `record` (`key` and `carry`, whatever their names), with `shard` int, `bucket` int and `slot` long.

    Slots run from 0 without gaps in each shard. A bucket's expected size is at
    most `rows_per_bucket` records and `bytes_per_bucket` bytes, whatever the
    size of the input; a longer record is the one of its bucket as a rule. Only
    records that are equal in the key and all carried columns share a bucket by
    force. The permutation follows from the seed, the number of buckets and the
    records alone, however they are dealt to tasks.
    """
    names = [key, *(c for c in carry if c != key)]
    whole = df.select(*[F.col(f"`{n}`") for n in names])
    n_rows, n_bytes = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_bytes(whole)), F.lit(0))).first()
    n = buckets_per_shard(n_rows, n_shards, rows_per_bucket, n_bytes, bytes_per_bucket)
    scattered = whole.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("record"), rendezvous(F.col(f"`{key}`"), n_shards, seed).alias("shard"),
        record_digest(whole, names, seed + 1).alias("digest"), record_digest(whole, names, seed + 2).alias("second"),
    )
    scattered = scattered.withColumn("bucket", F.pmod("digest", F.lit(n)).cast("int"))
    filled = scattered.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # in an order of their own first, so that the order of arrival decides nothing; records equal in both hashes are equal, and get ranks of their own
    within = Window.partitionBy("shard", "bucket")
    placed = scattered.withColumn("place", F.row_number().over(within.orderBy("digest", "second")))
    ranked = placed.drop("digest", "second").withColumn("rank", F.xxhash64("shard", "bucket", "place", F.lit(seed)))
    mixed = ranked.withColumn("at", F.row_number().over(within.orderBy("rank", "place")) - 1)
    laid = mixed.join(starts, ["shard", "bucket"])
    return laid.select("record", "shard", "bucket", (F.col("start") + F.col("at")).alias("slot"))


def write_shards(df: DataFrame, key: str, path: str, n_shards: int = 16, rows_per_bucket: int = 2048, seed: int = SEED) -> None:
    """Write whole records under `path` as the struct `record` with `bucket` and `slot`, one folder per shard and slots in order in each file."""
    out = two_pass_shuffle(df, key, [c for c in df.columns if c != key], n_shards, rows_per_bucket, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark, path: str, record: StructType) -> DataFrame:
    """What `write_shards` wrote: `record` of the given schema, `bucket`, `slot` and `shard`."""
    return spark.read.schema(StructType([StructField("record", record), StructField("bucket", IntegerType()), StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)


def op4_sharding_two_pass(spark, sf_dir: str) -> DataFrame:
    """Whole records go through both passes into shards in the shared folder; every figure is of what is read back from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark)
    write_shards(docs, "doc_id", path)
    shards = read_shards(spark, path, StructType(sorted(docs.schema, key=lambda f: f.name != "doc_id")))
    text, doc_id = F.coalesce(F.col("record.text"), F.lit("")), F.col("record.doc_id")
    return shards.select(
        doc_id.alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", rendezvous(doc_id, 17).alias("grown_shard"),
    )
