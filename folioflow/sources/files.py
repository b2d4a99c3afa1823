"""Files as tables: uploads, images, taxonomy and model manifests, and snapshots."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import safe_relative_path, text_of
from folioflow.sources import schema

# What may be uploaded.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "heic")
MOST_BYTES = 30 << 20
MOST_FILES = 200
MOST_TAXONOMY_BYTES = 256 << 10


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files below a folder: path, modificationTime, length, content. Read without content, no file is opened."""
    glob = "*.{" + ",".join(sorted({*SUFFIXES, *(s.upper() for s in SUFFIXES)})) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def reject_reason(path: Column, length: Column) -> Column:
    """Why an upload is refused, or null."""
    return F.when(~suffix(path).isin(*SUFFIXES), "suffix").when(length > MOST_BYTES, "too large")


def ingest(files: DataFrame, batch_id: Column, now: Column, base: str = "") -> DataFrame:
    """New `queued` problems from files (path, length, content); refused files are left out. Ids follow from batch, path and content."""
    digest = F.sha2("content", 256)
    relative = safe_relative_path(F.regexp_replace("path", f"^(?:file:)?/*{base.strip('/')}/*", ""))
    ok = files.where(reject_reason(F.col("path"), F.col("length")).isNull())
    made = ok.select(
        F.left(F.sha2(F.concat_ws("\u001f", batch_id, relative, digest), 256), F.lit(32)).alias("id"), batch_id.alias("batch_id"), F.element_at(F.split(relative, "/"), -1).alias("filename"), F.col("path").alias("source_path"),
        relative.alias("source_relative_path"), digest.alias("source_sha256"), F.concat(F.left(digest, F.lit(12)), F.lit("."), suffix(F.col("path"))).alias("stored_name"), now.alias("created_at"), now.alias("updated_at"),
    )
    return schema.evolve(made)


def taxonomy(spark: SparkSession, path: str, backup: str | None = None) -> tuple[DataFrame, str | None]:
    """The taxonomy document as a flat table, and why it is degraded, or None: the file, else its backup, else the built-in one."""
    from folioflow.operators import taxonomy as tx

    error = None
    for p in (path, backup):
        if p is None:
            continue
        try:
            doc = spark.read.schema(schema.TAXONOMY_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(p)
            flat = tx.flatten(doc)
            if doc.where("version = 1 and revision >= 0").isEmpty() or not tx.violations(flat).isEmpty():
                raise ValueError("not a valid taxonomy")
            return flat, error
        except Exception as e:  # noqa: BLE001 - any unreadable file means the next one
            error = error or f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
    return tx.seed(spark), error


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Models of a manifest, one row each."""
    doc = spark.read.schema(schema.MODEL_MANIFEST).option("multiLine", True).json(path)
    return doc.select("schema_version", F.explode("models").alias("m")).select("schema_version", "m.*")


def verified_models(models: DataFrame, files: DataFrame) -> DataFrame:
    """Models with `verified`: whether a file of their name has their size and hash (files: path, length, content)."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("__name"), "length", F.sha2("content", 256).alias("__sha"))
    j = models.join(have, F.element_at(F.split(text_of(F.col("weight_file")), "/"), -1) == F.col("__name"), "left")
    return j.withColumn("verified", F.coalesce((F.col("length") == F.col("weight_bytes")) & (F.col("__sha") == F.col("weight_sha256")), F.lit(False))).drop("__name", "__sha", "length")


def write_snapshot(df: DataFrame, root: str) -> str:
    """A new version of a table below `root`; readers switch to it by its path, so a failed write changes nothing."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_taxonomy(document: dict, path: str) -> None:
    """Commit a taxonomy document on the driver: the old file becomes the backup, the new one appears whole or not at all."""
    data = json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2).encode()
    if os.path.exists(path):
        shutil.copyfile(path, f"{path}.bak")
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
    at = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def backup_once(df: DataFrame, column: str, root: str) -> str | None:
    """A snapshot of a table that still lacks a column, before it is migrated; None where it has it."""
    return None if column in df.columns else write_snapshot(df, root)
