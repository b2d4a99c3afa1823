"""Tables of the catalogue: their columns, evolution and constraints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

BATCHES = "id string, status string, created_at string, updated_at string, pdf_path string"
PROBLEMS = """id string, batch_id string, filename string, source_path string, status string, review_status string, selected_artifact string,
category string, category_group string, category_key string, summary string, category_confidence double, confidence double, category_source string,
ocr_text string, metrics string, source_relative_path string, source_sha256 string, asset_state string, content_fingerprint string, accepted_at string,
selected_kind string, parent_source_id string, page_index int, page_total int, split_label string, split_ocr_text string, content_blocks_version int,
content_blocks string, content_source_sha256 string, error string, created_at string, updated_at string"""
CATEGORIES = "id string, name string, description string, aliases string, created_at string"
EXPORTS = "id string, batch_id string, kind string, file_path string, filename string, created_at string"
TAXONOMY_DOCUMENT = "version int, revision int, groups array<struct<id:string,name:string,source:string,active:boolean,categories:array<struct<id:string,name:string,source:string,active:boolean>>>>"
MODEL_MANIFEST = "schema_version int, models array<struct<id:string,purpose:string,repository:string,commit:string,revision:string,license:string,weight_file:string,weight_sha256:string,weight_bytes:long,runtime:string>>"
OCR_LINE = "struct<text:string,confidence:double,box:struct<x:double,y:double,w:double,h:double>,alternatives:array<struct<text:string,confidence:double>>>"

#: What a missing column of an earlier version is filled with.
DEFAULTS: Mapping[str, object] = {
    "status": "queued", "review_status": "not_required", "category": "未分类", "category_group": "未分类", "category_key": "未分类", "summary": "", "category_confidence": 0.0, "confidence": 0.0, "category_source": "automatic",
    "metrics": "{}", "source_relative_path": "", "source_sha256": "", "asset_state": "workbench", "selected_kind": "",
}


def struct(ddl: str) -> StructType:
    out = _parse_datatype_string(ddl)
    assert isinstance(out, StructType)
    return out


def evolve(df: DataFrame, ddl: str = PROBLEMS, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """The rows with all columns of the schema, in its types: missing ones get their default, further ones stay behind them."""
    fields = struct(ddl).fields
    known = {f.name for f in fields}
    made = [(F.coalesce(F.col(f.name).cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType)) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in fields]
    return df.select(*made, *[c for c in df.columns if c not in known])


def backfill_legacy(df: DataFrame) -> DataFrame:
    """Rows of the one-level scheme (`category` alone) with group, key and the summary kept in their metrics."""
    from folioflow.functions.text import legacy_category, text_of

    pair = legacy_category(F.col("category"))
    plain = text_of(F.trim(F.col("category"))) == ""
    old = F.col("category_source") == "automatic"
    return df.withColumns(
        {
            "category": F.when(plain, "未分类").otherwise(F.col("category")),
            "category_group": F.when(old, pair["group"]).otherwise(F.col("category_group")),
            "category_key": F.when(old, pair["key"]).otherwise(F.col("category_key")),
            "summary": F.when(old, text_of(F.get_json_object("metrics", "$.recognition_summary"))).otherwise(F.col("summary")),
            "category_source": F.when(old, "migrated").otherwise(F.col("category_source")),
        }
    )


def decode_json(c: Column, ddl: str, strict: bool = False) -> Column:
    """A JSON column in its schema. Bad JSON is an error if strict, else an empty value with null fields."""
    return F.from_json(c, ddl, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def constraint_violations(problems: DataFrame, batches: DataFrame) -> DataFrame:
    """`rule` and `item` of every broken constraint: primary key, batch reference, one published row per fingerprint."""
    from folioflow.operators.catalog import fingerprint_violations

    out = lambda df, rule, item: df.select(F.lit(rule).alias("rule"), F.col(item).cast("string").alias("item"))
    return (
        out(problems.groupBy("id").count().where("count > 1 or id is null"), "primary key", "id")
        .unionByName(out(orphans(problems, "batch_id", batches), "batch reference", "id"))
        .unionByName(out(fingerprint_violations(problems), "published fingerprint", "content_fingerprint"))
    )
