"""The catalogue of problems: reads, deduplication, status, and writes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

UPDATABLE = (
    "status", "review_status", "selected_artifact", "category", "category_group", "category_key", "summary", "category_confidence", "confidence", "category_source", "ocr_text", "metrics", "source_relative_path",
    "source_sha256", "asset_state", "content_fingerprint", "accepted_at", "selected_kind", "parent_source_id", "page_index", "page_total", "split_label", "split_ocr_text", "content_blocks", "content_source_sha256", "error",
)


def search(df: DataFrame, group: str | None = None, key: str | None = None, q: str | None = None, fields: tuple[str, ...] = ("filename", "ocr_text")) -> DataFrame:
    """Rows that meet every given condition; `q` is looked for in the fields, folding ASCII case alone."""
    out = df
    if group:
        out = out.where(F.col("category_group") == group)
    if key:
        out = out.where(F.col("category_key") == key)
    if q and q.strip():
        hit = F.lit(False)
        for f in fields:
            hit = hit | T.contains_ascii_folded(F.col(f), q.strip())
        out = out.where(hit)
    return out


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, or none; the filter reaches the scan, so other files and row groups are not read."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def lookup_many(df: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows whose key is asked for: a semi join, for more keys than a filter holds."""
    return df.join(asked.select(key).distinct(), key, "left_semi")


def assets(df: DataFrame) -> DataFrame:
    """What is published and accepted."""
    return df.where((F.col("asset_state") == "published") & (F.col("review_status") == "accepted"))


def page(df: DataFrame, by: str, key: str, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order; anything but "newest" ascends. Only offset + limit rows per task are kept on the way."""
    check_page(sort if sort in ("newest", "oldest") else "oldest", limit, offset)
    order = [F.col(by).desc_nulls_last(), F.col(key).desc_nulls_last()] if sort == "newest" else [F.col(by).asc_nulls_first(), F.col(key).asc_nulls_first()]
    return df.orderBy(*order).offset(offset).limit(limit)


def check_page(sort: str, limit: int, offset: int, q: str | None = None) -> str | None:
    """The arguments' domain; returns the trimmed search text, or None for a blank one."""
    if sort not in ("newest", "oldest") or not 1 <= limit <= 100 or offset < 0 or len(q or "") > 100:
        raise ValueError("sort, limit, offset or q out of range")
    return (q or "").strip() or None


def known_pair(group: str | None, key: str | None, taxonomy: DataFrame, used: DataFrame) -> bool:
    """Whether a filter names a group, or a pair, that the taxonomy or the data has."""
    if key and not group:
        return False
    if not group:
        return True
    pairs = taxonomy.select(F.col("group_name").alias("g"), F.col("category_name").alias("k")).unionByName(used.select(F.col("category_group").alias("g"), F.col("category_key").alias("k")))
    return not pairs.where((F.col("g") == group) & ((F.col("k") == key) if key else F.lit(True))).isEmpty()


def known_pairs(asked: DataFrame, taxonomy: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The asked (`category_group`, `category_key`) pairs that the taxonomy or the data has: one semi join for all of them."""
    pairs = taxonomy.select(F.col("group_name").alias("category_group"), F.col("category_name").alias("category_key"))
    if used is not None:
        pairs = pairs.unionByName(used.select("category_group", "category_key"))
    return asked.join(pairs.distinct(), ["category_group", "category_key"], "left_semi")


def keep_latest(df: DataFrame, fingerprint: Column, by: list[str]) -> DataFrame:
    """The last row by the columns `by` of each fingerprint, with the `copies` it stands for.

    Aggregates before the shuffle, so a fingerprint that many rows share costs a row per task.
    """
    latest = F.max_by(F.struct(*df.columns), F.struct(*by))
    return df.groupBy(fingerprint.alias("__fp")).agg(latest.alias("row"), F.count("*").alias("copies")).select("row.*", "copies")


def fingerprint_violations(df: DataFrame) -> DataFrame:
    """Fingerprints that more than one published row has."""
    return df.where((F.col("asset_state") == "published") & F.col("content_fingerprint").isNotNull()).groupBy("content_fingerprint").agg(F.count("*").alias("n")).where("n > 1")


def batch_status(batches: DataFrame, problems: DataFrame) -> DataFrame:
    """`batch_id` and `rolled_status`: empty, processing, needs_review, partial or ready, the first that holds."""
    some = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")).alias
    seen = problems.groupBy("batch_id").agg(
        some(F.col("status").isin("queued", "processing"))("busy"),
        some(F.col("review_status") == "pending")("pending"),
        some(F.col("status") == "failed")("failed"),
    )
    status = F.when(F.col("busy").isNull(), "empty").when(F.col("busy") == 1, "processing").when(F.col("pending") == 1, "needs_review").when(F.col("failed") == 1, "partial").otherwise("ready")
    return batches.select(F.col("id").alias("batch_id")).join(seen, "batch_id", "left").select("batch_id", status.alias("rolled_status"))


def batch_with_problems(batches: DataFrame, problems: DataFrame, columns: tuple[str, ...] = ("id", "filename", "status")) -> DataFrame:
    """Batches with their problems nested in order of creation: the view of an upload, which `files.MOST_FILES` bounds.

    For batches of any size `batch_listing` has the same rows flat.
    """
    rows = F.array_sort(F.collect_list(F.struct("created_at", *columns)))
    return batches.join(problems.groupBy(F.col("batch_id").alias("id")).agg(rows.alias("problems")), "id", "left")


def batch_listing(batches: DataFrame, problems: DataFrame, columns: tuple[str, ...] = ("id", "filename", "status")) -> DataFrame:
    """One row per problem of each batch (one with nulls for an empty batch); readers order by batch_id, created_at and id. No batch is ever one value."""
    of = problems.select("batch_id", "created_at", *columns)
    return batches.select(F.col("id").alias("batch_id")).join(of, "batch_id", "left")


def publish(published: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """The new snapshot of published rows: an accepted row replaces whatever has its fingerprint.

    Adds `replaced_ids`. Both frames have `id` and `content_fingerprint`.
    """
    new = keep_latest(accepted, F.col("content_fingerprint"), by).drop("copies")
    old = published.select("content_fingerprint", F.col("id").alias("__old"))
    gone = old.join(new.select("content_fingerprint", F.col("id").alias("__new")), "content_fingerprint").where("__old <> __new")
    replaced = gone.groupBy("content_fingerprint").agg(F.sort_array(F.collect_set("__old")).alias("replaced_ids"))
    kept = published.join(new.select("content_fingerprint"), "content_fingerprint", "left_anti").withColumn("replaced_ids", F.array().cast("array<string>"))
    fresh = new.withColumns({"asset_state": F.lit("published"), "review_status": F.lit("accepted"), "status": F.lit("ready")}).join(replaced, "content_fingerprint", "left")
    fresh = fresh.withColumn("replaced_ids", F.coalesce("replaced_ids", F.array().cast("array<string>")))
    return kept.unionByName(fresh, allowMissingColumns=True)


def migrate_assets(df: DataFrame) -> DataFrame:
    """Accepted rows become published assets, the latest of each fingerprint; published rows that aren't accepted go back to the workbench."""
    accepted = df.where(F.col("review_status") == "accepted").withColumn("content_fingerprint", T.content_fingerprint(F.col("ocr_text"), F.col("figure")))
    name = F.element_at(F.split(T.text_of(F.col("selected_artifact")), "/"), -1)
    kind = F.when(name == "question.png", "reconstructed").when(name == "normalized.png", "normalized").when(name == "cleaned.png", "cleaned").otherwise(F.when(T.text_of(F.col("selected_kind")) == "", "reconstructed").otherwise(F.col("selected_kind")))
    assets_ = keep_latest(accepted, F.col("content_fingerprint"), ["updated_at", "id"]).drop("copies").withColumns({"asset_state": F.lit("published"), "accepted_at": F.coalesce("accepted_at", "updated_at"), "selected_kind": kind})
    rest = df.where(~F.coalesce(F.col("review_status") == "accepted", F.lit(False)))
    demoted = F.coalesce(F.col("asset_state") == "published", F.lit(False))
    rest = rest.withColumns({"content_fingerprint": F.when(~demoted, F.col("content_fingerprint")), "accepted_at": F.when(~demoted, F.col("accepted_at")), "asset_state": F.when(demoted, "workbench").otherwise(F.col("asset_state"))})
    return assets_.unionByName(rest, allowMissingColumns=True)


def apply_cas(current: DataFrame, changes: DataFrame, key: str, version: str, values: list[str]) -> DataFrame:
    """Compare-and-swap: `changes` has key, `expected`, `new_version` and new values (null: unchanged).

    Of several changes to one row that expect its version one applies, that with
    the lowest new version; the rest conflict. Adds `outcome`: applied, conflict,
    missing or unchanged. All of a row's changes meet in one aggregate, so no
    hot key holds up a task.
    """
    new = [F.col(f"__c.{v}").alias(f"__{v}") for v in values]
    asked = changes.select(key, "expected", F.struct("new_version", *values).alias("c")).groupBy(key, "expected").agg(F.min("c").alias("__c"), F.count("*").alias("__n"))
    per = asked.select(key, "expected", F.col("__c.new_version").alias("__version"), *new, "__n")
    fits = per.join(current.select(key, F.col(version).alias("__now")), key, "left").withColumn("__ok", F.col("expected").eqNullSafe(F.col("__now")) & F.col("__now").isNotNull())
    told = fits.groupBy(key).agg(F.max_by(F.struct("__ok", "__version", *[f"__{v}" for v in values]), F.col("__ok")).alias("__t"), F.sum("__n").alias("__asked"))
    ok = F.coalesce(F.col("__t.__ok"), F.lit(False))
    out = current.join(told, key, "full_outer")
    columns = [F.when(ok & F.col(f"__t.__{c}").isNotNull(), F.col(f"__t.__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.when(ok, F.col("__t.__version")).otherwise(F.col(c)).alias(c) if c == version else F.col(c) for c in current.columns]
    outcome = F.when(F.col("__t").isNull(), "unchanged").when(F.col(version).isNull(), "missing").when(ok, "applied").otherwise("conflict")
    return out.select(*columns, outcome.alias("outcome"), F.coalesce(F.col("__asked") - ok.cast("long"), F.lit(0).cast("long")).alias("refused"))


def apply_updates(current: DataFrame, changes: DataFrame, key: str, now: Column, allowed: tuple[str, ...] = UPDATABLE) -> DataFrame:
    """New values (null: unchanged) for the allowed columns; others in `changes` are left out. One change per key."""
    values = [c for c in changes.columns if c != key and c in allowed and c in current.columns]
    c = changes.select(key, *[F.col(v).alias(f"__{v}") for v in values], F.lit(True).alias("__hit"))
    joined = current.join(c, key, "left")
    columns = [F.coalesce(f"__{x}", x).alias(x) if x in values else F.when(F.col("__hit"), now).otherwise(F.col(x)).alias(x) if x == "updated_at" else F.col(x) for x in current.columns]
    return joined.select(*columns)


def delete(problems: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot without the given ids, and the manifest of files that can go."""
    gone = problems.join(ids.select("id").distinct(), "id", "left_semi")
    files = gone.select("id", F.explode(F.array_compact(F.array("source_path", "selected_artifact"))).alias("path"))
    return problems.join(ids.select("id"), "id", "left_anti"), files


def split_children(parents: DataFrame, regions: DataFrame, order: list[str]) -> DataFrame:
    """Problems with each split parent replaced by its regions, numbered `page_index` of `page_total`.

    `regions` has `parent_id`, split_label and split_ocr_text. A page has few regions.
    """
    of = Window.partitionBy("parent_id")
    numbered = regions.withColumns({"page_index": F.row_number().over(of.orderBy(*order)), "page_total": F.count("*").over(of).cast("int")})
    children = numbered.join(parents.withColumnRenamed("id", "parent_id"), "parent_id").withColumn("id", F.concat("parent_id", F.lit("-"), F.format_string("%02d", "page_index")))
    children = children.withColumn("parent_source_id", F.col("parent_id"))
    keep = [c for c in children.columns if c in parents.columns or c in ("parent_source_id", "page_index", "page_total", "split_label", "split_ocr_text")]
    rest = parents.join(regions.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")
    return rest.unionByName(children.select(*keep), allowMissingColumns=True)


def ensure_categories(names: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Known categories and the missing names (at most 24 characters) as new rows with ids from their names."""
    wanted = names.select(F.left(F.trim(F.col("name")), F.lit(24)).alias("name")).where("name <> ''").distinct()
    fresh = wanted.join(known, "name", "left_anti").select(F.left(F.sha2("name", 256), F.lit(32)).alias("id"), "name", F.lit("").alias("description"), now.alias("created_at"))
    return known.unionByName(fresh, allowMissingColumns=True)


def public_view(df: DataFrame, active: DataFrame | None = None, eligible: Column | None = None) -> DataFrame:
    """What may be shown of problems: no file paths; tags, exportability, formulas and diagnostics.

    `tags` say whether the pair is among the `active` ones (group_name,
    category_name). Where `df` has `content_blocks`, `formulas` are its LaTeX blocks
    with an id; where it has `review_reasons`, `review_diagnostics` are those of
    what is neither accepted nor excluded.
    """
    from folioflow.operators import review

    given = lambda c: F.when(T.text_of(c) != "", c)
    group = F.coalesce(given(F.col("category_group")), F.lit(T.UNCATEGORIZED))
    old = [given(F.col("category"))] if "category" in df.columns else []
    out = df.withColumns({"__g": group, "__k": F.coalesce(given(F.col("category_key")), *old, F.lit(T.UNCATEGORIZED))})
    tags = [F.col("__g").alias("category_group"), F.col("__k").alias("category_key")]
    if active is not None:
        pairs = active.select(F.col("group_name").alias("__g"), F.col("category_name").alias("__k")).distinct().withColumn("__active", F.lit(True))
        out = out.join(pairs, ["__g", "__k"], "left")
        tags.append(F.coalesce("__active", F.lit(False)).alias("active"))
    out = out.withColumn("tags", F.struct(*tags))
    if eligible is not None:
        out = out.withColumn("markdown_exportable", F.coalesce(eligible, F.lit(False)))
    if "content_blocks" in df.columns:
        shown = F.filter("content_blocks", lambda b: (b["type"] == "latex") & (T.text_of(b["formula_id"]) != ""))
        out = out.withColumn("formulas", F.coalesce(shown, F.array().cast(dict(df.dtypes)["content_blocks"])))
    if "review_reasons" in df.columns:
        numbers = [F.col(c) if c in df.columns else F.array().cast("array<string>") for c in ("primary_numbers", "secondary_numbers")]
        out = out.withColumn("review_diagnostics", review.diagnostics(F.col("review_reasons"), *numbers, F.col("error") if "error" in df.columns else None, F.col("review_status")))
    return out.drop("source_path", "selected_artifact", "__g", "__k", "__active")
