"""The two-level taxonomy as a flat table, its usage, views, checks and updates.

One row per category (and one with a null category for a group without any):
group_id, group_name, group_source, group_active, group_pos, category_id,
category_name, category_source, category_active, category_pos.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators.classify import TAXONOMY

SCHEMA = "group_id string, group_name string, group_source string, group_active boolean, group_pos int, category_id string, category_name string, category_source string, category_active boolean, category_pos int"
MAX_GROUPS = 50
MAX_CATEGORIES = 100
SOURCES = ("builtin", "custom", "historical")


def builtin_id(kind: str, *names: str) -> str:
    """A stable id for a built-in item, from its names joined by the unit separator."""
    return f"builtin-{kind}-{hashlib.sha256(chr(31).join(names).encode()).hexdigest()[:16]}"


def seed(spark, taxonomy: Mapping[str, tuple[str, ...]] = TAXONOMY) -> DataFrame:
    """The built-in taxonomy without the reserved group."""
    rows = [
        (builtin_id("group", g), g, "builtin", True, i, builtin_id("category", g, c), c, "builtin", True, j)
        for i, (g, cs) in enumerate((g, cs) for g, cs in taxonomy.items() if g != T.UNCATEGORIZED)
        for j, c in enumerate(cs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def flatten(document: DataFrame) -> DataFrame:
    """The flat table of nested taxonomy documents (`groups` array of structs with `categories`)."""
    g = document.select(F.posexplode("groups").alias("group_pos", "g"))
    c = g.select("group_pos", "g", F.posexplode_outer("g.categories").alias("category_pos", "c"))
    return c.select(
        F.col("g.id").alias("group_id"), F.col("g.name").alias("group_name"), F.col("g.source").alias("group_source"), F.col("g.active").alias("group_active"), F.col("group_pos").cast("int"),
        F.col("c.id").alias("category_id"), F.col("c.name").alias("category_name"), F.col("c.source").alias("category_source"), F.col("c.active").alias("category_active"), F.col("category_pos").cast("int"),
    )


def nest(flat: DataFrame) -> DataFrame:
    """Groups with their categories in file order, as one row each; groups are few (at most `MAX_GROUPS`)."""
    item = F.struct("category_pos", F.struct(F.col("category_id").alias("id"), F.col("category_name").alias("name"), F.col("category_source").alias("source"), F.col("category_active").alias("active")).alias("c"))
    grouped = flat.groupBy("group_pos", "group_id", "group_name", "group_source", "group_active").agg(F.array_sort(F.collect_list(F.when(F.col("category_id").isNotNull(), item))).alias("items"))
    return grouped.select("group_pos", F.col("group_id").alias("id"), F.col("group_name").alias("name"), F.col("group_source").alias("source"), F.col("group_active").alias("active"), F.transform("items", lambda x: x["c"]).alias("categories"))


def usage(problems: DataFrame, group: str = "category_group", key: str = "category_key") -> DataFrame:
    """How many problems bear each pair."""
    return problems.groupBy(F.col(group).alias("category_group"), F.col(key).alias("category_key")).agg(F.count("*").alias("usage_count"))


def pairs(problems: DataFrame, group: str = "category_group", key: str = "category_key") -> DataFrame:
    """Distinct pairs with both parts."""
    return problems.select(F.col(group).alias("category_group"), F.col(key).alias("category_key")).where((F.col("category_group") != "") & (F.col("category_key") != "")).distinct()


def usage_rollup(flat: DataFrame, used: DataFrame) -> DataFrame:
    """`flat` with its categories' counts and each group's total over its own categories; pairs outside the taxonomy don't count."""
    counted = flat.join(used, (flat["group_name"] == used["category_group"]) & (flat["category_name"] == used["category_key"]), "left")
    own = F.coalesce("usage_count", F.lit(0)).cast("long")
    of_group = Window.partitionBy("group_id")  # at most MAX_CATEGORIES rows
    return counted.select(*flat.columns, own.alias("category_usage"), F.sum(own).over(of_group).alias("group_usage"))


def unknown_pairs(used: DataFrame, flat: DataFrame) -> DataFrame:
    """Pairs in use that the taxonomy lacks."""
    known = flat.select(F.col("group_name").alias("category_group"), F.col("category_name").alias("category_key"))
    return used.join(known, ["category_group", "category_key"], "left_anti")


def with_historical(flat: DataFrame, used: DataFrame) -> DataFrame:
    """`flat` with the unknown pairs in use added as inactive history, behind what is there; names keep their exact form."""
    missing = unknown_pairs(pairs(used), flat)
    groups = flat.select("group_id", "group_name", "group_source", "group_active", "group_pos").distinct()
    ends = flat.groupBy(F.col("group_name").alias("category_group")).agg(F.max("category_pos").alias("last"))
    last_group = flat.agg(F.coalesce(F.max("group_pos"), F.lit(-1)).alias("last_group"))
    rank = F.row_number().over(Window.partitionBy("category_group").orderBy("category_key"))
    new_pos = F.dense_rank().over(Window.orderBy("category_group"))  # over distinct unknown groups only
    fresh = missing.join(groups, F.col("category_group") == F.col("group_name"), "left_anti").select("category_group").distinct().withColumn("new_pos", new_pos)
    old_id = lambda kind, *c: F.concat(F.lit(f"historical-{kind}-"), F.left(F.sha2(F.concat_ws("\u001f", *c), 256), F.lit(16)))
    added = (
        missing.join(groups, F.col("category_group") == F.col("group_name"), "left")
        .join(ends, "category_group", "left")
        .join(fresh, "category_group", "left")
        .crossJoin(F.broadcast(last_group))  # one row
        .select(
            F.coalesce("group_id", old_id("group", F.col("category_group"))).alias("group_id"), F.col("category_group").alias("group_name"), F.coalesce("group_source", F.lit("historical")).alias("group_source"),
            F.coalesce("group_active", F.lit(False)).alias("group_active"), F.coalesce("group_pos", (F.col("last_group") + F.col("new_pos")).cast("int")).alias("group_pos"),
            old_id("category", F.col("category_group"), F.col("category_key")).alias("category_id"), F.col("category_key").alias("category_name"), F.lit("historical").alias("category_source"), F.lit(False).alias("category_active"),
            (F.coalesce("last", F.lit(-1)) + rank).cast("int").alias("category_pos"),
        )
    )
    return flat.unionByName(added)


def active(flat: DataFrame, builtin_only: bool = False) -> DataFrame:
    """Active categories of active groups; `builtin_only` is what may be assigned automatically."""
    out = flat.where(F.col("group_active") & F.col("category_active"))
    return out.where((F.col("group_source") == "builtin") & (F.col("category_source") == "builtin")) if builtin_only else out


def active_pairs(problems: DataFrame, flat: DataFrame) -> DataFrame:
    """The problems whose pair is active."""
    known = active(flat).select(F.col("group_name").alias("category_group"), F.col("category_name").alias("category_key"))
    return problems.join(known, ["category_group", "category_key"], "left_semi")


def deactivated_override(problems: DataFrame, flat: DataFrame, reason: str) -> DataFrame:
    """Problems whose pair is no longer active become uncategorised, with a reason added to `review_reasons`."""
    known = active(flat).select(F.col("group_name").alias("category_group"), F.col("category_name").alias("category_key"), F.lit(True).alias("__ok")).distinct()
    gone = F.col("__ok").isNull() & (F.col("category_group") != T.UNCATEGORIZED)
    return (
        problems.join(known, ["category_group", "category_key"], "left")
        .withColumn("review_reasons", F.when(gone, F.array_distinct(F.concat("review_reasons", F.array(F.lit(reason))))).otherwise(F.col("review_reasons")))
        .withColumns({"category_group": F.when(gone, T.UNCATEGORIZED).otherwise(F.col("category_group")), "category_key": F.when(gone, T.UNCATEGORIZED).otherwise(F.col("category_key"))})
        .drop("__ok")
    )


def items(flat: DataFrame) -> DataFrame:
    """Groups and categories as one list: id, name, source, parent."""
    g = flat.select(F.col("group_id").alias("id"), F.col("group_name").alias("name"), F.col("group_source").alias("source"), F.lit(None).cast("string").alias("parent")).distinct()
    c = flat.where("category_id is not null").select(F.col("category_id").alias("id"), F.col("category_name").alias("name"), F.col("category_source").alias("source"), F.col("group_id").alias("parent"))
    return g.unionByName(c)


def diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """`key` and `change` (same, changed, added, removed) of two versions with equal columns; nulls equal nulls."""
    values = [c for c in old.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def violations(flat: DataFrame) -> DataFrame:
    """`rule` and `item` for every break of the taxonomy's constraints; no rows: valid."""
    out = lambda df, rule, item: df.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))
    every, groups = items(flat), flat.select("group_id", "group_name", "group_source", "group_active").distinct()
    limits = {True: 12, False: 24}
    bad = every.where(F.col("source") != "historical").withColumn("top", F.col("parent").isNull())
    named = F.when(F.col("top"), T.normalized_name(F.col("name"), limits[True])).otherwise(T.normalized_name(F.col("name"), limits[False]))
    parts = [
        out(groups.agg(F.count("*").alias("n")).where(F.col("n") > MAX_GROUPS), "too many groups", F.col("n")),
        out(flat.where("category_id is not null").groupBy("group_id").count().where(F.col("count") > MAX_CATEGORIES), "too many categories", F.col("group_id")),
        out(every.groupBy("id").count().where("count > 1 or id is null or id = ''"), "id missing or repeated", F.col("id")),
        out(every.where(~F.col("source").isin(*SOURCES) | F.col("source").isNull()), "unknown source", F.col("id")),
        out(groups.groupBy("group_name").count().where("count > 1"), "group name repeated", F.col("group_name")),
        out(flat.where("category_id is not null").groupBy("group_id", "category_name").count().where("count > 1"), "category name repeated", F.col("category_name")),
        out(bad.where(named.isNull() | (named != F.col("name"))), "name not normal", F.col("name")),
        out(flat.where(F.col("category_active") & ~F.col("group_active")), "active category in inactive group", F.col("category_id")),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


class TaxonomyConflict(ValueError):
    """The taxonomy has changed since it was read."""


class TaxonomyError(ValueError):
    """The new taxonomy breaks a constraint."""


def update(old: DataFrame, revision: int, new: DataFrame, expected_revision: int, new_id) -> tuple[DataFrame, int]:
    """The next version: rows without ids get them from `new_id(kind, column)`; what exists may only change `active` and order.

    Raises TaxonomyConflict for a stale revision and TaxonomyError for the rest.
    """
    if expected_revision != revision:
        raise TaxonomyConflict(f"revision {revision}, expected {expected_revision}")
    made = new
    for kind in ("group", "category"):
        fresh = F.col(f"{kind}_id").isNull() & F.col(f"{kind}_name").isNotNull()
        source = F.when(fresh, "custom").otherwise(F.col(f"{kind}_source"))
        name = F.when(source == "historical", F.col(f"{kind}_name")).otherwise(F.coalesce(T.normalized_name(F.col(f"{kind}_name"), 12 if kind == "group" else 24), F.col(f"{kind}_name")))
        made = made.withColumns({f"{kind}_id": F.when(fresh, new_id(kind, F.col(f"{kind}_name"))).otherwise(F.col(f"{kind}_id")), f"{kind}_source": source, f"{kind}_name": name})
    changed = diff(items(old), items(made)).where(F.col("change").isin("changed", "removed"))
    if not changed.isEmpty():
        raise TaxonomyError("existing items can't be removed, renamed or moved")
    if (first := violations(made).first()) is not None:
        raise TaxonomyError(f"{first['rule']}: {first['item']}")
    return made, revision + 1
