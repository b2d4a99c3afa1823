"""Likeness of two readings and what follows from it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioflow.functions import text as T


@F.pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("rounded", DoubleType())]))
def matching_ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Ratcliff-Obershelp ratio 2M/T of two strings, and that rounded to four places from its binary value; 0 where either is empty or null.

    The time grows with the product of the lengths: it is for readings of one
    question, some thousands of characters at most.
    """
    made = [difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"ratio": pd.Series(made, dtype="float64"), "rounded": pd.Series([round(v, 4) for v in made], dtype="float64")})


def similarity(primary: Column, secondary: Column) -> Column:
    """struct<ratio, rounded> of two readings, both in the form for comparing; one trip to Python."""
    return matching_ratios(T.normalize_for_compare(primary), T.normalize_for_compare(secondary))


def text_similarity(primary: Column, secondary: Column) -> Column:
    return similarity(primary, secondary)["ratio"]


def number_conflict(primary: Column, secondary: Column, similarity: Column) -> Column:
    """Whether two reliable readings have other numbers; an unlike or empty second reading says nothing."""
    return (T.text_of(secondary) != "") & (similarity >= T.RELIABLE_SIMILARITY) & (T.numbers(primary) != T.numbers(secondary))


def structured_problem(primary: Column, secondary: Column, hint: Column | None = None) -> Column:
    """Two readings as one question: struct<title, body, figure, primary_text, secondary_text, text_similarity, primary_numbers, secondary_numbers, review_reasons>."""
    first, second = T.question_fragment(primary, hint), T.question_fragment(secondary, hint)
    like = similarity(first["fragment"], second["fragment"])

    def read(v: Column) -> Column:
        p = v["p"]["fragment"]
        ordinal, worked = F.regexp_extract(p, T.TITLE, 3), F.replace(F.upper(F.regexp_extract(p, T.TITLE, 2)), F.lit("S"), F.lit("5"))
        kind = F.when(F.regexp_extract(p, T.TITLE, 1).startswith("练习"), "练习").otherwise("例题")
        title = F.when(~p.rlike(T.TITLE), T.NAMELESS_TITLE).when(ordinal != "", F.concat(F.lit("【第"), ordinal, F.lit("题】"))).otherwise(F.concat(F.lit("【"), kind, worked, F.lit("】")))
        body = F.when(p.rlike(T.TITLE), F.regexp_replace(F.trim(F.regexp_replace(p, T.TITLE, "")), r"^[、，,. \t]+", "")).otherwise(p)
        return T.let(F.struct(title.alias("title"), body.alias("body")), lambda t: judge(v, t))

    def judge(v: Column, t: Column) -> Column:
        p, s = v["p"]["fragment"], v["s"]["fragment"]
        own = F.array(F.when(t["title"] == T.NAMELESS_TITLE, T.REASON_TITLE), F.when(number_conflict(p, s, v["like"]["ratio"]), T.REASON_NUMBERS), F.when(F.length(t["body"]) < T.SHORT_BODY, T.REASON_SHORT))
        return F.struct(
            t["title"].alias("title"), t["body"].alias("body"), T.figure_kind(t["body"]).alias("figure"), p.alias("primary_text"), s.alias("secondary_text"), v["like"]["rounded"].alias("text_similarity"),
            T.numbers(p).alias("primary_numbers"), T.numbers(s).alias("secondary_numbers"), F.array_distinct(F.concat(v["p"]["reasons"], F.array_compact(own))).alias("review_reasons"),
        )

    return T.let(F.struct(first.alias("p"), second.alias("s"), like.alias("like")), read)
