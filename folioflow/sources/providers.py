"""Pluggable recognisers: a provider maps Arrow batches on the executors, and stubs stand in for models.

A provider object is sent to the tasks; `open` runs once per task, so a model is
loaded there and not on the driver. A failing row gives an error, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    schema: str  # of what `read` returns

    def open(self) -> None: ...

    def read(self, row: dict) -> dict: ...


class Stub:
    """Answers every row with the same values, or with a function of the row."""

    def __init__(self, schema: str, answer: dict | Callable[[dict], dict]):
        self.schema, self.answer = schema, answer

    def open(self) -> None:
        return None

    def read(self, row: dict) -> dict:
        return self.answer(row) if callable(self.answer) else dict(self.answer)


def provide(df: DataFrame, key: str, provider: Provider, columns: list[str]) -> DataFrame:
    """`key`, the provider's fields and `error` ("Type: message", null if none) for every row; only `columns` are sent."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(provider.schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.open()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    said = provider.read(row)
                    out.append({key: row[key], **{n: said.get(n) for n in names}, "error": None})
                except Exception as e:  # noqa: BLE001 - a bad row must not fail the others
                    out.append({key: row[key], **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, {provider.schema}, error string")


def first_available(df: DataFrame, key: str, providers: list[Provider], columns: list[str]) -> DataFrame:
    """Each row's first answer without an error; the last provider's error where all fail. Later ones see only what failed before."""
    left, done = df, None
    for i, p in enumerate(providers):
        said = provide(left, key, p, columns)
        good = said if i == len(providers) - 1 else said.where("error is null")
        done = good if done is None else done.unionByName(good)
        left = left.join(said.where("error is not null").select(key), key, "left_semi")
    return done


def ocr_lines(words: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Recognised boxes (`key`, line, text, confidence, x, y, w, h) as one `lines` array per page, top to bottom."""
    item = F.struct((-F.col("y")).alias("__y"), F.col("x").alias("__x"), F.col(line).alias("__i"), F.struct("text", "confidence", F.struct("x", "y", "w", "h").alias("box")).alias("l"))
    return words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda z: z["l"]).alias("lines"))  # one page's lines
