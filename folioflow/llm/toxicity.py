"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from the labelled sample by
log odds; the trees read its densities, how near its words stand to words that
address someone, capitals, punctuation, and words written with signs for
letters. The fit uses at most `MAX_LABELLED` labelled documents (a fixed bound,
whole texts); calibration takes each part of them as trees of the other parts see
it (the same rows only where a class has a single one).

Defined results: null text counts as empty and is scored; without labelled rows
of both classes every score is the base rate (0 without any rows), and any two
rows of both are fitted; repeated
rows get equal scores; labels, language, source and id are never inputs.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import slices, with_column
from folioflow.llm._features import LEET, MIXED, SECOND, SHAPE, shape, words_of
from folioflow.llm._gbt import fit_gbt, fit_isotonic, gbt_margin, isotonic
from folioflow.llm._labelled import collected_features, labelled_rows, remainder
from folioflow.llm._tables import discard, written

MAX_LABELLED = 6_000
FOLD = (5, 0)
BEGINNINGS = (4, 5, 6, 7, 8)
LEXICON = 1500
LEAST_G = 20.0  # likelihood ratio, about 4.5 standard deviations
LEAST_DOCS = 4
KEPT_WORDS = 150_000  # of a worker's memory of looked-up words; emptied when full
NEAR = 4


def _entries(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def entry_counts(sample: DataFrame, parts: dict[int, int], folds: int) -> DataFrame:
    """Per entry the documents of the sample that hold it, by label and part: `c0` to `c{2 * folds - 1}`, those of label 1 first."""
    names = [f"c{i}" for i in range(2 * folds)]

    def work(batches):
        met: dict[str, list[int]] = {}
        for b in slices(batches):
            for i, y, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = parts[i] + folds * (y == 0)
                for e in {e for w in set(words_of(text)) for e in _entries(w)}:
                    met.setdefault(e, [0] * len(names))[at] += 1
        columns = list(zip(*met.values(), strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["entry", *names])

    counted = sample.select("id", "y", "text").mapInArrow(work, ", ".join(["entry string", *(f"{n} long" for n in names)]))
    return counted.groupBy("entry").agg(*[F.sum(n).alias(n) for n in names]).where(sum((F.col(n) for n in names[:folds]), F.lit(0)) >= LEAST_DOCS)


def learn_lexicon(counts: DataFrame, totals: np.ndarray, but: int | None = None) -> dict[str, float]:
    """Log odds of words (ending in "$") and beginnings that far more documents of label 1 hold, of all parts or all but one.

    At most `LEXICON`, those with the highest likelihood ratios.
    """
    folds = len(totals) // 2
    seen = [q for q in range(folds) if q != but]
    nt, nc = (float(sum(totals[q + k] for q in seen)) for k in (0, folds))
    if not nt or not nc:
        return {}
    a, b = (sum((F.col(f"c{q + k}") for q in seen), F.lit(0)).cast("double") for k in (0, folds))
    n, share = F.col("a") + F.col("b"), nt / (nt + nc)
    part = lambda x, of: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (n * of))).otherwise(0.0)
    odds = F.log((F.col("a") + 0.5) / (nt - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (nc - F.col("b") + 0.5))
    scored = counts.select("entry", a.alias("a"), b.alias("b")).where(F.col("a") >= LEAST_DOCS).select("entry", (2 * (part("a", share) + part("b", 1 - share))).alias("g"), odds.alias("odds"))
    best = scored.where((F.col("g") >= LEAST_G) & (F.col("odds") >= 0.7)).orderBy(F.desc("g"), "entry").limit(LEXICON)
    return {r["entry"]: r["odds"] for r in best.collect()}


class Lookup(dict):
    """word -> highest log odds of its entries, remembered."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = v = max((self.lexicon.get(e, 0.0) for e in _entries(word)), default=0.0)
        return v


def features(text: str, words: list[str], known: Lookup) -> list[float]:
    odds = [known[w] for w in words]
    k = max(1, len(words))
    hits = [i for i, v in enumerate(odds) if v]
    strong = [i for i in hits if odds[i] >= 2.0]
    near = sum(any(w in SECOND for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in strong)
    masked = sum(known[w] >= 2.0 for w in (m.lower().translate(LEET) for m in MIXED.findall(text)))
    top = sorted((odds[i] for i in strong), reverse=True)[:5]
    return [
        len(hits) / k, len(strong) / k, math.log1p(len(strong)), len({words[i] for i in strong}), sum(odds[i] for i in hits) / k,
        top[0] if top else 0.0, sum(top), sum(odds[i] for i in strong) / max(1, len(strong)), near / k, near, masked, len(strong) / math.sqrt(k),
        *shape(text, words),
    ]


NAMES = ("hit_density", "strong_density", "log_strong", "distinct_strong", "odds_density", "top", "top5", "mean_strong", "near_density", "near", "masked", "strong_by_root", *SHAPE)


def _trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Leaves need a hessian of 2, or a tenth of the sample's where that is less."""
    rate = y.mean()
    return fit_gbt(x, y, trees=70, depth=4, rate=0.15, least=min(2.0, 0.1 * len(y) * rate * (1 - rate)))


def deal(ids: np.ndarray, y: np.ndarray) -> tuple[dict[int, int], int]:
    """The part of each id, and how many parts: four, or as many as the rarer label has rows. Each part has rows of both."""
    folds = int(min(4, (y == 0).sum(), (y == 1).sum()))
    part = np.zeros(len(y), int)
    for v in (0, 1):
        part[y == v] = np.arange((y == v).sum()) % folds
    return dict(zip(ids.tolist(), part.tolist(), strict=True)), folds


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = FOLD, limit: int = MAX_LABELLED) -> dict:
    """The lexicon, the trees and the calibration curve.

    Executors count entries, compute features and fit the parts' trees; the
    driver sees lexicons, labels and `limit` vectors of features.
    """
    sample = written(labelled_rows(docs, labels, (F.col("toxic") != 0).cast("int"), fold, limit))
    # ids and labels only, of at most `limit` rows
    rows = sorted((r["id"], r["y"]) for r in sample.select("id", "y").collect())
    ids, y = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float)
    if len(np.unique(y)) < 2:
        discard(sample)
        return {"constant": float(y.mean()) if len(y) else 0.0}
    parts, folds = deal(ids, y)
    part = np.array([parts[i] for i in ids.tolist()])
    totals = np.array([((part == q) & (y == v)).sum() for v in (1, 0) for q in range(folds)])
    counts = written(entry_counts(sample, parts, folds))
    whole = learn_lexicon(counts, totals)
    # a part's features come from a lexicon that has not seen the part; a single part has seen itself
    apart = [learn_lexicon(counts, totals, q) for q in range(folds)] if folds > 1 else [whole]

    def make():
        lookups = [Lookup(x) for x in apart]

        def of(i: int, text: str) -> list[float]:
            return features(text, words_of(text), lookups[parts[i]])

        return of

    _, _, x = collected_features(sample, make)
    discard(sample, counts)
    x = x.astype(float)
    shared = docs.sparkSession.sparkContext.broadcast((x, y, part))  # at most `limit` vectors

    def fitted(batches):
        x, y, part = shared.value
        for b in batches:
            for q in b.column(0).to_pylist():
                seen = (part != q) | (folds == 1)
                model = _trees(x[seen], y[seen])
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([pickle.dumps(model)], pa.binary()), pa.array([gbt_margin(model, x[part == q]).tobytes()], pa.binary())], names=["q", "model", "margin"])

    # one task a part, and one for all rows
    made = docs.sparkSession.range(folds + 1, numPartitions=folds + 1).selectExpr("cast(id as int) as q").mapInArrow(fitted, "q int, model binary, margin binary").collect()
    margin = np.zeros(len(y))
    for r in made:
        margin[part == r["q"]] = np.frombuffer(bytes(r["margin"]))
    return {"lexicon": whole, "gbt": pickle.loads(bytes(next(r["model"] for r in made if r["q"] == folds))), "curve": fit_isotonic(margin, y)}


def _scorer(model: dict):
    """Makes a task's function from texts to scores."""

    def make():
        known = Lookup(model.get("lexicon", {}))

        def work(texts: list) -> list[float]:
            if "constant" in model:
                return [model["constant"]] * len(texts)
            x = np.array([features(t, words_of(t), known) for t in (t or "" for t in texts)], float).reshape(-1, len(NAMES))
            return isotonic(model["curve"], gbt_margin(model["gbt"], x)).tolist()

        return work

    return make


def with_score(df: DataFrame, text: str, model: dict, name: str = "toxicity_score") -> DataFrame:
    """`df` with the calibrated score of every whole text in the column `name`."""
    return with_column(df, name, "double", text, _scorer(model))


def score(df: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """`key` and the calibrated `score` of every whole text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return with_score(rows, "text", model, "score").select(F.col("key").alias(key), "score")


def op10_toxicity_boosted(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, "doc_id", "text", train(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD[0]) == FOLD[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
