"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are hashed into `DIMENSIONS` counts: the shape of each piece
between spaces, its ending signs, its word, and the quantile bins of the dense
text features. Weighted by log count and inverse document frequency and
projected on the `RANK` strongest left singular directions of the labelled
sample, they give unit vectors. The labelled vectors (at most `MAX_LABELLED`
rows of `RANK` numbers, a fixed bound) are broadcast; each document takes exact
cosine products with all of them, block by block, and its `NEIGHBOURS` nearest
vote with a power of their similarity.

Defined results: null text counts as empty and is scored; a vector of zeros and
a vote without positive similarity give the sample's base rate; without any
labelled rows every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import map_columns
from folioflow.llm._features import SHAPE, shape, words_of
from folioflow.llm._labelled import collected_features, labelled_rows, remainder

MAX_LABELLED = 4096
FOLD = (4, 2)
DIMENSIONS = 2048
RANK = 48
BINS = 12
NEIGHBOURS = 25
POWER = 4
BLOCK = 256
THRESHOLD = 0.7
KEPT_PIECES = 150_000  # of a worker's memory of hashed pieces; emptied when full
_SIGNS = "".join(chr(i) for i in range(128) if chr(i) not in "Aa0")
_RUNS = re.compile(r"(.)\1+")


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % DIMENSIONS


class _Kinds(dict):
    """A sign's code -> its kind: "A" and "a" for letters, "0" for digits, other signs themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


class Pieces(dict):
    """A piece between spaces -> the slots of its terms."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[str, tuple[int, int]] = {}  # of kinds of signs, which are far fewer than pieces

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT_PIECES:
            self.clear()
        kinds = piece.translate(_KINDS)
        out = (*(self.shapes.get(kinds) or self._shape(kinds)), _slot("w:" + piece.lower()))
        if len(piece) <= 64:
            self[piece] = out
        return out

    def _shape(self, kinds: str) -> tuple[int, int]:
        if len(self.shapes) >= KEPT_PIECES:
            self.shapes.clear()
        end = len(kinds.rstrip(_SIGNS)) if kinds.isascii() else max((i + 1 for i, c in enumerate(kinds) if c in "Aa0"), default=0)
        out = _slot("s:" + _RUNS.sub(r"\1\1", kinds)), _slot("t:" + kinds[end:])
        if len(kinds) <= 64:
            self.shapes[kinds] = out
        return out


def counts(texts: list[str], known: Pieces, edges: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed term counts and dense features of some texts."""
    made, dense = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros((len(texts), len(SHAPE)))
    for i, t in enumerate(texts):
        slots = list(chain.from_iterable([known[p] for p in t.split()]))
        if slots:
            made[i] = np.bincount(slots, minlength=DIMENSIONS)
        dense[i] = shape(t, words_of(t))
    if edges is not None:
        _add_bins(made, dense, edges)
    return made, dense


BIN_SLOTS = np.array([[_slot(f"f:{j}:{b}") for b in range(BINS)] for j in range(len(SHAPE))])


def _add_bins(made: np.ndarray, dense: np.ndarray, edges: np.ndarray) -> None:
    rows = np.arange(len(made))
    for j in range(dense.shape[1]):
        np.add.at(made, (rows, BIN_SLOTS[j][np.searchsorted(edges[:, j], dense[:, j])]), 20.0)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _weighted(made: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(made) * idf)


def fit(made: np.ndarray, dense: np.ndarray, y: np.ndarray) -> dict:
    """Feature bins, term weights, the latent basis and the labelled vectors, of hashed counts and dense features."""
    if not len(y):
        return {"constant": 0.0}
    edges = np.quantile(dense, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    _add_bins(made, dense, edges)
    idf = np.log((1 + len(y)) / (1 + (made > 0).sum(0))).astype(np.float32) + 0.1
    x = _weighted(made, idf)
    # the strongest directions by subspace iteration from a seeded start
    basis = np.random.default_rng(5).normal(size=(DIMENSIONS, RANK)).astype(np.float32)
    for _ in range(8):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return {"edges": edges, "idf": idf, "basis": basis, "vectors": _unit(x @ basis), "y": y.astype(np.float32), "base": float(y.mean())}


def vote(model: dict, x: np.ndarray) -> np.ndarray:
    """Similarity-weighted label means of the nearest labelled vectors; equal similarities all count."""
    like = x @ model["vectors"].T
    k = min(NEIGHBOURS, like.shape[1])
    edge = np.partition(like, like.shape[1] - k, axis=1)[:, like.shape[1] - k, None]
    weight = np.where(like >= edge, np.maximum(like, 0), 0).astype(np.float64) ** POWER
    total = weight.sum(1)
    return np.where(total > 0, (weight @ model["y"]) / np.maximum(total, 1e-12), model["base"])


def scores(model: dict, texts: list[str], known: Pieces) -> list[float]:
    out: list[float] = []
    for i in range(0, len(texts), BLOCK):
        made, _ = counts(texts[i : i + BLOCK], known, model["edges"])
        out += np.clip(vote(model, _unit(_weighted(made, model["idf"]) @ model["basis"])), 0, 1).tolist()
    return out


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = FOLD, limit: int = MAX_LABELLED) -> dict:
    """The model of the labelled rows; executors count their terms, and `limit` vectors of counts come to the driver."""

    def make():
        known = Pieces()
        return lambda _, text: np.concatenate([c[0] for c in counts([text], known, None)])

    _, y, x = collected_features(labelled_rows(docs, labels, F.col("quality"), fold, limit), make)
    return fit(x[:, :DIMENSIONS].copy(), x[:, DIMENSIONS:].astype(float), y)


def score(df: DataFrame, key: str, text: str, model: dict) -> DataFrame:
    """`key` and the `score` of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # MAX_LABELLED x RANK numbers and the basis

    def make():
        known = Pieces()

        def work(keys, texts):
            if "constant" in shared.value:
                return [keys, [shared.value["constant"]] * len(keys)]
            return [keys, scores(shared.value, [t or "" for t in texts], known)]

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_columns(df.select(F.col(key).alias("key"), F.col(text).cast("string")), make, f"key {kind}, score double").withColumnRenamed("key", key)


def op3_quality_neighbours(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, "doc_id", "text", train(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLD[0]) == FOLD[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
