"""Mixing to target weights by soft membership.

A softmax classifier, fitted on a labelled table, gives every document a
posterior over domains. Nonnegative document rates r then minimise

    1/2 sum_d (sum_i r_i t_i p_id - T_d)^2 / T_d  +  mu/2 sum_i t_i (r_i - 1)^2

for token counts t, posteriors p and targets T (a target below a thousandth of the
whole counts as that in the divisor), by accelerated projected gradients in the
metric of the token counts, with restarts. Dividing by the targets makes small
domains as quick as large ones; the step follows from the posteriors' second
moments, k by k numbers that the first round sums. Each round
sums the domain totals over the distributed table; only those totals come to the
driver, and only the history of their errors, a few numbers a round, goes back: a
rate depends on its posterior and that history alone, so tasks replay it and no
per-document state is kept between rounds. Rounds end when every domain's total
is within `TOLERANCE` of the whole from its target, or when no rate's projected gradient is above
`GRADIENT`, so that the targets are met as nearly as the posteriors allow; if
neither holds after `ROUNDS` the fit fails with the errors that are left.

The query's domains are the languages and quality labels of labelled documents;
the classifier reads dense text features and hashed words.

Targets of domains that no document can have are shared out among the others.
Defined results: null text counts as empty, with no tokens; labelled rows of one
domain alone give every document that domain, and without labelled rows every
document has the first target's, with rate T / S; any two domains are fitted, with
more regularisation the fewer rows there are; an empty table gives no rows;
repeated rows get equal rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm._arrow import map_columns
from folioflow.llm._features import SHAPE, Slots, shape, words_of
from folioflow.llm._labelled import collected_features, labelled_rows
from folioflow.llm._tables import written

MAX_LABELLED = 6_000
MU = 5e-3
ROUNDS = 600
TOLERANCE = 1e-3
GRADIENT = 5e-5
SEED = 77
WORD_SLOTS = 256

#: Shares of the mixed tokens by language and quality label.
TARGETS = {"en-q1": 0.48, "fr-q1": 0.16, "de-q1": 0.16, "es-q1": 0.12, "en-q0": 0.04, "fr-q0": 0.015, "de-q0": 0.015, "es-q0": 0.01}


def domain_of_labels() -> Column:
    """Of a labelled document, by its label `y` and its language."""
    return F.concat(F.col("lang"), F.lit("-q"), F.col("y").cast("int").cast("string"))


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 400) -> dict:
    """Multinomial logistic regression on standardised features, by accelerated gradients; one row's worth of regularisation."""
    l2 = 1.0 / len(x)
    mean, sd = x.mean(0), x.std(0) + 1e-6
    sd[len(SHAPE) :] *= 4  # many words together weigh as much as the dense features, which matters where rows are few
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    onehot = np.eye(k)[y]
    w = v = np.zeros((z.shape[1], k))
    rate = 2.0 / (np.linalg.norm(z, 2) ** 2 / len(z) + l2)
    for i in range(steps):
        a = z @ v
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - rate * (z.T @ (p - onehot) / len(z) + l2 * v)
        w, v = new, new + i / (i + 3) * (new - w)
    return {"mean": mean, "sd": sd, "w": w}


def softmax(model: dict, x: np.ndarray) -> np.ndarray:
    a = np.c_[np.clip((x - model["mean"]) / model["sd"], -8, 8), np.ones(len(x))] @ model["w"]
    p = np.exp(a - a.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def vector(text: str, words: list[str], slots: Slots) -> np.ndarray:
    return np.concatenate([shape(text, words), slots.rates(words)])


def train(docs: DataFrame, labels: DataFrame, label: Column, domain: Column, names: list[str], beside: tuple[str, ...] = (), limit: int = MAX_LABELLED) -> dict:
    """The classifier of the labelled rows whose `domain`, by the label `y` and the columns `beside`, is one of `names`."""
    index = F.array_position(F.array(*[F.lit(n) for n in names]), domain) - 1
    rows = labelled_rows(docs, labels, label, None, limit, beside).select("id", index.cast("double").alias("y"), "text").where("y >= 0")

    def make():
        slots = Slots(WORD_SLOTS)
        return lambda _, text: vector(text, words_of(text), slots)

    _, y, x = collected_features(rows, make)
    met = np.unique(y).astype(int)
    if len(met) < 2:
        return {"constant": int(met[0]) if len(met) else 0}
    return fit_softmax(x.astype(float), y.astype(int), len(names))


def memberships(docs: DataFrame, key: str, text: str, model: dict, names: list[str]) -> DataFrame:
    """`key`, `n_tokens` (words) and `posterior` of every whole text."""

    def make():
        slots = Slots(WORD_SLOTS)

        def work(keys, texts):
            tokens, x = [], np.zeros((len(texts), len(SHAPE) + WORD_SLOTS))
            for i, t in enumerate(texts):  # one text's words at a time in memory
                words = words_of(t or "")
                tokens.append(len(words))
                if "constant" not in model:
                    x[i] = vector(t or "", words, slots)
            p = np.tile(np.eye(len(names))[model["constant"]], (len(keys), 1)) if "constant" in model else softmax(model, x)
            return [keys, tokens, p.tolist()]

        return work

    kind = docs.schema[key].dataType.simpleString()
    return map_columns(docs.select(F.col(key).alias("key"), F.col(text).cast("string")), make, f"key {kind}, n_tokens long, posterior array<double>").withColumnRenamed("key", key)


def replay(p: np.ndarray, history: list[tuple[np.ndarray, float]], step: float, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """After the rounds so far (each a vector of errors and a momentum): the step's end, the rates, which lie ahead of it, and the last step's projected gradient and turn against its momentum."""
    r = ahead = np.ones(len(p))
    gradient = turn = np.zeros(len(p))
    for e, momentum in history:
        new = np.maximum(0.0, ahead - step * (p @ e + mu * (ahead - 1)))
        gradient, turn = np.abs(new - ahead) / step, (ahead - new) * (new - r)
        r, ahead = new, np.maximum(0.0, new + momentum * (new - r))
    return r, ahead, gradient, turn


def fit_rates(table: DataFrame, targets: np.ndarray, ratio: float, mu: float = MU, rounds: int = ROUNDS, tolerance: float = TOLERANCE, gradient: float = GRADIENT) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The history of domain errors (by target) and the step; `targets` are shares, `ratio` the mixed tokens by those there are."""
    k = len(targets)

    def summed(columns: list[str], of) -> np.ndarray:
        """Sums (the maximum of "steepest") of what `of` gives for tokens and posteriors, over the table."""
        schema = pa.schema([(n, pa.float64()) for n in columns])

        def work(batches):
            for b in batches:
                if b.num_rows:
                    t, p = b.column(0).to_numpy().astype(float), b.column(1).flatten().to_numpy().reshape(-1, k)
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in of(t, p)], schema=schema)

        row = table.select("n_tokens", "posterior").mapInArrow(work, ", ".join(f"`{n}` double" for n in columns)).agg(*[(F.max if n == "steepest" else F.sum)(n).alias(n) for n in columns]).first()
        return np.array([row[n] or 0.0 for n in columns])

    names = [f"d{i}" for i in range(k)]
    first = summed([*names, "all", *(f"m{i}" for i in range(k * k))], lambda t, p: (*(t @ p), t.sum(), *((p.T * t) @ p).ravel()))
    whole, moments = first[k], first[k + 1 :].reshape(k, k)
    if whole <= 0:
        return [], 0.0
    shares = np.where(first[:k] > 1e-6 * whole, targets, 0.0)
    shares = shares / shares.sum() if shares.sum() > 0 else first[:k] / whole
    s = ratio * whole
    scale = np.maximum(shares, 1e-3) * s
    step = 1.0 / (float(np.linalg.eigvalsh(moments / np.sqrt(np.outer(scale, scale)))[-1]) + mu)

    def totals(history: list) -> np.ndarray:
        def of(t, p):
            _, ahead, slope, turn = replay(p, history, step, mu)
            # a text without tokens counts for no total
            return (*((t * ahead) @ p), (t * turn).sum(), slope[t > 0].max(initial=0.0))

        return summed([*names, "turn", "steepest"], of)

    history, now, since = [], first[:k], 0
    for _ in range(rounds):
        off = now[:k] - shares * s
        if np.abs(off).max() <= tolerance * s:
            return history, step
        history.append((off / scale, since / (since + 3)))
        now = totals(history)
        if now[k + 1] <= gradient:
            return history, step
        since = 0 if now[k] > 0 else since + 1
    raise RuntimeError(f"rates not settled after {rounds} rounds: errors by domain {np.round((now[:k] - shares * s) / s, 5).tolist()}, projected gradient {now[k + 1]:.2g}")


def mix(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: Column | None = None, domain: Column | None = None, beside: tuple[str, ...] = ("lang",), targets: dict[str, float] | None = None, ratio: float = 1.0, seed: int = SEED
) -> DataFrame:
    """Per document: `key`, `n_tokens`, `posterior`, `rate`, and `copies`, the rate rounded at random by a seeded hash of the key.

    `label` is an expression over `labels`; `domain` names a labelled document's
    domain by that label, as `y`, and the columns `beside` of `docs`.
    """
    targets = targets or TARGETS
    names = list(targets)
    model = train(docs, labels, F.col("quality") if label is None else label, domain_of_labels() if domain is None else domain, names, beside)
    table = written(memberships(docs, key, text, model, names))
    wanted = np.array([targets[n] for n in names], float)
    history, step = fit_rates(table, wanted / wanted.sum(), ratio)

    def make():
        def work(keys, tokens, posterior):
            _, r, *_ = replay(np.array(posterior, float).reshape(-1, len(names)), history, step, MU)
            return [keys, tokens, posterior, r.tolist()]

        return work

    kind = docs.schema[key].dataType.simpleString()
    rated = map_columns(table.select(F.col(key).alias("key"), "n_tokens", "posterior"), make, f"key {kind}, n_tokens long, posterior array<double>, rate double").withColumnRenamed("key", key)
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def report(mixed: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Per domain: the `target` share of tokens, the `expected` share by rates and the `met` share by copies, over the posteriors of what `mix` gave."""
    wanted = sum(targets.values())
    parts = mixed.select("n_tokens", "rate", "copies", F.posexplode("posterior").alias("at", "p"))
    sums = parts.groupBy("at").agg(*[F.sum(F.col("n_tokens") * F.col("p") * F.col(c)).alias(c) for c in ("rate", "copies")])
    whole = sums.agg(F.sum("rate").alias("__r"), F.sum("copies").alias("__c"))  # one row
    names, shares = (F.array(*[F.lit(x) for x in values]) for values in (list(targets), [v / wanted for v in targets.values()]))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return sums.join(F.broadcast(whole)).select(names[F.col("at")].alias("domain"), shares[F.col("at")].alias("target"), share("rate", "__r").alias("expected"), share("copies", "__c").alias("met"))


def op7_mixing_soft(spark, sf_dir: str) -> DataFrame:
    """Per document its likeliest domain, posteriors, rate and copies, with its domain's target, expected and met shares."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    mixed = written(mix(docs, labels))
    names = F.array(*[F.lit(n) for n in TARGETS])
    top = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    rows = mixed.select("doc_id", "n_tokens", top.alias("domain"), *[F.col("posterior")[i].alias(f"p_{n.replace('-', '_')}") for i, n in enumerate(TARGETS)], "rate", "copies")
    # one row per domain is broadcast
    return rows.join(F.broadcast(report(mixed, TARGETS)), "domain", "left").select("doc_id", "n_tokens", "domain", *[c for c in rows.columns if c.startswith("p_")], "rate", "copies", "target", "expected", "met")
