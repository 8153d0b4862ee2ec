"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; every other document, labelled or
not, is unlabelled text. A linear classifier over hashed words and word beginnings
is trained with numpy on the risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

whose second term estimates the risk on negatives; where a mini-batch makes it
negative, the step goes against it (the non-negative correction). The class prior
is the share of positives among the labelled training rows unless it is given.

Training uses a bounded sample (``max_positive``, ``max_unlabelled``: the rows with
the smallest hash of their id, all of them if there are fewer). Only features that
clearly more positives than unlabelled texts hold get weights; Spark counts them, and
the driver gets only each sampled row's columns among them (``max_features`` at most,
the clearest first), so what it holds does not grow with the texts. Scoring reads every
whole text, long ones too. Null and empty texts score as a text without features: the
bias. Without positives every score is the prior. Repeated rows are scored alike, each
on its own; an empty table gives no rows. The input's columns
stay beside score and predicted, but for its own ones of these two names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[^\W\d_]+")
SPACE = 1 << 31
LIFT = 5.0


def features(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's words, of word beginnings, of beginnings that come
    twice or three times, and of how thickly those that come again are spread."""
    words = WORDS.findall((text or "").lower())
    counts = Counter(words)
    heads: Counter[str] = Counter()
    for w, n in counts.items():
        if len(w) > 4:
            heads[w[:4]] += n
            if len(w) > 6:
                heads[w[:6]] += n
    out = [*counts, *("^" + h for h in heads)]
    for h, n in heads.items():
        if n > 1:
            out.append(f"2{h}")
            if n > 2:
                out.append(f"3{h}")
            out.append(f"@{(len(words) // n).bit_length()}{h}")
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) & (SPACE - 1) for w in out), np.int64, len(out)))


def alike(x: np.ndarray) -> bytes:
    """The four smallest features (mixed anew): copies share them, and would count as many examples of a chance word."""
    mixed = (x.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
    return np.sort(mixed)[:4].tobytes()


def _featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [features(t) for t in f["text"]]
        yield pd.DataFrame({"positive": f["positive"], "alike": [alike(x) for x in found], "features": [x.astype(np.int32) for x in found]})


def _columns(at: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"positive": f["positive"], "columns": [np.flatnonzero(np.isin(at, x, assume_unique=True)).astype(np.int32).tobytes() for x in f["features"]]})

    return run


class Linear:
    """Weights by feature; ``at`` is sorted."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.at, self.weights, self.bias = at, weights, bias

    def columns(self, own: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, own)
        k = k[k < len(self.at)] if not len(self.at) else np.minimum(k, len(self.at) - 1)
        return k[self.at[k] == own] if len(self.at) else k[:0]

    def score(self, own: np.ndarray) -> float:
        z = self.bias + float(self.weights[self.columns(own)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class Rows:
    """Sparse rows of ones: columns one row after the other."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.columns = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def margins(self, theta: np.ndarray) -> np.ndarray:
        return theta[-1] + np.bincount(self.owner, theta[self.columns], self.n)

    def gradient(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.append(np.bincount(self.columns, per_row[self.owner], size - 1), per_row.sum())


def step(theta: np.ndarray, p: Rows, u: Rows, prior: float) -> tuple[float, float, np.ndarray]:
    """The risk on positives, the estimated risk on negatives, and the direction of descent:
    the gradient of their sum, or against that of the second where it is negative."""
    z_p, z_u = p.margins(theta), u.margins(theta)
    plus = prior * np.logaddexp(0, -z_p).mean()
    minus = -prior * np.logaddexp(0, z_p).mean() + (np.logaddexp(0, z_u).mean() if u.n else 0.0)
    s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    down = p.gradient(-prior * s_p / p.n, len(theta)) + (u.gradient(s_u / u.n, len(theta)) if u.n else 0.0)
    return plus, minus, p.gradient(-prior * (1 - s_p) / p.n, len(theta)) + down if minus >= 0 else -down


def fit(positives: list[np.ndarray], unlabelled: list[np.ndarray], at: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.15, decay: float = 1e-4, batch: int = 2048, seed: int = 11) -> Linear:
    """Adam on the non-negative risk with the logistic loss; rows are columns of ``at``."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    model = Linear(at, np.zeros(len(at)), float(np.log(prior / (1 - prior))))
    if not positives:
        return model
    rng = np.random.default_rng(seed)
    theta = np.append(model.weights, model.bias)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), 0
    batches = max(1, -(-(len(positives) + len(unlabelled)) // batch))
    for _ in range(epochs):
        parts_p, parts_u = (np.array_split(rng.permutation(len(x)), batches) for x in (positives, unlabelled))
        for own_p, own_u in zip(parts_p, parts_u, strict=True):
            _, _, g = step(theta, Rows([positives[i] for i in own_p] or positives), Rows([unlabelled[i] for i in own_u]), prior)
            g[:-1] += decay * theta[:-1]
            n += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    model.weights, model.bias = theta[:-1], float(theta[-1])
    return model


def chosen_features(rows: DataFrame, positives: int, unlabelled: int, most: int) -> np.ndarray:
    """Features of rows(positive, features) that positives hold clearly more often than unlabelled text of the same size would."""
    held = rows.select("positive", F.explode("features").alias("feature")).groupBy("feature")
    held = held.agg(F.count_if("positive").alias("often"), F.count_if(~F.col("positive")).alias("times"))
    held = held.withColumn("expected", positives * F.col("times") / F.lit(float(max(1, unlabelled))))
    excess = F.col("often") - F.col("expected")
    clear = held.where((F.col("often") >= min(3, positives)) & (excess > 4 * F.sqrt(F.col("expected") + 0.25)) & (F.col("often") > LIFT * F.col("expected")))
    found = clear.orderBy((excess / F.sqrt(F.col("expected") + 0.25)).desc(), "feature").limit(most).select("feature").collect()
    return np.sort(np.array([r["feature"] for r in found], np.int64))


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 12000, max_features: int = 20000) -> Linear:
    """docs(doc_id, text), labels(doc_id, toxic): toxic 1 is a positive, every other document is unlabelled.

    The sample is drawn from ids; only its documents' texts move.
    """
    common.importable(docs.sparkSession)
    known = labels.select("doc_id", (F.col("toxic") == 1).alias("positive")).where("positive is not null").dropDuplicates(["doc_id"])
    if prior is None:
        n = known.agg(F.count_if("positive").alias("p"), F.count("*").alias("n")).first()
        prior = n["p"] / n["n"] if n["n"] else 0.1
    positive = known.where("positive").select("doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    others = docs.select("doc_id").join(positive, "doc_id", "left_anti").distinct()
    picked = [common.bounded_sample(ids, most, 5).withColumn("positive", F.lit(kind)) for ids, most, kind in ((positive, max_positive, True), (others, max_unlabelled, False))]
    chosen = common.written(picked[0].union(picked[1]), "chosen")  # max_positive + max_unlabelled rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.mapInPandas(_featured, "positive boolean, alike binary, features array<int>").groupBy("positive", "alike")
    sample = common.written(sample.agg(F.min("features").alias("features")), "features")
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    at = chosen_features(sample, sizes.get(True, 0), sizes.get(False, 0), max_features)
    found = sample.select("positive", "features").mapInPandas(_columns(at), "positive boolean, columns binary").collect()
    own = [[np.frombuffer(x, np.int32) for x in sorted(bytes(r["columns"]) for r in found if r["positive"] == kind)] for kind in (True, False)]
    return fit(*own, at=at, prior=prior)


def scored(docs: DataFrame, model: Linear, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text, ...) with score and predicted in place of columns of these names."""
    common.importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(features(t)) for t in text], dtype="float64")

    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("score", "predicted")], score("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
