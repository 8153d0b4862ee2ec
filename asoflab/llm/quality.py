"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Each training pair
prefers a document of quality 1 to one of quality 0; the weights minimise the
logistic loss on the pair's feature difference. A threshold at a quantile of the
training documents' strengths (the share of quality 0 among them, unless given)
turns strengths into scores: the quantile maps to ``cut``, so score >= cut keeps
what lies above it.

Every labelled document is trained on. The documents are dealt to blocks of about BLOCK by
the hash of their id, one block if there are no more; a label that is rarer than FEW a
block goes to several blocks each. A block's weights come from ``max_pairs`` pairs drawn
within it, every document in one at least, and the weights are the blocks' mean, each by its
number of pairs of a good and a bad document. Middle, scale, threshold and width are those
of all labelled documents: their order is found by Spark, by ranges.
Scoring reads every whole text, long ones too. Null and empty texts score as a text of
no words. If a label is missing from the training rows, there is no preference to learn:
every document gets the same score, above the cut, and nothing is rejected. Repeated rows
are scored alike, each on its own, and equal strengths are equal scores; an empty table
gives no rows. The input's columns stay beside score and predicted, but for its own
ones of these two names; ``accepted`` keeps all of the input's columns and adds none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUNS = re.compile(r"[^\w\s]{2,}")
MARKS = '.,;:!?"|$%&#*@/\\()[]{}<>=+-_~^'
#: Labelled documents that are trained on together, and the least of a label in a block of them.
BLOCK, FEW = 6000, 500
NAMES = ("words", "length", "letters", "upper", "digits", "marks", "kinds_of_words", "top_word", "repeats", "runs", "lines", "same_lines", "sentences", "squeezed", "short", *MARKS)


def features(text: str | None) -> np.ndarray:
    t = text or ""
    words = t.split()
    n, w = max(1, len(t)), max(1, len(words))
    counts = Counter(words)
    lines = [x for x in t.split("\n") if x.strip()]
    own = np.array([t.count(c) for c in MARKS], float)
    upper = sum(map(str.isupper, words)) / w
    digits = sum(t.count(c) for c in "0123456789") / n
    top = max(counts.values(), default=0) / w
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    raw = t.encode("utf-8", "surrogatepass")
    squeezed = len(zlib.compress(raw, 1)) / max(1, len(raw))
    base = [np.log1p(len(words)), n / w / 10, sum(map(str.isalpha, words)) / w, upper, digits, own.sum() / n, len(counts) / w, top, repeats, len(RUNS.findall(t)) / w, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), own[0] / w, squeezed, float(len(words) < 5)]
    return np.concatenate([base, own / w])


class Ranker:
    def __init__(self, weights: np.ndarray, middle: np.ndarray, scale: np.ndarray, threshold: float, width: float, cut: float) -> None:
        self.weights, self.middle, self.scale, self.threshold, self.width, self.cut = weights, middle, scale, threshold, width, cut

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (self.strengths(x) - self.threshold) / self.width + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gradient(weights: np.ndarray, differences: np.ndarray) -> np.ndarray:
    """Of the mean of log(1 + exp(-w d)) over the pairs' differences d."""
    return -(differences / (1 + np.exp(np.clip(differences @ weights, -60, 60)))[:, None]).mean(axis=0)


def descend(g: np.ndarray, b: np.ndarray, max_pairs: int = 60000, steps: int = 400, rate: float = 0.05, decay: float = 1e-3, seed: int = 3) -> np.ndarray:
    """Weights from pairs of a row of g and a row of b, which are scaled."""
    rng = np.random.default_rng(seed)
    weights, m, v = (np.zeros(g.shape[1]) for _ in range(3))
    left, right = rng.integers(0, len(g), max_pairs), rng.integers(0, len(b), max_pairs)
    lost, missed = np.setdiff1d(np.arange(len(g)), left), np.setdiff1d(np.arange(len(b)), right)  # those that no pair drew get one
    if len(lost) or len(missed):
        left, right = np.concatenate([left, lost, rng.integers(0, len(g), len(missed))]), np.concatenate([right, rng.integers(0, len(b), len(lost)), missed])
    for step in range(1, steps + 1):
        part = rng.integers(0, len(left), 4096)
        grad = gradient(weights, g[left[part]] - b[right[part]]) + decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def _of_blocks(middle: np.ndarray, scale: np.ndarray):
    """A block's weights, and how many pairs of a good and a bad document it has."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = [np.array(f.loc[f["quality"] == label, "features"].tolist()).reshape(-1, len(NAMES)) for label in (1, 0)]
        good, bad = (x[np.lexsort(x.T)] for x in own)  # rows come in any order
        if not len(good) or not len(bad):
            return pd.DataFrame({"block": [], "pairs": [], "weights": []})
        bad = np.random.default_rng(1).permutation(bad)
        g, b = (np.clip((x - middle) / scale, -8, 8) for x in (good, bad))
        return pd.DataFrame({"block": [f["block"].iat[0]], "pairs": [float(len(g)) * len(b)], "weights": [descend(g, b).tolist()]})

    return run


def dealt(rows: DataFrame, counts: dict[int, int], size: int, few: int) -> DataFrame:
    """rows(quality, key, ...) with block: of about ``size`` rows; a label rarer than ``few`` a block is in several, in all at most."""
    blocks = max(1, math.ceil(sum(counts.values()) / size))
    copies = {label: min(blocks, max(1, math.ceil(few * blocks / n))) for label, n in counts.items()}
    own = F.when(F.col("quality") == 1, copies[1]).otherwise(copies[0])
    return rows.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), own - 1), lambda k: F.pmod(F.pmod("key", F.lit(blocks)) + k, F.lit(blocks)))))


def _middle_of(placed: DataFrame, keys: list[str], n: int) -> dict:
    """Medians of n rows each: the mean of the two in the middle."""
    rows = placed.where(F.col("place").isin((n + 1) // 2, n // 2 + 1)).groupBy(*keys).agg(F.avg("value").alias("value")).collect()  # one for each key
    return {r[0]: r["value"] for r in rows}


def train(docs: DataFrame, labels: DataFrame, cut: float = 0.7, size: int = BLOCK, few: int = FEW) -> Ranker:
    """docs(doc_id, text), labels(doc_id, quality): labels that are neither 0 nor 1, or repeat, are not used.

    No text moves, only its features.
    """
    common.importable(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def featured(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").dropDuplicates(["doc_id"])
    found = docs.where("doc_id is not null").select("doc_id", featured("text").alias("features")).join(rows, "doc_id")
    found = common.written(found.select("quality", F.xxhash64(F.lit(5), "doc_id").alias("key"), "features"), "featured")
    counts = {r["quality"]: r["n"] for r in found.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Ranker(np.zeros(len(NAMES)), np.zeros(len(NAMES)), np.ones(len(NAMES)), -1.0, 1.0, cut)
    deviations = found.agg(*[F.stddev_pop(F.col("features")[k]).alias(f"_{k}") for k in range(len(NAMES))]).first()
    scale = np.maximum(np.array(list(deviations), float), 1e-3)
    values = found.where("quality = 1").select(F.posexplode("features").alias("feature", "value"))
    medians = _middle_of(common.places_of(values, "feature", [F.col("value")]), ["feature"], counts[1])
    middle = np.array([medians[k] for k in range(len(NAMES))])

    parts = dealt(found, counts, size, few).groupBy("block").applyInPandas(_of_blocks(middle, scale), "block long, pairs double, weights array<double>").collect()  # a row for each block
    parts.sort(key=lambda r: r["block"])
    shares = np.array([r["pairs"] for r in parts])
    weights = (shares / shares.sum()) @ np.array([r["weights"] for r in parts])

    model = Ranker(weights, middle, scale, 0.0, 1.0, cut)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def strength(features: pd.Series) -> pd.Series:
        return pd.Series(held.value.strengths(np.stack(features)) if len(features) else [], dtype="float64")

    strengths = common.written(found.select("quality", strength("features").alias("value")), "strengths")
    # the quantile lies between two documents: the threshold takes the middle of that gap
    n = counts[0] + counts[1]
    k = min(max(1, round(counts[0] / n * n)), n - 1)
    at = common.global_places(strengths, [F.col("value")]).where(F.col("place").isin(k, k + 1))
    by_label = common.places_of(strengths, "quality", [F.col("value")])
    strong, weak = (_middle_of(by_label.where(F.col("quality") == label), ["quality"], counts[label])[label] for label in (1, 0))
    model.threshold, model.width = float(at.agg(F.avg("value")).first()[0]), float(max(1e-6, (strong - weak) / 8))
    return model


def _score(docs: DataFrame, model: Ranker) -> Column:
    common.importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.stack([features(t) for t in text]) if len(text) else np.empty((0, len(NAMES)))
        return pd.Series(held.value.scores(x), dtype="float64")

    return score(docs["text"])


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """docs(doc_id, text, ...) with score and predicted (1: at or above the cut) in place of columns of these names."""
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("score", "predicted")], _score(docs, model).alias("score")).withColumn("predicted", (F.col("score") >= model.cut).cast("int"))


def accepted(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of docs, with all their columns, that are at or above the cut."""
    return docs.where(_score(docs, model) >= model.cut)
