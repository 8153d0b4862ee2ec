"""Exact top-k search by norm-bucketed retrieval.

Candidates are ordered by length and cut into buckets of bounded size. A bounded
seed of the longest vectors gives each query a score that its k-th best reaches
at least. In a bucket whose longest vector has length L, a query q then needs a
cosine of at least theta / (|q| L): above 1 the bucket is skipped (already in
the join, from bucket and block bounds alone); a high local threshold prunes by
coordinates (the unit vectors' range on the query's largest coordinates), a low
one by length. What is left is verified by exact integer products, one matrix product
for each pair of a block of queries and a bucket; a query's threshold rises with the
buckets that a task has done. Blocks and buckets travel in the narrowest integers that
hold them.

Components are floor(1024 * x). Vectors that are null, or hold null or
non-finite components, take no part; vectors of different lengths don't meet.
An empty vector takes part and scores 0. A query's own row is no candidate; other rows
of its id are. Each row of a repeated id is a query with an answer of its own, under the
same query_id. Ties go to the smaller id.
Products are exact while they fit a long. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BUCKET, BLOCK, SEED = 2048, 1024, 4096
FOCUS = 4
SLACK = 1e-9


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through doubles where every partial sum is below 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if top < 2**53 else q @ c.T


def narrow(z: np.ndarray) -> bytes:
    """The numbers in the narrowest integers that hold them, the width in front."""
    top = int(max(z.max(initial=0), -(z.min(initial=0) + 1)))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + z.astype(f"<i{width}").tobytes()


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _matrix(parts: list[bytes], dim: int) -> np.ndarray:
    return np.stack([_vector(p) for p in parts]).reshape(len(parts), dim) if len(parts) else np.empty((0, dim), np.int64)


def _ints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out: dict[str, list] = {"vec_id": [], "dim": [], "norm": [], "raw": []}
        for i, v in zip(f["vec_id"].tolist(), f["embedding"], strict=True):
            x = np.array([np.nan if c is None else c for c in v] if v.dtype == object else v, np.float64)
            if np.isfinite(x).all():
                z = np.floor(1024 * x).astype(np.int64)
                for k, y in zip(out, (i, len(z), float(np.sqrt((z.astype(float) ** 2).sum())), narrow(z)), strict=True):
                    out[k].append(y)
        yield pd.DataFrame(out)


def _bounds(seed, k: int):
    """Each block of queries with theta: the k-th best score over the seed, the query's own row left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            thetas, least = [], []
            for r in f.itertuples():
                q, qn = _matrix(r.q_raws, r.dim), np.asarray(r.q_norms)
                theta = np.full(len(q), -np.inf)
                if r.dim in seed.value:
                    rows, c = seed.value[r.dim]
                    s = products(q, c).astype(float)
                    s[np.asarray(r.q_rows)[:, None] == rows[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        theta = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                thetas.append(theta.tolist())
                # the shortest vector that any query of this block can still use
                least.append(float(np.where(theta > 0, theta / np.maximum(qn, 1e-300), 0).min()))
            raws = [narrow(_matrix(r.q_raws, r.dim).ravel()) for r in f.itertuples()]
            yield pd.DataFrame({"dim": f["dim"], "qb": f["qb"], "q_rows": f["q_rows"], "q_ids": f["q_ids"], "q_norms": f["q_norms"], "q_raw": raws, "thetas": thetas, "least": least})

    return run


def survivors(q: np.ndarray, q_norms: np.ndarray, thetas: np.ndarray, c: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """For each query (rows) which rows of a bucket, longest first, its product can reach theta with."""
    alive = np.ones((len(q), len(c)), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(thetas > 0, thetas / np.maximum(q_norms, 1e-300), 0.0)  # the length that a candidate needs
        local = np.where(least > 0, least / norms[0] if norms[0] else np.inf, 0.0)
    alive[local > 1 + SLACK] = False
    short = np.flatnonzero((local > 0) & (local < 0.5))  # length pruning
    alive[short] = norms[None, :] >= least[short, None] * (1 - SLACK)
    sharp = np.flatnonzero((local >= 0.5) & (local <= 1 + SLACK))  # coordinate pruning
    if len(sharp) and q.shape[1]:
        unit = q[sharp] / q_norms[sharp, None]
        units = (c / np.maximum(norms, 1e-300)[:, None]).T
        t = local[sharp]
        for place in np.argsort(-np.abs(unit), axis=1)[:, :FOCUS].T:
            x = unit[np.arange(len(sharp)), place]
            reach = np.sqrt(np.maximum(0.0, 1 - t**2) * np.maximum(0.0, 1 - x**2)) + SLACK
            low = np.where(x <= -t, -np.inf, x * t - reach)
            high = np.where(x >= t, np.inf, x * t + reach)
            p = units[place]
            alive[sharp] &= (p >= low[:, None]) & (p <= high[:, None])
    return alive


def best_of(scores: np.ndarray, able: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best able scores of each row (all, if fewer), ties to smaller ids, as rows, columns and the rows' k-th scores."""
    at, column = np.nonzero(able)
    own = scores[at, column]
    order = np.lexsort((ids[column], -own, at))
    at, column, own = at[order], column[order], own[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    floors = np.full(len(scores), -np.inf)
    last = np.flatnonzero(rank == k - 1)
    floors[at[last]] = own[last]
    return at[rank < k], column[rank < k], floors


def _scored(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        risen: dict[tuple[int, int], np.ndarray] = {}  # thresholds of the blocks of queries that this task has met
        for f in frames:
            for r in f.itertuples():
                q_rows, q_ids, q_norms, thetas = np.asarray(r.q_rows), np.asarray(r.q_ids), np.asarray(r.q_norms), risen.get((r.dim, r.qb), np.asarray(r.thetas))
                norms, ids = np.asarray(r.c_norms), np.asarray(r.c_ids)
                q, c = _vector(r.q_raw).reshape(len(q_ids), r.dim), _vector(r.c_raw).reshape(len(ids), r.dim)
                alive = survivors(q, q_norms, thetas, c, norms) & (q_rows[:, None] != np.asarray(r.c_rows)[None, :])
                own, met = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                if not len(own):
                    continue
                scores = products(q[own], c[met])
                able = alive[np.ix_(own, met)] & (scores >= thetas[own, None])
                if scores.shape[1] > k:  # only what reaches the k-th of this bucket is sorted
                    held = np.where(able, scores, np.iinfo(np.int64).min)
                    able &= scores >= np.partition(held, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
                at, column, floors = best_of(scores, able, ids[met], k)
                thetas = thetas.copy()
                thetas[own] = np.maximum(thetas[own], floors)
                risen[r.dim, r.qb] = thetas
                yield pd.DataFrame({"query": q_rows[own[at]], "query_id": q_ids[own[at]], "vec_id": ids[met[column]], "score": scores[at, column]}).astype(np.int64)

    return run


def _buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition as packed buckets of BUCKET rows of one dimension at most."""

    def pack(g: pd.DataFrame) -> dict:
        return {"dim": int(g["dim"].iat[0]), "longest": float(g["norm"].iat[0]), "c_rows": g["row"].tolist(), "c_ids": g["vec_id"].tolist(), "c_norms": g["norm"].tolist(), "c_raw": narrow(_matrix(g["raw"].tolist(), int(g["dim"].iat[0])).ravel())}

    kept = None
    for f in frames:
        f = f if kept is None else pd.concat([kept, f], ignore_index=True)
        groups = [g.iloc[i : i + BUCKET] for _, g in f.groupby("dim", sort=False) for i in range(0, len(g), BUCKET)]
        if groups:
            kept = groups.pop()
        if groups:
            yield pd.DataFrame([pack(g) for g in groups])
    if kept is not None and len(kept):
        yield pd.DataFrame([pack(kept)])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of vectors(vec_id, embedding) where is_query holds."""
    spark = vectors.sparkSession
    common.importable(spark)
    able = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    points = common.written(able.mapInPandas(_ints, "vec_id long, dim int, norm double, raw binary").withColumn("row", F.monotonically_increasing_id()), "points")

    seed = {}
    longest = points.orderBy(F.desc("norm"), "vec_id").limit(SEED).toPandas()  # SEED rows
    for dim, g in longest.groupby("dim"):
        seed[int(dim)] = (g["row"].to_numpy(), _matrix(g["raw"].tolist(), int(dim)))
    queries = points.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    held = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("dim", "qb")
    held = held.agg(F.collect_list("row").alias("q_rows"), F.collect_list("vec_id").alias("q_ids"), F.collect_list("norm").alias("q_norms"), F.collect_list("raw").alias("q_raws"))
    fields = "dim int, qb int, q_rows array<long>, q_ids array<long>, q_norms array<double>, q_raw binary, thetas array<double>, least double"
    held = common.written(held.mapInPandas(_bounds(spark.sparkContext.broadcast(seed), k), fields), "queries")

    ordered = points.repartitionByRange("dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id")
    buckets = ordered.mapInPandas(_buckets, "dim int, longest double, c_rows array<long>, c_ids array<long>, c_norms array<double>, c_raw binary")
    buckets = common.written(buckets.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    # every block of queries meets the buckets that are long enough for one of its queries; bounds alone decide that
    heads = buckets.select("bucket", "dim", "longest").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = heads.join(held, ["dim", "qb"]).where("longest >= least * (1 - 1e-9)")
    met = met.join(buckets.drop("dim", "longest"), "bucket")
    best = met.mapInPandas(_scored(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("query_id").cast("long"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
