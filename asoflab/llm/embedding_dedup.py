"""Embedding near-dedup by sorted projection passes.

Each pass hashes a vector to the sign bits of random projections, orders all
vectors by (pass, label, concatenated bits) and compares each with the next
``window`` ones, over the edges of partitions too. Pairs whose cosine reaches the
threshold are united across the passes.

A pass finds a pair at the threshold if its leading bits agree, as many as it takes to
leave a window's worth of the label's vectors. How likely that is follows from the label's
size and from the angles between its vectors, of one crowd or of many, in few directions or
in all. They are taken from a sample of about SAMPLE vectors of each label, drawn by the hash
of the id; so each label gets as many passes as miss MISSED of such pairs at most, and its
vectors are centred first where that takes fewer. Labels of any size and any crowd go through
the passes, and through nothing else: no label is small enough for another way. A label of n
vectors that are all just below the threshold takes n * log(1 / MISSED) / (2 * window) passes.

Inside each component found all vectors are compared, which counts every direct link
of its members without emitting pairs. That runs on a grid: vectors of a group fall into
cells of bounded size, a task compares two cells, so a hot group is many tasks.

Cosines are computed in double precision from the vectors as they are (float or double).
Equal vectors of one label are one point with a multiplicity; labels of any type that
casts to text are compared by that text. Rows whose vector is null, zero or holds null or
non-finite components, or whose label is null, link with nothing. Vectors of different
lengths never link. Extra columns are ignored. A row without an id keeps a null component
and is kept. Rows that repeat an id count as vectors of their own. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BITS = 62
CELL = 4096  # vectors of a grid's cell
PACK = 256  # vectors that travel in a row
MISSED = 0.01  # of a label's pairs at the threshold, by chance of all its passes
LEAST_PASSES = 16
SAMPLE = 512  # vectors of each label that its passes are reckoned from
CENTRED = 0.05  # labels of a greater mean cosine may be centred
MOST_LABELS = 20_000  # whose sizes and means are broadcast: counted


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def planes(seed: int, number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).standard_normal((BITS, dim))


def found_in_a_pass(y: np.ndarray, near: np.ndarray, n: float, least: float, window: int) -> np.ndarray:
    """How likely one pass finds a partner at the threshold, for each row of y: a sample of a label of n vectors, centred or not.

    ``near`` marks pairs of the sample at or over the threshold: they are links, which help, and don't count as a crowd.
    Two rows share a leading bit as often as their angle says, so n times the mean of that to the power of L is the crowd
    that shares a row's first L bits. If the partner shares them too, both lie anywhere in that crowd, and at most a window apart
    with a chance of 1 - (1 - window / crowd)**2. The best L counts, so this is a low estimate.
    """
    norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-12)
    unit = y / norms[:, None]
    agree = np.where(near, 0.0, 1 - np.arccos(np.clip(unit @ unit.T, -1.0, 1.0)) / np.pi)
    own = 1 - np.arccos(np.clip(1 - (1 - least) / norms**2, -1.0, 1.0)) / np.pi
    best, crowd, shared = np.zeros(len(y)), (~near).astype(np.float64), np.ones(len(y))
    for _ in range(BITS + 1):
        best = np.maximum(best, shared * (1 - (1 - np.minimum(1.0, window / np.maximum(1e-9, n * crowd.mean(axis=1)))) ** 2))
        crowd, shared = crowd * agree, shared * own
    return best


def passes_for(x: np.ndarray, n: float, least: float, window: int) -> tuple[int, np.ndarray | None]:
    """Passes that a label of n vectors needs, LEAST_PASSES at least, by a sample x of its unit vectors; and its mean if it is to be centred."""
    mean = x.mean(axis=0)
    near = (x @ x.T) >= least
    np.fill_diagonal(near, True)
    ways = [(found_in_a_pass(x - m if m is not None else x, near, n, least, window), m) for m in (None, mean if len(x) > 1 and mean @ mean > CENTRED else None)]
    missed = lambda found, passes: np.exp(passes * np.log1p(-np.minimum(found, 0.999999))).mean()
    best = None
    for found, centre in ways:
        low, high = 0, LEAST_PASSES
        while missed(found, high) > MISSED:
            low, high = high, 2 * high
        while low >= LEAST_PASSES and high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if missed(found, middle) > MISSED else (low, middle)
        if best is None or high < best[0]:
            best = high, centre
    return best


def _plans(least: float, window: int, kind: str):
    """Passes of a label, and its mean if it is to be centred, from its sample."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable")
        passes, mean = passes_for(unit_rows(f["raw"].tolist(), kind), float(f["n"].iat[0]), least, window)
        return pd.DataFrame({"label": [f["label"].iat[0]], "dim": [f["dim"].iat[0]], "passes": [passes], "mean": [None if mean is None else mean.tolist()]})

    return run


def planned(points: DataFrame, least: float, window: int, kind: str) -> DataFrame:
    """(label, dim, passes, mean) of the labels of points(label, dim, id, raw), each by about SAMPLE of its vectors (all, if fewer)."""
    sizes = common.written(points.groupBy("label", "dim").agg(F.count("*").alias("n")), "label-counts")
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_LABELS else sizes
    drawn = points.join(sizes, ["label", "dim"]).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < F.lit(SAMPLE * float(1 << 40)) / F.col("n"))
    return common.written(drawn.groupBy("label", "dim").applyInPandas(_plans(least, window, kind), "label string, dim int, passes int, mean array<double>"), "labels")


def _keys(seed: int, kind: str):
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (label, dim), g in f.groupby(["label", "dim"]):
                x = unit_rows(g["raw"].tolist(), kind)
                mean = g["mean"].iat[0]
                if mean is not None:
                    x = x - np.asarray(mean)
                for p in range(int(g["passes"].iat[0])):
                    yield pd.DataFrame({"pass": p, "label": np.full(len(g), label, object), "dim": int(dim), "key": ((x @ planes(seed, p, int(dim)).T) > 0) @ weights, "id": g["id"], "raw": g["raw"].astype(object)})

    return run


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while (y := self.up.get(x, x)) != top and y != x:
            self.up[x], x = top, y
        return top

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


EDGES = "a long, b long, part int, place int, pass int, label string, dim int, id long, raw binary"


def _linked(f: pd.DataFrame, old: int, window: int, least: float, kind: str, forest: Forest) -> list[tuple[int, int]]:
    """Pairs of sorted rows within a window, one of them from row ``old`` on, that join two trees."""
    pairs: list[tuple[int, int]] = []
    for _, g in f.groupby(["pass", "label", "dim"], sort=False):
        x, ids, at = unit_rows(g["raw"].tolist(), kind), g["id"].to_numpy(), g.index.to_numpy()
        for d in range(1, min(window, len(g) - 1) + 1):
            near = np.flatnonzero((np.einsum("ij,ij->i", x[d:], x[:-d]) >= least) & (at[d:] >= old))
            pairs += zip(ids[near].tolist(), ids[near + d].tolist(), strict=True)
    return [(min(p), max(p)) for p in pairs if forest.unite(*p)]


def _windows(window: int, least: float, kind: str):
    """Links of each sorted partition, and its first and last rows for the windows that go over its edges."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, kept, part, place = Forest(), None, TaskContext.get().partitionId(), 0
        columns = [c.split()[0] for c in EDGES.split(", ")]
        for f in frames:
            first = place == 0
            place += len(f)
            if kept is not None:
                f = pd.concat([kept, f], ignore_index=True)
            old = 0 if kept is None else len(kept)
            new = _linked(f, old, window, least, kind, forest)
            if first and len(f):
                yield f.head(window).assign(a=None, b=None, part=part - 1, place=range(window, window + min(window, len(f)))).astype({"label": object})[columns]
            kept = f.tail(window).reset_index(drop=True)
            yield pd.DataFrame(new, columns=["a", "b"], dtype=np.int64).assign(**dict.fromkeys(columns[2:]))
        if kept is not None and len(kept):
            yield kept.assign(a=None, b=None, part=part, place=range(len(kept))).astype({"label": object})[columns]

    return run


def _over_edges(window: int, least: float, kind: str):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", kind="stable").reset_index(drop=True)
        return pd.DataFrame(_linked(f, int((f["place"] < window).sum()), window, least, kind, Forest()), columns=["a", "b"], dtype=np.int64)

    return run


def window_links(keyed: DataFrame, window: int, least: float, kind: str) -> DataFrame:
    """Links (a, b) between rows at most ``window`` places apart in the order of (pass, label, dim, key, id)."""
    order = ["pass", "label", "dim", "key", "id"]
    found = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_windows(window, least, kind), EDGES)
    found = common.written(found, "pairs")
    edges = found.where("raw is not null")
    # partitions may be empty: the last rows of one meet the first rows of the next that isn't (one row for each partition here)
    parts = edges.where(F.col("place") < window).select("part").distinct()
    parts = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")) - 1, F.lit(-1)).alias("until"))
    last = edges.where(F.col("place") < window).join(parts, "part").withColumn("part", F.col("until")).drop("until")
    over = last.unionByName(edges.where(F.col("place") >= window)).where("part >= 0").groupBy("part").applyInPandas(_over_edges(window, least, kind), "a long, b long")
    return found.where("a is not null").select("a", "b").union(over)


def on_grid(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members(grp, id, copies, raw) dealt to (grp, x, y, cell, ids, copies, raws): the packed rows that the pair (x, y) of a group's cells needs."""
    cells = sizes.select("grp", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.ceil(F.col("n") / PACK).cast("int").alias("packs"))
    placed = members.join(cells, "grp").withColumn("pack", F.pmod(F.xxhash64("id"), "packs").cast("int"))
    packed = placed.groupBy("grp", "cells", "pack").agg(F.collect_list("id").alias("ids"), F.collect_list("copies").alias("copies"), F.collect_list("raw").alias("raws"))
    own = common.written(packed.withColumn("cell", F.pmod("pack", "cells")), "packed")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    return own.select("grp", "cell", "ids", "copies", "raws", other).select("grp", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "cell", "ids", "copies", "raws")


def _sides(f: pd.DataFrame, kind: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, multiplicities and unit vectors of the pair's cells: one side if they are the same."""
    out = []
    for _, g in f.groupby("cell"):
        raws = [r for part in g["raws"] for r in part]
        out.append((np.concatenate(g["ids"].tolist()), np.concatenate(g["copies"].tolist()), unit_rows(raws, kind)))
    return out


def _counted(least: float, kind: str):
    """Direct links of the rows of two cells, by row."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(f, kind)
        same = key[1] == key[2]
        if not same and len(sides) < 2:
            return pd.DataFrame({"id": [], "links": []}).astype(np.int64)
        (ids, copies, x), (other_ids, other_copies, y) = sides[0], sides[-1]
        counts, back = np.zeros(len(ids), np.int64), np.zeros(len(other_ids), np.int64)
        for a in range(0, len(ids), 512):
            near = (x[a : a + 512] @ y.T) >= least
            if same:
                near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            counts[a : a + 512] = near @ other_copies
            back += near.T @ copies[a : a + 512]
        found = [(ids, counts)] if same else [(ids, counts), (other_ids, back)]
        return pd.DataFrame({"id": np.concatenate([i for i, _ in found]), "links": np.concatenate([c for _, c in found])})

    return run


def _raw(kind: str):
    """Vectors as bytes; null where the row takes no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = []
            for v in f["embedding"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v] if v.dtype == object else v, kind)
                raw.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "label": f["label"].astype(object), "dim": [len(r) // int(kind[2]) if r else 0 for r in raw], "raw": raw})

    return run


def near_components(vectors: DataFrame, least: float = 0.98, window: int = 32, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label)."""
    common.importable(vectors.sparkSession)
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if narrow else "<f8"
    embedding = F.col("embedding") if narrow else F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding, F.col("label").cast("string").alias("label"))
    rows = common.written(rows.mapInPandas(_raw(kind), "vec_id long, label string, dim int, raw binary"), "vectors")
    able = rows.where("vec_id is not null and label is not null and raw is not null")
    points = common.written(able.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "points")

    plans = planned(points, least, window, kind)
    plans = F.broadcast(plans) if plans.count() <= MOST_LABELS else plans
    by_label = points.join(plans, ["label", "dim"])
    keyed = by_label.select("label", "dim", "id", "raw", "passes", "mean").mapInPandas(_keys(seed, kind), "pass int, label string, dim int, key long, id long, raw binary")
    edges = window_links(keyed, window, least, kind)
    found = common.written(common.connected_components(common.written(edges, "links")), "components")

    members = points.join(found.withColumnRenamed("node", "id"), "id").select(F.col("component").alias("grp"), "id", "copies", "raw")
    sizes = common.written(found.groupBy(F.col("component").alias("grp")).agg(F.count("*").alias("n")), "sizes")
    links = on_grid(members, sizes).groupBy("grp", "x", "y").applyInPandas(_counted(least, kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))

    answers = points.join(links, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    answers = common.written(answers.select("label", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "answers")
    done = able.join(answers, ["label", "raw"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    lone = rows.where("vec_id is null or label is null or raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return done.union(lone)
