"""Correlations of many columns at once: ranks by ranges of values, rows packed as arrays, cross moments of all pairs in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import ratio
from asoflab.operators.evaluate import components
from asoflab.sources import shared

#: What each pair's running sums are: pairs, sums of both, of their squares, of their products.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def spread_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row, columns..., ranks): each column's average rank over its own non-nulls, as one array beside the values.

    Values become rows (column, value), are sorted by ranges and ranked inside each range; only a range's first and last value
    may go on in others, so a table of two values for each range, broadcast, tells what lies before them. A value that a third
    of all rows share spreads over as many ranges as it fills, and nothing is joined on values. Every value travels three times as a
    row of its own: ``pair_moments`` ranks without that.
    """
    shared.checkpoint_dir(df.sparkSession)
    numbered = df.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("double").alias(c) for c in columns]).checkpoint()
    long = numbered.select("row", F.posexplode(F.array(*columns)).alias("c", "v")).where("v IS NOT NULL")
    order = ["c", "v", "row"]
    ranged = long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    by = Window.partitionBy("part", "c").orderBy("v")
    local = ranged.withColumns({"least": F.rank().over(by), "ties": F.count(F.lit(1)).over(by.rangeBetween(Window.currentRow, Window.currentRow))})
    ends = ranged.groupBy("part", "c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row for each range and column in it
    # a value at an end of a range: its rows in all ranges, and where the first of them stands
    edge = local.join(F.broadcast(ends.select("part", "c", "low", "high", "before")), ["part", "c"])
    marked = edge.where("v = low OR v = high").groupBy("c", "v", "part").agg(F.first("ties").alias("ties"), F.min(F.col("before") + F.col("least")).alias("first"))
    whole = marked.groupBy("c", "v").agg(F.sum("ties").alias("all_ties"), F.min("first").alias("first"))
    ranked = edge.join(F.broadcast(whole), ["c", "v"], "left")
    rank = F.coalesce(F.col("first"), F.col("before") + F.col("least")) + (F.coalesce("all_ties", "ties") - 1) / F.lit(2.0)
    own = ranked.select("row", F.struct("c", rank.alias("rank")).alias("r")).groupBy("row").agg(F.map_from_entries(F.collect_list("r")).alias("ranks"))
    told = numbered.join(own, "row", "left")
    return told.select("row", *columns, F.array(*[F.col("ranks")[k] for k in range(len(columns))]).alias("ranks"))


#: Rows that are packed together at least, and rows of a column that a range of its values holds on average.
CHUNK, RANGE = 1 << 18, 1 << 19
#: Rows whose moments are taken at once.
BLOCK = 1 << 14
PACKED = "chunk long, data array<binary>, marks array<array<double>>, sums array<array<double>>"
#: Of arrays of columns, keys together and in order, the arrays of the columns that are correlated.
Made = Callable[[Mapping[str, np.ndarray]], Sequence[np.ndarray]]


def _told(x: np.ndarray, rising: bool = False) -> bytes:
    """Doubles, NaN too, in few bytes and exactly: as multiples of a decimal unit where they are some, in steps if they rise, byte by byte of all of them."""
    kind, whole = 255, x.view(np.int64)
    for digits in (0, 2, 4, 6):
        y = x * 10.0**digits
        if np.isfinite(y).all() and (np.abs(y) < 2**52).all() and (np.rint(y) / 10.0**digits == x).all():
            kind, whole = digits, np.rint(y).astype(np.int64)
            break
    if rising and len(whole):
        whole = np.r_[whole[0], whole[1:] - whole[:-1]]  # ends where it began, should it overflow
    bytes_of = np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 8).T.tobytes()
    return bytes([kind, rising]) + len(x).to_bytes(8, "little") + (pa.compress(bytes_of, codec="zstd", asbytes=True) if len(x) else b"")


def _read(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[2:10], "little")
    if n == 0:
        return np.empty(0)
    whole = np.frombuffer(pa.decompress(raw[10:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n).T.copy().view(np.int64)[:, 0]
    whole = np.cumsum(whole) if raw[1] else whole
    return whole.view(float) if raw[0] == 255 else whole / 10.0 ** raw[0]


def _sums(columns: Sequence[np.ndarray]) -> np.ndarray:
    """(column, columns * SUMS) of rows."""
    out = np.zeros((len(SUMS), len(columns), len(columns)))
    for k in range(0, len(columns[0]), BLOCK):
        x = np.column_stack([c[k : k + BLOCK] for c in columns])
        there = ~np.isnan(x)
        m, z = there.astype(float), np.where(there, x, 0.0)
        out += np.stack([m.T @ m, z.T @ m, m.T @ z, (z * z).T @ m, m.T @ (z * z), z.T @ z])
    return out.transpose(1, 2, 0).reshape(len(columns), -1)


def _packed(names: Sequence[str], made: Made, key: str | None):
    """Chunks of a task's rows: their columns, 64 values of each made column in order, and sums of values. Rows of a key are in one chunk."""
    at = names.index(key) if key else None

    def chunk(number: int, rows: list[np.ndarray]) -> pd.DataFrame:
        columns = made(dict(zip(names, rows, strict=True)))
        marks = []
        for c in columns:
            values = np.sort(c[~np.isnan(c)])
            marks.append(values[np.linspace(0, len(values) - 1, min(len(values), 64)).astype(int)].tolist() if len(values) else [])
        return pd.DataFrame([(number, [_told(x) for x in rows], marks, _sums(columns).tolist())], columns=["chunk", "data", "marks", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        told = lambda rows: pa.RecordBatch.from_pandas(chunk(number, rows), schema=SHAPE, preserve_index=False)
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False).astype(float) + 0.0 for c in b.columns])
                n += b.num_rows
            if n >= CHUNK:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                # up to the last row of the last key that has ended
                same = np.zeros(n - 1, bool) if at is None else (rows[at][1:] == rows[at][:-1]) | (np.isnan(rows[at][1:]) & np.isnan(rows[at][:-1]))
                cut = n if at is None else int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield told([x[:cut] for x in rows])
                    number += 1
                held, n = ([[x[cut:] for x in rows]], n - cut) if cut < n else ([], 0)
        if n:
            yield told([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


SHAPE = pa.schema([("chunk", pa.int64()), ("data", pa.list_(pa.binary())), ("marks", pa.list_(pa.list_(pa.float64()))), ("sums", pa.list_(pa.list_(pa.float64())))])


def _columns(data: Sequence[bytes], names: Sequence[str], made: Made) -> Sequence[np.ndarray]:
    return made(dict(zip(names, map(_read, data), strict=True)))


def _counted(names: Sequence[str], made: Made):
    """Rows of a chunk by column and range of values."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for data, bounds in zip(f["data"], f["bounds"], strict=True):
                for c, x in enumerate(_columns(data, names, made)):
                    n = np.bincount(np.searchsorted(np.asarray(bounds[c], float), x[~np.isnan(x)], side="right"))
                    out += [(c, int(part), int(n[part])) for part in np.flatnonzero(n)]
            yield pd.DataFrame(out, columns=["c", "part", "n"])

    return run


def _dealt(names: Sequence[str], made: Made):
    """A chunk's distinct values of a column, cut at the column's bounds: (c, part, chunk, values, counts)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for chunk, data, bounds in zip(f["chunk"], f["data"], f["bounds"], strict=True):
                out = []
                for c, x in enumerate(_columns(data, names, made)):
                    values, counts = np.unique(x[~np.isnan(x)], return_counts=True)
                    part = np.searchsorted(np.asarray(bounds[c], float), values, side="right")
                    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(values) else []
                    out += [(c, int(part[i]), chunk, _told(values[i:j], True), _told(counts[i:j].astype(float))) for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pd.DataFrame(out, columns=["c", "part", "chunk", "values", "counts"])

    return run


def _ranked(f: pd.DataFrame) -> pd.DataFrame:
    """Twice the average ranks of each chunk's values in a range of a column, as ``before`` rows are in ranges before."""
    own = [_read(v) for v in f["values"]]
    counts = np.concatenate([_read(v) for v in f["counts"]])
    distinct, at = np.unique(np.concatenate(own), return_inverse=True)
    ties = np.bincount(at, weights=counts)
    ranks = (2 * (np.cumsum(ties) - ties + 1 + f["before"].iat[0]) + ties - 1)[at]
    cuts = np.cumsum([len(v) for v in own])[:-1]
    return pd.DataFrame({"c": f["c"], "part": f["part"], "chunk": f["chunk"], "ranks": [_told(r, True) for r in np.split(ranks, cuts)]})


def _rank_sums(names: Sequence[str], made: Made):
    """Sums of a chunk's ranks, by its rows' places among the distinct values and these values' ranks."""

    def run(key: tuple, chunk: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
        own, columns = dict(iter(ranks.sort_values(["c", "part"]).groupby("c")["ranks"])), list(_columns(chunk["data"].iat[0], names, made))
        for c, x in enumerate(columns):
            there = ~np.isnan(x)
            columns[c] = np.full(len(x), np.nan)
            if there.any():
                columns[c][there] = np.concatenate([_read(r) for r in own[c]])[np.unique(x[there], return_inverse=True)[1]] / 2
        return pd.DataFrame({"i": range(len(columns)), "sums": _sums(columns).tolist()})

    return run


def pair_moments(df: DataFrame, columns: Sequence[str], made: Made | None = None, key: str | None = None) -> DataFrame:
    """(kind, i, j, n, sx, sy, sxx, syy, sxy) of pairs i < j, kind 0 of values and 1 of average ranks over a column's own non-NULLs, over rows where both are there.

    Where ``made`` is given, it makes the columns of df's (numbers; NULL is NaN), for runs of whole keys if df's partitions hold the rows of a key in order.

    Rows are packed into chunks once, and what moves are arrays in few bytes: a chunk's distinct values of a column and their counts go to ranges of values,
    their ranks come back to the chunk, whose columns are made again. A value that many rows share is one entry of a chunk. The ranges'
    bounds are taken from the chunks' values; they decide who does the work, not what comes out, as equal values are in one range.
    """
    k, m, names = len(columns), len(SUMS), list(df.columns if made else columns)
    made = made or (lambda x: list(x.values()))
    shared.importable(df.sparkSession)
    chunks = shared.written(df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(_packed(names, made, key), PACKED), "chunks")
    marks = chunks.select("chunk", F.posexplode("marks").alias("c", "v"), F.get(F.get("sums", F.col("c")), F.col("c") * m).alias("n"))  # 64 values of a chunk and column
    parts = marks.groupBy("c").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("v"), F.sum("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.size("v") / (F.floor(F.col("n") / RANGE) + 1))).cast("int")
    bounds = parts.select("c", F.filter("v", lambda v, i: (i > 0) & (i % step == 0)).alias("bounds"))
    bounds = bounds.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "bounds"))), lambda x: x["bounds"]).alias("bounds"))  # one row
    bounded = chunks.select("chunk", "data").crossJoin(F.broadcast(bounds))
    ahead = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = bounded.mapInPandas(_counted(names, made), "c int, part int, n long").groupBy("c", "part").agg(F.sum("n").alias("n"))  # a row for each range
    before = counted.select("c", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    dealt = bounded.mapInPandas(_dealt(names, made), "c int, part int, chunk long, values binary, counts binary").join(F.broadcast(before), ["c", "part"])
    ranked = dealt.groupBy("c", "part").applyInPandas(_ranked, "c int, part int, chunk long, ranks binary")
    of_ranks = chunks.select("chunk", "data").groupBy("chunk").cogroup(ranked.groupBy("chunk")).applyInPandas(_rank_sums(names, made), "i int, sums array<double>")
    both = chunks.select(F.lit(0).alias("kind"), F.posexplode("sums").alias("i", "sums")).unionByName(of_ranks.select(F.lit(1).alias("kind"), "i", "sums"))
    each = both.select("kind", "i", F.posexplode("sums").alias("at", "x")).groupBy("kind", "i", "at").agg(F.sum("x").alias("x"))
    j, s = F.floor(F.col("at") / m), F.col("at") % m
    return each.groupBy("kind", "i", j.alias("j")).agg(*[F.max(F.when(s == q, F.col("x"))).alias(n) for q, n in enumerate(SUMS)]).where("i < j")


def all_correlations(df: DataFrame, columns: Sequence[str], least: int = 20, made: Made | None = None, key: str | None = None) -> DataFrame:
    """(a, b, n, pearson, spearman) of all pairs of columns (see ``pair_moments``) over rows where both are there; NULL for fewer than ``least`` rows or a constant side."""
    m = pair_moments(df, columns, made, key)
    sxx, syy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    flat = (sxx <= F.abs("sxx") * 1e-12) | (syy <= F.abs("syy") * 1e-12)
    r = F.when((F.col("n") >= least) & ~flat, ratio(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(sxx * syy)))
    names = F.array(*map(F.lit, columns))
    pairs = m.withColumn("r", r).groupBy("i", "j").agg(F.max("n").cast("long").alias("n"), F.max(F.when(F.col("kind") == 0, F.col("r"))).alias("pearson"), F.max(F.when(F.col("kind") == 1, F.col("r"))).alias("spearman"))
    return pairs.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), "n", "pearson", "spearman")


def feature_families(pairs: DataFrame, features: DataFrame, most: float = 0.8) -> DataFrame:
    """(family_type, family, feature): CORRELATION families are the components of |pearson| or |spearman| above ``most``, named by
    their first feature; SEMANTIC ones come from features(feature, semantic). Features are tens, pairs hundreds."""
    edges = pairs.where((F.abs("pearson") > most) | (F.abs("spearman") > most)).select("a", "b")
    held = components(edges, features.select(F.col("feature").alias("node")))
    sizes = held.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    own = held.join(sizes, "component").select(F.lit("CORRELATION").alias("family_type"), F.col("component").alias("family"), F.col("node").alias("feature"))
    return own.unionByName(features.select(F.lit("SEMANTIC").alias("family_type"), F.col("semantic").alias("family"), "feature"))
