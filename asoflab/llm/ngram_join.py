"""N-gram Jaccard join: exact links between word-shingle sets, and their components.

A document's set is its distinct w-word shingles (all its words as one shingle if
it has fewer; empty without words). Two documents link when
100 * |x & y| >= percent * |x | y|.

Set relations are what keeps the work linear:

* Equal sets are one set. Copies are folded by a 128-bit signature first.
* The index lists of the prefix filter are cut into blocks by set size, and an
  entry is compared only when its position leaves room for the needed overlap
  (whole blocks are skipped by size, entries inside by position).
* Each block has a pivot, the entry with the smallest position: the most central
  set of the list. The pivot's answers are computed first: its overlaps with all sets
  that it may link with. A set that links with the pivot takes over the pivot's
  component; only sets of other components still need to be compared, and only with
  entries that their positions allow.
* Their answers are derived from those of the pivot b most similar to the set a, by
  what a and b do not share: |a & c| is at least |a & b| + |c & b| - |b| and at most
  |c & b| + |a - b| and |a & b| + |c - b|. That settles a pair either way, or leaves
  it to be verified on whole texts.

Tokens are ordered by corpus frequency, rare first. The frequency is read from a
counting sketch of fixed size over all documents, so that what is broadcast does
not grow; collisions move a token in the order, which costs time, never links.
Shingles are compared as 64-bit hashes, so "exact" holds but for their collisions.

Extra columns are ignored; an empty table gives no rows.
Nulls, empty and white-space texts have empty sets and link with nothing. Rows of
one id are rows of their own, each linked by its own text; a component's id is the
smallest of its rows. Long texts are processed whole. A null id stays, linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKETCH = 1 << 20  # counters, four bytes each: 4 MB are broadcast, whatever the input
BLOCKS = 256
BITMAP = 1 << 23  # bits of the candidates' bitmap: 1 MB, whatever the input
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(width, n)
    acc = h[: n - width + 1].copy()
    for k in range(1, width):
        acc *= MIX[0]
        acc ^= acc >> np.uint64(29)
        acc += h[k : n - width + 1 + k]
    acc ^= acc >> np.uint64(30)
    acc *= MIX[1]
    acc ^= acc >> np.uint64(27)
    acc *= MIX[2]
    acc ^= acc >> np.uint64(31)
    return np.unique(acc)


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _profile(width: int):
    """A row with signature and size for each document, then the partition's counters by block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SKETCH, np.int32)
        for f in frames:
            sets = [shingles(t, width) for t in f["text"]]
            some = [s for s in sets if len(s)]
            if some:
                counts += np.bincount((np.concatenate(some) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.int32)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "sig": [signature(s) if len(s) else None for s in sets], "n": [len(s) for s in sets], "block": pd.array([None] * len(f), "Int32"), "counts": None})
        parts = counts.reshape(BLOCKS, -1)
        full = np.flatnonzero(parts.any(axis=1))
        if len(full):
            yield pd.DataFrame({"doc_id": pd.array([None] * len(full), "Int64"), "sig": None, "n": 0, "block": full.astype(np.int32), "counts": [parts[k].tobytes() for k in full]})

    return run


def _summed(f: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // BLOCKS, np.int64)
    for c in f["counts"]:
        total += np.frombuffer(c, np.int32)
    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    return pd.DataFrame({"block": [f["block"].iat[0]], "salt": [f["salt"].iat[0] // 64], "counts": [total.tobytes()]})


def sketch(profile: DataFrame) -> np.ndarray:
    """The sum of all partitions' counters: SKETCH numbers."""
    parts = profile.where("block is not null").select("block", (F.xxhash64("counts") % 64 + 64).cast("int").alias("salt"), "counts")
    schema = "block int, salt int, counts binary"
    first = parts.groupBy("block", "salt").applyInPandas(_summed, schema).withColumn("salt", F.lit(0))
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.int32)
    for row in first.groupBy("block", "salt").applyInPandas(_summed, schema).collect():  # BLOCKS rows at most
        out[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def _prefixes(counts, width: int, percent: int):
    """Signature, size and prefix (rarest tokens first) of each non-empty set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for f in frames:
            out: dict[str, list] = {"doc_id": [], "sig": [], "n": [], "prefix": []}
            for i, t in zip(f["doc_id"].tolist(), f["text"], strict=True):
                s = shingles(t, width)
                n = len(s)
                if not n:
                    continue
                many = often[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                p = prefix_length(n, percent)
                order = np.argsort(many, kind="stable")[:p]
                for k, v in zip(out, (i, signature(s), n, s[order].view(np.int64)), strict=True):
                    out[k].append(v)
            yield pd.DataFrame(out)

    return run


def _size_block(n, percent: int):
    """Sets that can link have sizes of 100 / percent times each other at most: they are in the same block or the next."""
    return F.floor(F.log(n.cast("double")) / math.log(max(1.01, 100 / percent))).cast("int")


def _possible(percent: int) -> str:
    """Size and position filters of two index entries (n, pos) and (m, at): positions count from 0."""
    return f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - pos, m - at) >= {percent} * (n + m)"


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of hashed candidate ids, as bytes; 32,768 bits to a row, so 256 rows come to the driver."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    rows = ids.select((bucket / 32768).cast("int").alias("part"), (bucket % 32768).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros((BITMAP // 32768, 4096), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _overlaps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:  # texts become Python's one at a time
            kept: dict[int, np.ndarray] = {}
            both, x, y = [], f.column("text_a"), f.column("text_b")
            for k, b in enumerate(f.column("b").to_pylist()):
                if b not in kept:
                    kept = {b: shingles(y[k].as_py(), width)} if len(kept) > 256 else kept | {b: shingles(y[k].as_py(), width)}
                both.append(len(np.intersect1d(shingles(x[k].as_py(), width), kept[b], assume_unique=True)))
            yield pa.RecordBatch.from_arrays([*(f.column(c) for c in ("a", "b", "n", "m")), pa.array(both, pa.int64())], ["a", "b", "n", "m", "both"])

    return run


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, n, m) with the number of shingles that their whole texts share."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "n", "m", "text_a", "text_b").mapInArrow(_overlaps(width), "a long, b long, n long, m long, both long")


def _links(both: str, percent: int) -> str:
    """Whether sets of n and m shingles link that share so many."""
    return f"100 * {both} >= {percent} * (n + m - {both})"


def derived(rest: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """rest(a, b, n, m) with ``sure`` (links), or without a row where no link is possible, from the answers of the pivot most similar to a."""
    guides = answers.groupBy("a").agg(F.max_by(F.struct(F.col("b").alias("pivot"), F.col("m").alias("size"), F.col("both").alias("own")), F.struct("both", "b")).alias("guide"))
    guided = rest.join(guides, "a", "left").select("a", "b", "n", "m", "guide.pivot", "guide.size", "guide.own")
    known = answers.select(F.col("a").alias("b"), F.col("b").alias("pivot"), F.col("both").alias("other"))
    told = guided.join(known, ["b", "pivot"], "left")
    told = told.withColumn("least", F.greatest(F.lit(0), F.col("own") + F.col("other") - F.col("size"))).withColumn("most", F.least(F.expr("other + n - own"), F.expr("own + m - other"), F.least("n", "m")))
    told = told.where(f"other is null or {_links('most', percent)}")
    return told.select("a", "b", "n", "m", F.expr(f"other is not null and {_links('least', percent)}").alias("sure"))


def _texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, text) of the documents named in pairs; a bitmap thins the scan before the join."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = spark.sparkContext.broadcast(_bitmap(ids))

    @F.pandas_udf("boolean")
    def marked(bucket: pd.Series) -> pd.Series:
        b = bucket.to_numpy(np.int64)
        return pd.Series((bits.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    some = docs.where("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))).where(marked("bucket"))
    return common.written(some.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text); rows are compared by number, so each text of a repeated id has its own links."""
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    numbered = common.written(docs.select(F.col("doc_id").cast("long").alias("id"), number.alias("doc_id"), "text"), "rows")
    placed = common.written(_components(numbered.select("doc_id", "text"), width, percent), "placed-rows")
    ids = placed.where("doc_id is not null").join(numbered.where("doc_id is not null").select("doc_id", "id"), "doc_id")
    least = ids.groupBy("component_id").agg(F.min("id").alias("least"))
    named = ids.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))
    return named.union(placed.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text) whose ids are null or not repeated."""
    spark = docs.sparkSession
    common.importable(spark)
    profile = common.written(docs.mapInPandas(_profile(width), "doc_id long, sig binary, n long, block int, counts binary"), "profile")
    counts = spark.sparkContext.broadcast(sketch(profile))

    named = docs.where("doc_id is not null")
    prefixes = named.mapInPandas(_prefixes(counts, width, percent), "doc_id long, sig binary, n long, prefix array<long>")
    sets = common.written(prefixes.groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "sets")

    entries = sets.select("id", "n", _size_block(F.col("n"), percent).alias("size_block"), F.posexplode("prefix").alias("pos", "token"))
    lists = common.written(entries.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1").select("token"), "lists")
    # only lists with two entries or more can link; pivots are one for each block of such a list
    shared = common.written(entries.join(lists, "token"), "index")
    pivots = shared.groupBy("token", "size_block").agg(F.count("*").alias("entries"), F.min(F.struct("pos", "n", "id")).alias("pivot")).where("entries > 1")
    pivots = common.written(pivots.select("token", "size_block", F.col("pivot.id").alias("b"), F.col("pivot.n").alias("m"), F.col("pivot.pos").alias("at")), "pivots")
    near = shared.join(pivots, ["token", "size_block"]).where(f"id <> b and {_possible(percent)}")
    near = common.written(near.select(F.col("id").alias("a"), "b", "n", "m").distinct(), "near")
    answers = common.written(overlaps(near, _texts_of(docs, near), width), "pivot-answers")
    links = answers.where(_links("both", percent)).select("a", "b")

    known = common.connected_components(links)
    placed = shared.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = common.written(placed, "placed")
    # a list of one component is answered; in the others, the entries outside the largest component meet all entries
    heads = placed.groupBy("token", "component").agg(F.count("*").alias("entries"))
    heads = heads.groupBy("token").agg(F.max_by("component", F.struct("entries", "component")).alias("main"), F.count("*").alias("components")).where("components > 1")
    open_lists = common.written(placed.join(common.written(heads.select("token", "main"), "heads"), "token"), "open")
    minor = open_lists.where("component <> main").select("token", F.col("id").alias("a"), "n", "pos", F.col("component").alias("c"), "size_block")
    minor = minor.withColumn("size_block", F.explode(F.sequence(F.col("size_block") - 1, F.col("size_block") + 1)))
    others = open_lists.select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("d"), "main", "size_block")
    rest = minor.join(others, ["token", "size_block"]).where(f"c <> d and (d = main or a < b) and {_possible(percent)}")
    ordered = F.when(F.col("a") < F.col("b"), F.struct("a", "b", "n", "m")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("n").alias("m")))
    rest = rest.select(ordered.alias("pair")).select("pair.*").distinct()
    rest = rest.join(near, ["a", "b"], "left_anti").join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    rest = common.written(derived(rest, answers, percent), "rest")
    unsure = rest.where("not sure")
    more = overlaps(unsure, _texts_of(docs, unsure), width).where(_links("both", percent)).select("a", "b").union(rest.where("sure").select("a", "b"))
    more = common.written(more, "more")

    joined = common.connected_components(more.select("a", "b").union(known.select(F.col("node").alias("a"), F.col("component").alias("b"))).union(links))
    by_sig = common.written(sets.select("sig", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("sig", F.coalesce("component", "id").alias("component_id")), "answers")
    rows = profile.where("block is null").select("doc_id", "sig", F.col("n").alias("n_shingles"))
    lone = rows.where("sig is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("sig is not null and doc_id is not null").join(by_sig, "sig").select("doc_id", "n_shingles", "component_id").union(lone)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: the smallest id, null ids last, then the smallest hash of the text.

    Rows are numbered first and compared by number, so rows of one id and rows without
    an id are compared like any others. Rows without words link with nothing and all stay.
    """
    numbered = common.written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own")), "numbered")
    placed = _components(numbered.select(F.col("row").alias("doc_id"), "own.text"), width, percent)
    order = numbered.select("row", F.struct(F.col("own.doc_id").isNull().alias("unnamed"), F.col("own.doc_id").alias("doc_id"), F.xxhash64("own.text").alias("hash"), "row").alias("place"))
    kept = placed.select(F.col("doc_id").alias("row"), "component_id").join(order, "row").groupBy("component_id").agg(F.min("place").alias("place"))
    # the kept numbers grow with the rows: never broadcast, whatever a small table would allow
    kept = common.written(kept.select("place.row"), "kept").hint("merge")
    return numbered.join(kept, "row", "left_semi").select("own.*")
