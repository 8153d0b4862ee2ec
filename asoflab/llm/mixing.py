"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token weights of the
cells are raked: each sweep scales them to the target share of every source, then
of every language, then of every topic. A cell's documents are expected KEEP times
its wanted over its actual share of tokens times in the sample: each is there as many
times as that number has wholes, and once more with the rest as probability; a hash of
the document's id decides, so any re-run draws the same rows. A cell may need more than it
has, so the sample meets the targets and holds about KEEP of all tokens, however often the
documents of a rare cell have to be in it. A caller who wants no document more than
``most_copies`` times says so; the raking then gives no cell more than that and shares the
rest among the others, and ``marginals`` tells what each value lacks.

The raking runs on the table of cells (pre-aggregated, at most sources x languages
x topics rows); documents are only counted and filtered. All of it is DataFrame
expressions. ``marginals`` tells the shares that a sample has next to those wanted.

Sources, languages and topics without a target, and null ones, are the value
"other". Targets are shares of what is there: a target whose value doesn't occur
is spread over the others. Without targets every value that occurs gets the same share.
"other" has no share where its dimension's targets name none; with keep_other it has its
actual share of tokens there, and the targets share the rest.
Empty texts hold no tokens, weigh nothing, and are kept with their cell's
probability (0 in a cell without tokens). Null ids draw as the empty text does, and rows of
one id draw alike. An empty table gives no rows. Other columns aren't read by ``mixed`` and
are carried whole by ``sampled``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SWEEPS = 12  # of a round
MOST_ROUNDS = 6
TOLERANCE = 2e-3  # of a marginal, as a share of its target
MOST_CELLS = 50_000
KEEP = 0.5  # of a cell that already has its share
DIMENSIONS = ("source", "lang", "topic")

#: Topics by marks in the text; the first that holds decides.
TOPICS = (("table", " | "), ("mail", "@"), ("link", "http"), ("code", " = "))


def topic_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    found = F.lit("prose")
    for name, mark in reversed(TOPICS):
        found = F.when(F.instr(t, mark) > 0, F.lit(name)).otherwise(found)
    return found


def token_count(text: Column) -> Column:
    """White-space separated words, without building them: spaces' runs are closed first."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def _named(value: Column, targets: dict[str, float] | None) -> Column:
    value = F.coalesce(value, F.lit("other"))
    return value if targets is None else F.when(value.isin([*targets]), value).otherwise(F.lit("other"))


def _shares(cells: DataFrame, targets: dict[str, dict[str, float] | None], keep_other: bool) -> DataFrame:
    """cells with want_source, want_lang and want_topic; of all cells one row comes to the driver, and of each dimension with targets its values there."""
    told = cells.agg(F.sum("tokens").alias("tokens"), *[F.count_distinct(n).alias(n) for n in DIMENSIONS]).first()
    for name in DIMENSIONS:
        wanted = targets.get(name)
        if wanted is None:
            cells = cells.withColumn(f"want_{name}", F.lit(1.0 / max(1, told[name])))
            continue
        there = {r[name]: r["tokens"] for r in cells.groupBy(name).agg(F.sum("tokens").alias("tokens")).collect()}  # targets and "other" at most
        total = sum(share for value, share in wanted.items() if value in there)
        other = there.get("other", 0) / told["tokens"] if keep_other and "other" not in wanted and told["tokens"] else 0.0
        want = F.lit(other)
        for value, share in wanted.items():
            want = F.when(F.col(name) == value, F.lit(share / total * (1 - other) if total else 0.0)).otherwise(want)
        cells = cells.withColumn(f"want_{name}", F.when(F.col(name).isin([*wanted, "other"]), want).otherwise(F.lit(0.0)))
    return cells.withColumn("weight", F.try_divide(F.col("tokens").cast("double"), F.lit(float(told["tokens"] or 0))))


def residual(cells: DataFrame) -> float:
    """By how much, as a share of it, the weights of a source, language or topic differ most from what it should have; 0 where it can't have any."""
    parts = [cells.groupBy(n).agg(F.sum("weight").alias("has"), F.first(f"want_{n}").alias("want")).select("has", "want") for n in DIMENSIONS]
    off = F.when((F.col("has") > 0) & (F.col("want") > 0), F.abs(F.col("has") / F.col("want") - 1)).otherwise(0.0)
    return parts[0].union(parts[1]).union(parts[2]).agg(F.max(off).alias("off")).first()["off"] or 0.0


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None], sweeps: int = SWEEPS, keep_other: bool = False, tolerance: float = TOLERANCE, most_copies: int | None = None) -> DataFrame:
    """cells(source, lang, topic, tokens) with weight, the raked share of all tokens that each cell should have,
    expected, how many times a document of the cell should be in the sample, and probability, that it is there at all.

    Rounds of so many sweeps go on until no marginal is farther from its target than the tolerance; as targets may
    be impossible together, no longer than a round brings them nearer, and MOST_ROUNDS at most. The cells are one partition only if they are few, which is counted.
    """
    cells = common.written(cells, "cells")
    few = cells.count() <= MOST_CELLS
    cells = _shares(cells, targets, keep_other)
    before = math.inf
    if most_copies:
        cells = cells.withColumn("most", F.col("weight") * (most_copies / KEEP))
    for _ in range(MOST_ROUNDS):
        cells = cells.coalesce(1) if few else cells
        for _ in range(sweeps):
            for name in DIMENSIONS:
                scale = F.try_divide(F.col(f"want_{name}"), F.sum("weight").over(Window.partitionBy(name)))
                scaled = F.coalesce(F.col("weight") * scale, F.lit(0.0))
                cells = cells.withColumn("weight", F.least("most", scaled) if most_copies else scaled)
        cells = common.written(cells, "raked")
        off = residual(cells)
        if off <= tolerance or off > 0.9 * before:  # met, or as near as it gets
            break
        before = off
    total = cells.agg(F.sum("weight").alias("weight"), F.sum("tokens").alias("tokens")).first()
    cells = cells.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.lit(total["weight"] or 0.0)), F.lit(0.0)))
    need = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens").cast("double")), F.lit(0.0))
    wanted = F.coalesce(need * F.lit(float(total["tokens"] or 0)) * KEEP, F.lit(0.0))
    wanted = F.least(F.lit(float(most_copies)), wanted) if most_copies else wanted
    return cells.withColumn("expected", wanted).withColumn("probability", F.least(F.lit(1.0), wanted))


def marginals(rows: DataFrame) -> DataFrame:
    """(dimension, value, had, wanted, got) of a result of mixed: shares of tokens in the table, as raked, and in the sample."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("had"), F.first("weight").alias("wanted"), F.sum(F.col("n_tokens") * F.col("copies")).alias("got"))
    cells = common.written(cells, "marginals")
    total = cells.agg(*[F.sum(c).cast("double").alias(c) for c in ("had", "wanted", "got")]).first()
    parts = [cells.groupBy(F.col(n).alias("value")).agg(*[F.try_divide(F.sum(c).cast("double"), F.lit(total[c])).alias(c) for c in ("had", "wanted", "got")]).select(F.lit(n).alias("dimension"), "value", "had", "wanted", "got") for n in DIMENSIONS]
    return parts[0].union(parts[1]).union(parts[2])


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def copies(expected: Column, drawn: Column) -> Column:
    """How many times a document is in the sample: the wholes of expected, and one more by the draw."""
    return F.floor(expected) + (drawn < expected - F.floor(expected)).cast("long")


def _small(shares: DataFrame) -> DataFrame:
    """The raked cells, written once; broadcast only if they are few, which is counted."""
    shares = common.written(shares, "cells")
    return F.broadcast(shares) if shares.count() <= MOST_CELLS else shares


def mixed(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, seed: int = 17, sweeps: int = SWEEPS, keep_other: bool = False, most_copies: int | None = None) -> DataFrame:
    """docs(doc_id, text, source, lang) as (doc_id, source, lang, topic, n_tokens, weight, probability, drawn, kept, copies)."""
    targets = targets or {}
    named = [_named(F.col(n), targets.get(n)).alias(n) for n in ("source", "lang")]
    rows = docs.select("doc_id", *named, _named(topic_of(F.col("text")), targets.get("topic")).alias("topic"), token_count(F.col("text")).alias("n_tokens"))
    rows = common.written(rows, "rows")  # texts are read once
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    shares = rake(cells, targets, sweeps, keep_other, most_copies=most_copies).select(*DIMENSIONS, "weight", "expected", "probability")
    out = rows.join(_small(shares), [*DIMENSIONS])
    out = out.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", draw(F.col("doc_id"), seed).alias("drawn"), "expected")
    return out.withColumn("kept", F.col("drawn") < F.col("probability")).withColumn("copies", copies(F.col("expected"), F.col("drawn"))).drop("expected")


def sampled(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, seed: int = 17, keep_other: bool = False, most_copies: int | None = None) -> DataFrame:
    """The sample: rows of docs with their own columns, each as many times as its copies."""
    targets = targets or {}
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), "text", "source", "lang")
    values = [_named(F.col(n), targets.get(n)).alias(f"cell_{n}") for n in ("source", "lang")]
    marked = marked.select("row", draw(F.col("doc_id"), seed).alias("drawn"), *values, _named(topic_of(F.col("text")), targets.get("topic")).alias("cell_topic"), token_count(F.col("text")).alias("n_tokens"))
    marked = common.written(marked, "marked")  # texts are read once
    cells = marked.groupBy(*[F.col(f"cell_{n}").alias(n) for n in DIMENSIONS]).agg(F.sum("n_tokens").alias("tokens"))
    shares = rake(cells, targets, keep_other=keep_other, most_copies=most_copies).select(*[F.col(n).alias(f"cell_{n}") for n in DIMENSIONS], "expected")
    drawn = marked.join(_small(shares), [f"cell_{n}" for n in DIMENSIONS]).withColumn("copies", copies(F.col("expected"), F.col("drawn")))
    return drawn.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
