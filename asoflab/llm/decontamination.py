"""Benchmark decontamination over a positional inverted index.

Words are those of the license scan: runs of ASCII letters and digits or of characters
beyond ASCII, lower-cased by ASCII rules. Documents are numbered and their words stored
(``forward``). ``index`` stores the postings (term, row, position) of the training text, a
shard for each task's documents, sorted by term within it, so nothing is shuffled to build
it. Its counts say how rare each test term is.

Exact phrases (``phrases``): a window is ``size`` consecutive words of a test item, or all
words of a shorter item. Of each window the ``rarest`` places with the rarest terms are its
anchors. Postings of an anchor's term, less the anchor's place in the item, are where the
item would have to begin in the document. These offset-adjusted lists meet in one
aggregation by (row, item, beginning); a window stays where all its anchors met, and is then
compared word by word with the stored words. Windows of an item share anchors, so a posting
meets an anchor once and not once for each window. A window with a term that no document
holds is dropped at once.

Proximity (``near``): all distinct words of a window stand within ``span`` consecutive words
of a document, in any order. Postings of the window's rarest terms meet by blocks of
``span`` words, never pair by pair, and what meets is compared with the stored words.

All of it is DataFrame expressions. Test terms, anchors and items are broadcast while they
are counted to be few, and joined by shuffle beyond that; a frequent term's postings stay in
the shards of their documents, so no task gets them together.

Null and empty texts have no words and hit nothing; an item without words has no window.
Rows of a repeated doc_id are told one by one. Items of a repeated item_id count once; words of
an item without an id are hit, but it is not counted or named. Empty tables give empty or
unhit results. Only doc_id, item_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .licenses import words

#: Tables of up to so many rows are broadcast.
FEW = 500_000


@dataclass
class Index:
    """Stored tables: forward(row, doc_id, n_words, words), postings(term_id, row, pos), terms(term, term_id, n)."""

    forward: DataFrame
    postings: DataFrame
    terms: DataFrame


def sized(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it was counted to be small."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def stored_words(docs: DataFrame) -> DataFrame:
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("words"))
    return common.written(own.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"), "forward")


def test_items(items: DataFrame) -> DataFrame:
    """(item, item_id, words) of items with words."""
    own = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words"))
    return common.written(own.where(F.size("words") > 0), "items")


def index(docs: DataFrame, items: DataFrame | None = None) -> Index:
    """Postings of all terms of docs(doc_id, text), or of those that items (as ``test_items`` tells) hold."""
    forward = stored_words(docs)
    held = (forward if items is None else items).select(F.explode("words").alias("term")).distinct()
    named = common.written(held.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    places = forward.select("row", F.posexplode("words").alias("pos", "term"))
    postings = places.join(sized(named), "term").select("term_id", "row", "pos").sortWithinPartitions("term_id")
    postings = common.written(postings, "postings")
    counts = postings.groupBy("term_id").agg(F.count("*").alias("n"))
    terms = common.written(named.join(counts, "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    return Index(forward, postings, terms)


def _first(several: Column, k: int) -> Column:
    return F.slice(F.array_sort(several), 1, k)


def _windows(items: DataFrame, own: Index, size: int, rarest: int, distinct: bool) -> DataFrame:
    """(item, item_id, words, windows) with the windows (start, anchors) of each item whose terms are all in the index.

    anchors: the rarest (n, at, term_id), one for each term if distinct.
    """
    terms = items.select("item", F.posexplode("words").alias("at", "term")).join(sized(own.terms), "term")
    ranked = terms.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "n", "term_id"))).alias("ranked"))
    width = F.least(F.lit(size), F.size("words"))
    each = F.transform("ranked", lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term_id"].alias("term_id")))

    def anchors(start: Column) -> Column:
        window = F.slice("each", start + 1, width)
        if distinct:  # a term's first place in the window
            ids = F.transform(window, lambda x: x["term_id"])
            window = F.filter(window, lambda x: F.array_position(ids, x["term_id"]) == x["at"] - start + 1)
        return F.struct(start.alias("start"), _first(window, rarest).alias("anchors"))

    starts = F.sequence(F.lit(0), F.size("words") - width)
    told = items.join(ranked, "item").withColumn("each", each).withColumn("windows", F.transform(starts, anchors))
    told = told.withColumn("windows", F.filter("windows", lambda w: F.get(w["anchors"], F.lit(0))["n"] > 0)).where(F.size("windows") > 0)
    return common.written(told.select("item", "item_id", "words", width.alias("width"), "windows"), "windows")


def _least(windows: DataFrame) -> Column:
    """Anchors of an item's windows, at least."""
    return F.array_min(F.transform("windows", lambda w: F.size(w["anchors"]))).alias("least")


def _anchors(windows: DataFrame, *columns: str) -> DataFrame:
    every = windows.select("item", "width", _least(windows), F.explode("windows").alias("w")).select("item", "least", F.explode("w.anchors").alias("x"))
    return sized(common.written(every.select("item", "least", *[f"x.{c}" for c in columns]).distinct(), "anchors"))


def phrases(own: Index, items: DataFrame, size: int = 10, rarest: int = 2) -> DataFrame:
    """(row, item, item_id, start, width) of every place where a window of items stands in a document."""
    windows = _windows(items, own, size, rarest, distinct=False)
    lists = own.postings.join(_anchors(windows, "at", "term_id"), "term_id").select("row", "item", (F.col("pos") - F.col("at")).alias("begin"), "at", "least")
    met = lists.groupBy("row", "item", "begin").agg(F.collect_set("at").alias("met"), F.first("least").alias("least")).where("size(met) >= least")
    full = lambda w: F.size(F.array_except(F.transform(w["anchors"], lambda x: x["at"]), F.col("met"))) == 0
    possible = met.join(sized(windows), "item").withColumn("starts", F.transform(F.filter("windows", full), lambda w: w["start"])).where("size(starts) > 0")
    possible = common.written(possible.select("row", "item", "item_id", "begin", "width", "starts", F.col("words").alias("wanted")), "candidates")
    here = lambda s: (F.col("begin") + s >= 0) & (F.slice("words", F.greatest(F.col("begin") + s, F.lit(0)) + 1, F.col("width")) == F.slice("wanted", s + 1, F.col("width")))
    found = own.forward.select("row", "words").join(sized(possible), "row").select("row", "item", "item_id", "begin", "width", F.explode(F.filter("starts", here)).alias("s"))
    return found.select("row", "item", "item_id", (F.col("begin") + F.col("s")).alias("start"), "width")


def near(own: Index, items: DataFrame, size: int = 10, span: int = 20, rarest: int = 2) -> DataFrame:
    """(row, item, item_id, windows) of every document and item of which windows have all their words within span consecutive words; windows: their starts in the item."""
    windows = _windows(items, own, size, rarest, distinct=True)
    lists = own.postings.join(_anchors(windows, "term_id"), "term_id")
    block = F.floor(F.col("pos") / span).cast("int")
    # words that stand within span words from a place in a block are in that block or the next
    lists = lists.select("row", "item", "term_id", "least", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0")
    met = lists.groupBy("row", "item", "block").agg(F.collect_set("term_id").alias("met"), F.first("least").alias("least")).where("size(met) >= least")
    full = lambda w: F.size(F.array_except(F.transform(w["anchors"], lambda x: x["term_id"]), F.col("met"))) == 0
    possible = met.join(sized(windows), "item").withColumn("starts", F.transform(F.filter("windows", full), lambda w: w["start"])).where("size(starts) > 0")
    possible = common.written(possible.select("row", "item", "item_id", "block", "width", "starts", F.col("words").alias("wanted")), "near-candidates")
    first = F.col("block") * span
    text = own.forward.select("row", "words").join(sized(possible), "row").withColumn("region", F.slice("words", first + 1, 2 * span))

    def together(s: Column) -> Column:
        wanted = F.array_distinct(F.slice("wanted", s + 1, F.col("width")))
        stands = lambda i: F.size(F.array_except(wanted, F.slice("region", i + 1, span))) == 0
        return (F.size(F.array_except(wanted, "region")) == 0) & F.exists(F.sequence(F.lit(0), F.lit(span - 1)), stands)

    found = text.select("row", "item", "item_id", F.explode(F.filter("starts", together)).alias("start"))
    return found.groupBy("row", "item").agg(F.first("item_id").alias("item_id"), F.array_sort(F.collect_set("start")).alias("windows"))


def _covered(spans: Column) -> Column:
    """Words that the sorted (start, end) cover."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"))
    return F.aggregate(spans, begin, add)["n"]


def scan(docs: DataFrame, items: DataFrame, size: int = 10, span: int = 20, rarest: int = 2) -> DataFrame:
    """One row for each row of docs: words, words hit by windows of items, the items with such windows, and near items besides them."""
    tests = test_items(items)
    own = index(docs, tests)
    places = phrases(own, tests, size, rarest).select("row", "item_id", F.struct("start", (F.col("start") + F.col("width")).alias("end")).alias("span"))
    hits = places.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    close = near(own, tests, size, span, rarest).groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
    rows = own.forward.select("row", "doc_id", "n_words").join(hits, "row", "left").join(close, "row", "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
