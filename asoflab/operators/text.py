"""News, comments and multi-source records: linking, typing, canonical records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asoflab.functions.columns import close_enough
from asoflab.operators.pit import latest_revision


def entity_links(docs: DataFrame, aliases: DataFrame, pattern: str = "[a-z]{6,}") -> DataFrame:
    """(doc_id, symbols, verdict): UNIQUE, AMBIGUOUS or NONE by the aliases among a text's words.

    aliases(alias, symbol). Texts are cut into distinct words and met by key: no theta join.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))
    found = docs.select("doc_id", F.explode(words).alias("alias")).join(aliases, "alias").groupBy("doc_id").agg(F.countDistinct("symbol").alias("symbols"))
    out = docs.select("doc_id").join(found, "doc_id", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))
    return out.withColumn("verdict", F.when(F.col("symbols") == 0, "NONE").when(F.col("symbols") == 1, "UNIQUE").otherwise("AMBIGUOUS"))


def suspected_duplicates(events: DataFrame, keys: Sequence[str], hours: int, similar: Column) -> DataFrame:
    """Pairs (id_a, id_b) of events of one key within ``hours`` whose columns ``a`` and ``b`` pass ``similar``.

    Times fall into buckets of that width; each row meets its own bucket and the one before: an equi join.
    """
    width = hours * 3600
    base = events.withColumn("_t", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("_b", F.floor(F.col("_t") / width))
    a = base.select(*keys, F.col("event_id").alias("id_a"), F.col("_t").alias("ta"), F.col("value").alias("a"), F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b"))
    b = base.select(*keys, F.col("event_id").alias("id_b"), F.col("_t").alias("tb"), F.col("value").alias("b"), "_b")
    near = (F.abs(F.col("ta") - F.col("tb")) <= width) & ((F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("id_a") < F.col("id_b"))))
    return a.join(b, [*keys, "_b"]).where(near & similar).select("id_a", "id_b").distinct()


def canonical_records(rows: DataFrame, keys: Sequence[str], priority: Sequence[str], field: str, tolerance: float) -> DataFrame:
    """One row for each key: the best source's value, its verdict against the others and a confidence.

    rows(keys, source, stamp, <field>): the newest row of each source counts.
    """
    newest = latest_revision(rows, [*keys, "source"], [F.desc("stamp"), F.desc(field)])
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    place = F.when(rank == 0, F.lit(len(priority) + 1)).otherwise(rank)
    best = Window.partitionBy(*keys).orderBy("_rank", "source")
    with_primary = newest.withColumn("_rank", place).withColumn("_primary", F.first(field).over(best)).withColumn("_source", F.first("source").over(best))
    agree = close_enough(field, "_primary", 0.0, tolerance)
    out = with_primary.groupBy(*keys).agg(F.first("_primary").alias(field), F.first("_source").alias("primary_source"), F.count("*").alias("sources"), F.count_if(agree).alias("agreeing"))
    verdict = F.when(F.col("sources") == 1, "SINGLE_SOURCE").when(F.col("agreeing") == F.col("sources"), "VERIFIED").otherwise("CONFLICT")
    confidence = F.when(F.col("sources") == 1, 0.7).when(F.col("agreeing") == F.col("sources"), F.least(F.lit(1.0), F.lit(0.85) + F.col("sources") * 0.05)).otherwise(0.4)
    return out.withColumn("verdict", verdict).withColumn("confidence", confidence)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule (name, literal) whose literal the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(mark)), F.lit(name)) for name, mark in rules], F.lit(otherwise))


def evidence(text: Column, mark: str, before: int = 20, after: int = 40) -> Column:
    """The text around the first place of a literal, NULL if it isn't there."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(before + after)))
