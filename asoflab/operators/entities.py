"""Links of texts to symbols: the source's own symbol, codes in the text, names of several words; each text gets one audited answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between the words of names and texts.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def name_words(text: Column) -> Column:
    """Words of a text, lower-cased: runs of ASCII letters and digits or of characters beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def name_dictionary(aliases: DataFrame, least: int = 4) -> DataFrame:
    """(first, name, size, kind, symbol) of aliases(alias, kind, symbol): names by their first word; short names of fewer than ``least`` letters are left out."""
    own = aliases.select(name_words(F.col("alias")).alias("name"), "kind", "symbol").where(F.size("name") > 0)
    own = own.where((F.col("kind") == "FULL_NAME") | (F.length(F.array_join("name", "")) >= least))
    return own.select(F.col("name")[0].alias("first"), "name", F.size("name").alias("size"), "kind", "symbol").distinct()


def name_matches(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, place, name, kind, symbol): at each word of docs(doc_id, words) the longest name that begins there, for each symbol that bears it.

    Words meet the dictionary by a name's first word and carry as many words as the longest name has; the rest is compared in
    the row. A frequent first word is split by adaptive execution, as the dictionary's side has few rows for it.
    """
    longest = dictionary.agg(F.coalesce(F.max("size"), F.lit(1)).alias("n")).first()["n"]  # one number
    places = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.struct(i.alias("place"), F.slice("words", i, longest).alias("ahead")))
    at = docs.where(F.size("words") > 0).select("doc_id", F.explode(places).alias("p")).select("doc_id", "p.place", "p.ahead", F.col("p.ahead")[0].alias("first"))
    met = at.join(dictionary, "first").where(F.slice("ahead", F.lit(1), F.col("size")) == F.col("name"))
    best = F.max("size").over(Window.partitionBy("doc_id", "place"))
    return met.withColumn("_best", best).where("size = _best").select("doc_id", F.col("place").cast("long").alias("place"), "name", "kind", "symbol")


def entity_audit(docs: DataFrame, universe: DataFrame, aliases: DataFrame, code: str = r"(?<![0-9])[0-9]{4}(?![0-9])", version: str = "names-1") -> DataFrame:
    """One row for each document of docs(doc_id, text, payload_symbol): symbol, link_type, matched, confidence, rule, status and audit_id.

    The first that holds: the payload's symbol if the universe(symbol, code) has it (1.0); the one symbol whose code the text
    holds (0.99), or AMBIGUOUS_CODES; the one symbol whose names it holds, by full name (0.98) or short name (0.90) of
    aliases(alias, kind, symbol), or AMBIGUOUS_ALIAS; else none. Only documents without a better answer are asked for the next one.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("payload_symbol").alias("symbol"))
    told = own.join(universe.select("symbol", F.lit(True).alias("listed")), "symbol", "left")
    sourced = told.where("listed").select("doc_id", F.array("symbol").alias("symbols"), F.col("symbol").cast("string").alias("matched"), F.lit(1).alias("tier"), F.lit(1.0).alias("sure"))
    open_ = told.where("listed IS NULL").select("doc_id", "text")
    codes = open_.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(code), F.lit(0)))).alias("code")).join(universe, "code")
    by_code = codes.groupBy("doc_id").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("matched"))
    by_code = by_code.select("doc_id", "symbols", "matched", F.lit(2).alias("tier"), F.lit(0.99).alias("sure"))
    unnamed = open_.join(by_code.select("doc_id"), "doc_id", "left_anti").select("doc_id", name_words(F.col("text")).alias("words"))
    names = name_matches(unnamed, name_dictionary(aliases))
    full = F.col("kind") == "FULL_NAME"
    order = F.struct(F.when(full, 0).otherwise(1), "place", F.array_join("name", " "))
    by_name = names.groupBy("doc_id").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.min_by(F.array_join("name", " "), order).alias("matched"), F.max(F.when(full, 0.98).otherwise(0.9)).alias("sure"))
    by_name = by_name.select("doc_id", "symbols", "matched", F.lit(3).alias("tier"), "sure")
    found = docs.select("doc_id").join(sourced.unionByName(by_code).unionByName(by_name), "doc_id", "left")
    one, none = F.size("symbols") == 1, F.col("tier").isNull()
    kind = F.when(none, "NO_RELIABLE_MATCH").when(~one, F.when(F.col("tier") == 2, "AMBIGUOUS_CODES").otherwise("AMBIGUOUS_ALIAS"))
    kind = F.coalesce(kind, F.when(F.col("tier") == 1, "SOURCE_SYMBOL").when(F.col("tier") == 2, "TEXT_SYMBOL").when(F.col("sure") > 0.95, "FULL_NAME").otherwise("SHORT_NAME"))
    rule = F.when(none, "NO_RULE_MATCH").when(~one, F.when(F.col("tier") == 2, "MULTIPLE_EXPLICIT_CODES").otherwise("ALIAS_COLLISION"))
    rule = F.coalesce(rule, F.when(F.col("tier") == 1, "SOURCE_PAYLOAD_SYMBOL").when(F.col("tier") == 2, "EXPLICIT_TEXT_CODE").when(F.col("sure") > 0.95, "EXACT_FULL_NAME").otherwise("VALID_ALIAS_EXACT"))
    status = F.when(none, "UNLINKED").when(one, "LINKED").otherwise("UNLINKED_AMBIGUOUS")
    symbol = F.when(one, F.get("symbols", F.lit(0)))
    out = found.select("doc_id", symbol.alias("symbol"), kind.alias("link_type"), F.when(one, F.col("matched")).alias("matched"), F.when(one, F.col("sure")).otherwise(0.0).alias("confidence"), rule.alias("rule"), status.alias("status"), F.coalesce(F.size("symbols"), F.lit(0)).alias("candidates"))
    key = F.concat_ws("|", F.lit(version), F.col("doc_id").cast("string"), F.coalesce(F.col("symbol").cast("string"), F.lit("")), "rule")
    return out.withColumn("audit_id", F.concat(F.lit("link_"), F.substring(F.sha2(key, 256), 1, 32)))
