"""Queries of entity links by names of several words, and of the audit behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asoflab.operators import entities as N
from asoflab.plans.registry import query
from asoflab.sources import views as V

_SPLIT = "list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Companies are the benchmark's items: their full names are their texts' first four words, their short names the next two.
NAMES_SQL = f"""WITH items AS (SELECT item_id AS symbol, {_SPLIT} AS w FROM benchmark), universe AS (SELECT symbol, lpad((1000 + symbol)::VARCHAR, 4, '0') AS code FROM items),
named AS (SELECT symbol, 'FULL_NAME' AS kind, w[1:4] AS name FROM items UNION ALL SELECT symbol, 'SHORT_NAME', w[5:6] FROM items),
dictionary AS (SELECT DISTINCT symbol, kind, name, name[1] AS first FROM named WHERE len(name) > 0 AND (kind = 'FULL_NAME' OR length(array_to_string(name, '')) >= 4)),
docs AS (SELECT doc_id, coalesce(text, '') AS text, n_chars % 997 AS payload_symbol FROM documents)"""

_MATCHES = """matched AS (SELECT doc_id, p AS place, name, kind, symbol FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS first FROM (SELECT doc_id, {split} AS w FROM {docs})) JOIN dictionary USING (first)
  WHERE w[p : p + len(name) - 1] = name QUALIFY len(name) = max(len(name)) OVER (PARTITION BY doc_id, p))"""


def companies(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with the symbol that their source gives, the universe with codes, and names."""
    items = V.read(spark, sf, "benchmark").select(F.col("item_id").alias("symbol"), N.name_words(F.col("text")).alias("w"))
    names = [items.select(F.array_join(F.slice("w", a, n), " ").alias("alias"), F.lit(k).alias("kind"), "symbol") for k, a, n in (("FULL_NAME", 1, 4), ("SHORT_NAME", 5, 2))]
    docs = V.read(spark, sf, "documents").select("doc_id", "text", (F.col("n_chars") % 997).alias("payload_symbol"))
    return docs, items.select("symbol", F.lpad((F.col("symbol") + 1000).cast("string"), 4, "0").alias("code")), names[0].unionByName(names[1])


@query("DOM_33_name_matches", f"{NAMES_SQL}, {_MATCHES.format(split=_SPLIT, docs='docs')} SELECT doc_id, place, array_to_string(name, ' ') AS name, kind, symbol FROM matched")
def name_matches(spark, sf):
    docs, _, aliases = companies(spark, sf)
    found = N.name_matches(docs.select("doc_id", N.name_words(F.col("text")).alias("words")), N.name_dictionary(aliases))
    return found.withColumn("name", F.array_join("name", " "))


@query("DOM_33_entity_audit", f"""{NAMES_SQL}, sourced AS (SELECT doc_id, symbol FROM docs JOIN universe ON symbol = payload_symbol), coded AS (SELECT DISTINCT doc_id, code, symbol FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS code FROM docs ANTI JOIN sourced USING (doc_id)) JOIN universe USING (code)),
left_over AS (SELECT doc_id, text FROM docs ANTI JOIN sourced USING (doc_id) ANTI JOIN coded USING (doc_id)), {_MATCHES.format(split=_SPLIT, docs='left_over')},
by_code AS (SELECT doc_id, count(DISTINCT symbol) AS n, min(symbol) AS symbol, string_agg(code, ',' ORDER BY code) AS matched FROM coded GROUP BY 1),
by_name AS (SELECT doc_id, count(DISTINCT symbol) AS n, min(symbol) AS symbol, arg_min(array_to_string(name, ' '), (CASE kind WHEN 'FULL_NAME' THEN 0 ELSE 1 END, place, array_to_string(name, ' '))) AS matched, max(CASE kind WHEN 'FULL_NAME' THEN 0.98 ELSE 0.9 END)::DOUBLE AS sure FROM matched GROUP BY 1),
tiers AS (SELECT doc_id, 1 AS tier, 1 AS n, symbol, symbol::VARCHAR AS matched, 1.0::DOUBLE AS sure FROM sourced UNION ALL SELECT doc_id, 2, n, symbol, matched, 0.99 FROM by_code UNION ALL SELECT doc_id, 3, n, symbol, matched, sure FROM by_name),
audit AS (SELECT doc_id, CASE WHEN n = 1 THEN symbol END AS symbol, CASE WHEN tier IS NULL THEN 'NO_RELIABLE_MATCH' WHEN n > 1 THEN CASE tier WHEN 2 THEN 'AMBIGUOUS_CODES' ELSE 'AMBIGUOUS_ALIAS' END WHEN tier = 1 THEN 'SOURCE_SYMBOL' WHEN tier = 2 THEN 'TEXT_SYMBOL' WHEN sure > 0.95 THEN 'FULL_NAME' ELSE 'SHORT_NAME' END AS link_type, CASE WHEN n = 1 THEN matched END AS matched, CASE WHEN n = 1 THEN sure ELSE 0 END AS confidence,
  CASE WHEN tier IS NULL THEN 'NO_RULE_MATCH' WHEN n > 1 THEN CASE tier WHEN 2 THEN 'MULTIPLE_EXPLICIT_CODES' ELSE 'ALIAS_COLLISION' END WHEN tier = 1 THEN 'SOURCE_PAYLOAD_SYMBOL' WHEN tier = 2 THEN 'EXPLICIT_TEXT_CODE' WHEN sure > 0.95 THEN 'EXACT_FULL_NAME' ELSE 'VALID_ALIAS_EXACT' END AS rule, CASE WHEN tier IS NULL THEN 'UNLINKED' WHEN n = 1 THEN 'LINKED' ELSE 'UNLINKED_AMBIGUOUS' END AS status, coalesce(n, 0) AS candidates FROM docs LEFT JOIN tiers USING (doc_id))
SELECT *, 'link_' || substr(sha256('names-1|' || doc_id || '|' || coalesce(symbol::VARCHAR, '') || '|' || rule), 1, 32) AS audit_id FROM audit""")
def entity_audit(spark, sf):
    return N.entity_audit(*companies(spark, sf))
