"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, embedding_dedup, licenses, mixing, ngram_join, piece_sampling, prefix_trie, quality, resampling, secrets, token_file, top_k, toxicity

#: What sources, languages and topics should hold of all tokens.
TARGETS = {
    "source": None,
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.7, "table": 0.1, "mail": 0.1, "link": 0.05, "code": 0.05},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = common.crc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.where(~held_out), labels.where(~held_out))
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = common.crc_remainder(F.col("doc_id"), 4) == 2
    model = quality.train(docs.where(~held_out), labels.where(~held_out))
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.new_path(spark)
    token_file.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return token_file.read_digests(spark, path)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), TARGETS, keep_other=True).withColumns({c: F.round(c, 9) for c in ("weight", "probability", "drawn")})


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_components(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _mixing_sql() -> str:
    """The raking with one common table expression for each step."""
    tokens = "regexp_replace(coalesce(text, ''), '[\\x09-\\x0D\\x20]+', ' ', 'g')"
    topic = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{m}') THEN '{n}'" for n, m in mixing.TOPICS) + " ELSE 'prose' END"
    named = {"source": "coalesce(source, 'other')", "lang": "CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END", "topic": topic}
    share = lambda name: "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in TARGETS[name].items()) + " ELSE 0 END"
    steps = [
        f"docs AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in named.items())}, CASE WHEN trim({tokens}) = '' THEN 0 ELSE length(trim({tokens})) - length(replace(trim({tokens}), ' ', '')) + 1 END AS n_tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
        "want_source AS (SELECT source, 1.0::DOUBLE / count(*) OVER () AS want FROM (SELECT DISTINCT source FROM cells))",
        *[f"""want_{n} AS (SELECT {n}, CASE WHEN {n} = 'other' THEN o ELSE ({share(n)})::DOUBLE / sum({share(n)}) OVER () * (1 - o) END AS want
  FROM (SELECT DISTINCT {n} FROM cells), (SELECT coalesce(sum(tokens) FILTER ({n} = 'other'), 0) / sum(tokens) AS o FROM cells))""" for n in ("lang", "topic")],
        "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells)",
    ]
    k = 0
    for _ in range(mixing.SWEEPS):
        for name in mixing.DIMENSIONS:
            steps.append(f"w{k + 1} AS (SELECT source, lang, topic, tokens, coalesce(weight * want / nullif(sum(weight) OVER (PARTITION BY {name}), 0), 0) AS weight FROM w{k} JOIN want_{name} USING ({name}))")
            k += 1
    steps += [
        f"shares AS (SELECT *, weight / sum(weight) OVER () AS share FROM w{k})",
        "needs AS (SELECT *, coalesce(share / nullif(tokens, 0), 0) AS need FROM shares)",
        f"final AS (SELECT source, lang, topic, share AS weight, need * sum(tokens) OVER () * {mixing.KEEP} AS expected FROM needs)",
        "drawn AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS drawn FROM docs)",
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(least(1.0, expected), 9) AS probability, round(drawn, 9) AS drawn, drawn < least(1.0, expected) AS kept, floor(expected)::BIGINT + (drawn < expected - floor(expected))::BIGINT AS copies FROM drawn JOIN final USING (source, lang, topic)"


def _licenses_sql(containment: float = 0.8, slack: int = 4) -> str:
    """Every window of every text against every template."""
    literal = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    places = [f"list_filter(range(0, len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {literal(p.split())})" for p in licenses.PHRASES]
    best, blocks = [], []
    for t in licenses.TEMPLATES:
        d = sorted(set(t.split()))
        need, width = ceil(containment * len(d) - 1e-9), len(t.split()) + slack
        each = f"list_transform(range(0, len(w)), lambda s: len(list_intersect(w[s + 1 : s + {width}], {literal(d)})))"
        top = f"list_max({each})"
        blocks.append(f"CASE WHEN len(list_intersect(w, {literal(d)})) >= {need} THEN len(list_filter({each}, lambda x: x >= {need})) ELSE 0 END")
        best.append(f"CASE WHEN len(list_intersect(w, {literal(d)})) >= {need} THEN CASE WHEN {top} >= {need} THEN {top} / {len(d)}.0::DOUBLE ELSE 0 END ELSE 0 END")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{v}' END" for k, v in enumerate(licenses.PHRASES.values())) + "], lambda x: x IS NOT NULL)"
    more = "list_filter([" + ", ".join(f"CASE WHEN c[{k + 1}] > 0 THEN '{v}' END" for k, v in enumerate(licenses.TEMPLATES.values())) + "], lambda x: x IS NOT NULL)"
    return f"""WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, {', '.join(f'{p} AS p{k}' for k, p in enumerate(places))}, [{', '.join(best)}] AS c, {' + '.join(blocks)} AS n_blocks FROM words),
starts AS (SELECT *, list_concat({', '.join(f'p{k}' for k in range(len(places)))}) AS s, {base} AS b, {more} AS m FROM found)
SELECT doc_id, n_words, len(s) AS n_base, list_min(s) AS first_word, list_max(s) AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') AS labels, CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE list_max(c)::DOUBLE END AS score, n_blocks FROM starts"""


_JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS g FROM words
), sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY 1), shared AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (SELECT k AS a, k AS b FROM words UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words d LEFT JOIN sizes USING (k) JOIN (SELECT a, min(doc_id) AS component_id FROM reached JOIN words ON k = b GROUP BY 1) c ON c.a = d.k
"""

_TOP_K_SQL = """
WITH points AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.k AS k, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM points q JOIN points c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_NEAR_SQL = """
WITH RECURSIVE points AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM points a JOIN points b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON c.a = e.vec_id
"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: Every window at every place; near ones are looked for around the window's rarest word.
_DECONTAMINATION_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, len(g) AS size, g FROM (SELECT item_id, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda s: w[s + 1 : s + 10])) AS g FROM items WHERE len(w) > 0)),
words AS MATERIALIZED (SELECT k, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM docs),
grams AS (SELECT k, z.s AS s, size, z.g AS g FROM (SELECT k, size, unnest(list_transform(range(0, len(w) - size + 1), lambda s: {{'s': s, 'g': array_to_string(w[s + 1 : s + size], ' ')}})) AS z FROM docs, (SELECT DISTINCT size FROM windows))),
found AS (SELECT DISTINCT k, s, grams.size, item_id FROM grams JOIN windows ON grams.g = array_to_string(windows.g, ' ')),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS p FROM found) GROUP BY k),
named AS (SELECT k, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY k),
counts AS (SELECT t, count(*) AS n FROM words GROUP BY t),
rare AS MATERIALIZED (SELECT item_id, g, list_distinct(g) AS need, arg_min(t, n) AS t FROM (SELECT item_id, g, t, coalesce(n, 0) AS n FROM (SELECT item_id, g, unnest(list_distinct(g)) AS t FROM windows) LEFT JOIN counts USING (t)) GROUP BY item_id, g),
places AS MATERIALIZED (SELECT k, t, w[greatest(p - 19, 0) + 1 : p + 20] AS region FROM words JOIN docs USING (k) WHERE t IN (SELECT t FROM rare)),
close AS (SELECT k, count(DISTINCT item_id) AS n_near FROM places JOIN rare USING (t) WHERE list_has_all(region, need) AND len(list_filter(range(0, 20), lambda s: list_has_all(region[s + 1 : s + 20], need))) > 0 GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k) LEFT JOIN close USING (k)
"""


#: The table of CRC-32 by byte, and the unsigned CRC-32 of a list of bytes by it.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS steps)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda a, b: xor(steps[(xor(a, b) & 255) + 1], a >> 8)))"

#: Every prefix as a list of turns; subtrees by comparing prefixes.
_TRIE_SQL = f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, sha256(strlen(t.role)::VARCHAR || ':' || t.role || t.text)) AS w FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, w, {_CRC.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")} % 9 AS h FROM own, crc),
convs AS (SELECT o.conv_id, list_concat(coalesce(b.w, [])[1 : o.h], o.w[o.h + 1 :]) AS w FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
paths AS (SELECT conv_id, len(w) AS length, d, w[1 : d] AS p FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM convs)),
nodes AS MATERIALIZED (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN length = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM paths GROUP BY p, d),
children AS (SELECT p[1 : depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
weighed AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(strlen(p[-1].text), 0) AS saved FROM nodes n LEFT JOIN children USING (p)),
sums AS (SELECT a.p, sum(b.saved)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves FROM weighed a JOIN weighed b ON b.depth >= a.depth AND b.p[1 : a.depth] = a.p GROUP BY a.p)
SELECT w.conv_id, w.depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM weighed w JOIN sums USING (p) LEFT JOIN nodes u ON w.depth > 0 AND u.p = w.p[1 : w.depth - 1]
"""


_RESAMPLING_SQL = f"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
source_words AS MATERIALIZED (SELECT doc_id, unnest(w) AS g FROM docs),
target_words AS (SELECT unnest({_WORDS}) AS g FROM benchmark),
features AS (SELECT g, sum(s) AS s, sum(t) AS t FROM (SELECT g, 1 AS s, 0 AS t FROM source_words UNION ALL SELECT g, 0, 1 FROM target_words) GROUP BY g),
hashed AS MATERIALIZED (SELECT g, s, t, {_CRC.format(bytes="list_transform(range(0, strlen(g)), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT)")} % 10000 AS bucket FROM features, crc),
held AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM held),
gains AS (SELECT bucket, floor(1000 * ln((t + 1.0)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1.0)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM held, sums),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM source_words JOIN hashed USING (g) JOIN gains USING (bucket) GROUP BY doc_id),
noise AS (SELECT doc_id, len(w) AS n_features, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS noise FROM docs),
scored AS (SELECT doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + noise AS score FROM noise LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_ngram_jaccard, op3_piece_sampling, op4_top_k, op5_quality, op6_token_file, op7_mixing, op8_licenses, op9_embedding_dedup, op10_secrets, op11_decontamination, op12_prefix_trie, op13_resampling)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": _JACCARD_SQL, "op4_top_k": _TOP_K_SQL, "op7_mixing": _mixing_sql(), "op8_licenses": _licenses_sql(), "op9_embedding_dedup": _NEAR_SQL, "op11_decontamination": _DECONTAMINATION_SQL, "op12_prefix_trie": _TRIE_SQL, "op13_resampling": _RESAMPLING_SQL}
