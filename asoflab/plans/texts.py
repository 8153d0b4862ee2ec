"""Queries of texts, multi-source records, composites and decision tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from asoflab.functions import columns as C
from asoflab.operators import evaluate as E
from asoflab.operators import news as N
from asoflab.operators import pit
from asoflab.operators import text as X
from asoflab.operators import timeseries as T
from asoflab.plans.features import A, B, BY, PATH, RETS, r, rets
from asoflab.plans.registry import query
from asoflab.sources import shared
from asoflab.sources import views as V


@query("JOIN_11_DOM_33_entity_links", r"""WITH al AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS alias, item_id % 10 AS symbol FROM benchmark), w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS alias FROM documents),
f AS (SELECT doc_id, count(DISTINCT symbol) AS symbols FROM w JOIN al USING (alias) GROUP BY 1) SELECT d.doc_id, coalesce(symbols, 0) AS symbols, CASE WHEN coalesce(symbols, 0) = 0 THEN 'NONE' WHEN symbols = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS verdict FROM documents d LEFT JOIN f USING (doc_id)""")
def entity_links(spark, sf):
    aliases = V.read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("alias"), (F.col("item_id") % 10).alias("symbol")).distinct()
    return X.entity_links(V.read(spark, sf, "documents"), aliases)


@query("JOIN_13_suspected_duplicates", """SELECT a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 48 * 3600 AND (floor(epoch(a.ts)) < floor(epoch(b.ts)) OR (floor(epoch(a.ts)) = floor(epoch(b.ts)) AND a.event_id < b.event_id)) WHERE least(a.value, b.value) >= 0.82 * greatest(a.value, b.value)""")
def suspected_duplicates(spark, sf):
    return X.suspected_duplicates(V.read(spark, sf, "events"), ["user_id", "event_type"], 48, F.least("a", "b") >= F.greatest("a", "b") * 0.82)


@query("DOM_31_canonical_records", """WITH x AS (SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS source, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS stamp, l_extendedprice / l_quantity AS price FROM lineitem),
n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, month, source ORDER BY stamp DESC, price DESC) = 1), p AS (SELECT *, first(price) OVER w AS pp, first(source) OVER w AS ps FROM n WINDOW w AS (PARTITION BY symbol, month ORDER BY CASE source WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)),
g AS (SELECT symbol, month, round(any_value(pp), 6) AS price, any_value(ps) AS primary_source, count(*) AS sources, count(*) FILTER (WHERE abs(price - pp) <= 0.2 * greatest(abs(price), abs(pp))) AS agreeing FROM p GROUP BY 1, 2)
SELECT symbol, month, price, primary_source, sources, CASE WHEN sources = 1 THEN 'SINGLE_SOURCE' WHEN agreeing = sources THEN 'VERIFIED' ELSE 'CONFLICT' END AS verdict, round(CASE WHEN sources = 1 THEN 0.7 WHEN agreeing = sources THEN least(1, 0.85 + 0.05 * sources) ELSE 0.4 END, 4)::DOUBLE AS confidence FROM g""")
def canonical_records(spark, sf):
    rows = V.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), F.col("l_returnflag").alias("source"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("stamp"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    c = X.canonical_records(rows, ["symbol", "month"], ["A", "N", "R"], "price", 0.2)
    return c.select("symbol", "month", F.round("price", 6).alias("price"), "primary_source", "sources", "verdict", F.round("confidence", 4).alias("confidence"))


#: Keywords of the test prose, in order, for the parameters of news.extracted.
ENTITIES = {"eau": "RIVER", "the": "BANK", "der": "TREASURY", "la": "COUNCIL", "en": "PARLIAMENT"}
OPERATIONS = ("with", "and", "une", "que", "sch")
UNITS = {"%": "%", "bp": "bp", "": "n"}


def records(spark, sf):
    """A document as a report: the first line is its title, time and symbols are those of the event of its number."""
    e = V.read(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts", "user_id")
    none = F.array().cast("array<bigint>")
    symbols = F.when(F.col("user_id") % 5 == 0, none).otherwise(F.array(F.col("user_id") % 3, F.col("user_id") % 4 + 10))
    d = V.read(spark, sf, "documents").select("doc_id", F.col("lang").alias("type"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.md5(F.col("text").cast("binary")).alias("content_hash"), (F.substring("source", 4, 9).cast("int") % 3).alias("level"))
    # whole texts stay where they are read
    return d.join(e, "doc_id", "left").select(F.col("doc_id").alias("id"), "type", "ts", "title", "content_hash", F.coalesce(symbols, none).alias("symbols"), "level")


RECORDS = r"""r AS (SELECT d.doc_id AS id, lang AS typ, ts, epoch_us(ts) AS t, split_part(text, chr(10), 1) AS raw, regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}_]', '', 'g') AS title, md5(text) AS h,
 coalesce(CASE WHEN user_id % 5 = 0 THEN []::BIGINT[] ELSE [user_id % 3, user_id % 4 + 10] END, []) AS s, substr(source, 4)::INT % 3 AS level FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)"""
CLUSTERS = f"""WITH RECURSIVE {RECORDS}, e AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.typ = b.typ AND a.id <> b.id AND abs(a.t - b.t) <= 86400000000 AND (a.h = b.h OR (a.title = b.title AND (list_has_any(a.s, b.s) OR (len(a.s) = 0 AND len(b.s) = 0))))),
reach AS (SELECT id AS a, id AS b FROM r UNION SELECT x.a, e.b FROM reach x JOIN e ON x.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1)"""


def clustered(spark, sf):
    shared.checkpoint_dir(spark)
    return N.event_clusters(records(spark, sf))


@query("DOM_32_34_clusters", f"{CLUSTERS} SELECT id AS doc_id, cluster FROM c")
def clusters(spark, sf):
    return clustered(spark, sf).withColumnRenamed("id", "doc_id")


@query("DOM_32_cluster_summary", f"""{CLUSTERS}, j AS (SELECT * FROM r JOIN c USING (id)), y AS (SELECT cluster, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS symbols FROM j GROUP BY 1)
SELECT cluster, first(id ORDER BY level, ts, id) AS primary, count(*) AS sources, any_value(symbols) AS symbols, CASE WHEN count(*) > 1 AND min(h) = max(h) THEN 'CONTENT_HASH' ELSE 'NORMALIZED_TITLE_TIME_ENTITY' END AS method FROM j JOIN y USING (cluster) GROUP BY 1""")
def cluster_summary(spark, sf):
    shared.checkpoint_dir(spark)
    reports = shared.written(records(spark, sf), "reports")
    return N.cluster_summary(reports, N.event_clusters(reports)).withColumn("symbols", F.array_join("symbols", ","))


_NUMBERS = " || ".join(rf"list_transform(regexp_extract_all(raw, '([0-9]+(?:\.[0-9]+)?)\s*{u}', 1), lambda x: x::DOUBLE::VARCHAR || '{n}')" for u, n in UNITS.items())
_FACTS = f"""f AS (SELECT *, CAST(ts AS DATE) AS day, CASE {' '.join(f"WHEN contains(raw, '{k}') THEN '{v}'" for k, v in ENTITIES.items())} END AS entity, CASE {' '.join(f"WHEN contains(upper(raw), '{o.upper()}') THEN '{o.upper()}'" for o in OPERATIONS)} END AS op,
 list_distinct({_NUMBERS}) AS amounts, list_distinct(list_transform(range(1, length(title)), lambda i: substr(title, i, 2))) AS g FROM r),
p AS (SELECT a.id AS a, b.id AS b, a.op AS oa, b.op AS ob, a.amounts AS ma, b.amounts AS mb, coalesce(len(list_intersect(a.g, b.g))::DOUBLE / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0) AS sim FROM f a JOIN f b ON a.typ = b.typ AND a.entity = b.entity AND a.id <> b.id AND abs(a.day - b.day) <= 1),
e AS (SELECT a, b FROM p WHERE CASE WHEN len(ma) > 0 AND len(mb) > 0 THEN list_has_any(ma, mb) AND CASE WHEN oa IS NOT NULL AND ob IS NOT NULL THEN oa = ob ELSE (oa IS NULL AND ob IS NULL) OR sim >= 0.6 END WHEN oa IS NOT NULL AND ob IS NOT NULL THEN oa = ob AND sim >= 0.5 ELSE sim >= 0.8 END),
reach AS (SELECT id AS a, id AS b FROM r UNION SELECT x.a, e.b FROM reach x JOIN e ON x.b = e.a)"""


@query("DOM_34_merged_facts", f"""WITH RECURSIVE {RECORDS}, {_FACTS} SELECT a AS id, arg_min(b, (coalesce(day, DATE '9999-12-31'), b)) AS canonical FROM reach JOIN f ON f.id = b GROUP BY 1""")
def merged_facts(spark, sf):
    shared.checkpoint_dir(spark)
    x = records(spark, sf)
    return N.merged_facts(x.select("id", F.to_date("ts").alias("day"), F.col("type").alias("category"), *N.extracted(F.col("title"), ENTITIES, OPERATIONS, UNITS), "title"))


@query("DOM_36_document_types", """SELECT CASE WHEN contains(text, ' | ') THEN 'TABLE' WHEN contains(text, '!!') THEN 'SHOUT' WHEN contains(text, '$$$') THEN 'MARKS' WHEN contains(text, 'license') THEN 'LICENSE' ELSE 'PROSE' END AS kind, count(*) AS n, count(CASE WHEN instr(text, 'license') > 0 THEN substr(text, greatest(instr(text, 'license') - 20, 1), 60) END) AS snippets FROM documents GROUP BY 1""")
def document_types(spark, sf):
    kind = X.first_rule(F.col("text"), [("TABLE", " | "), ("SHOUT", "!!"), ("MARKS", "$$$"), ("LICENSE", "license")], "PROSE")
    return V.read(spark, sf, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count(X.evidence(F.col("text"), "license")).alias("snippets"))


@query("DOM_37_event_ids", r"""WITH n AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(text, '[0-9]{3,}'))) AS v FROM documents), k AS (SELECT doc_id, sha256(lang || ':' || array_to_string(v, ',')) AS event_key FROM n WHERE len(v) > 0) SELECT event_key, min(doc_id) AS first_doc, count(*) AS n FROM k GROUP BY 1""")
def event_ids(spark, sf):
    v = F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0))))
    k = V.read(spark, sf, "documents").select("doc_id", "lang", v.alias("v")).where(F.size("v") > 0)
    return k.groupBy(F.sha2(F.concat("lang", F.lit(":"), F.array_join("v", ",")), 256).alias("event_key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("DOM_38_keyword_veto", """WITH h AS (SELECT source, doc_id, CASE WHEN contains(lower(text), 'worthless') THEN 1 WHEN contains(lower(text), 'scum') THEN 2 WHEN contains(lower(text), 'trash') THEN 3 END AS p FROM documents) SELECT source, CASE WHEN min(p) IS NULL THEN 'CLEAR' WHEN min(p) = 1 THEN 'VETO' ELSE 'WARN' END AS status, count(p) AS hits, arg_min(doc_id, p * 1000000000::BIGINT + doc_id) FILTER (WHERE p IS NOT NULL) AS worst FROM h GROUP BY 1""")
def keyword_veto(spark, sf):
    low = F.lower("text")
    p = F.when(low.contains("worthless"), 1).when(low.contains("scum"), 2).when(low.contains("trash"), 3)
    h = V.read(spark, sf, "documents").select("source", "doc_id", p.alias("p"))
    return h.groupBy("source").agg(F.when(F.min("p").isNull(), "CLEAR").when(F.min("p") == 1, "VETO").otherwise("WARN").alias("status"), F.count("p").alias("hits"), F.min_by("doc_id", F.when(F.col("p").isNotNull(), F.struct("p", "doc_id"))).alias("worst"))


@query("DOM_35_link_grades", """WITH l AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, 'the') THEN 1 END, CASE WHEN contains(text, 'license') THEN 2 END, CASE WHEN contains(text, 'http') THEN 3 END], lambda x: x IS NOT NULL)) AS level FROM documents) SELECT doc_id, CASE min(level) WHEN 1 THEN 'EXACT' WHEN 2 THEN 'SAME_INDEX' ELSE 'CLASS_ONLY' END AS grade, count(*) AS rules FROM l GROUP BY 1""")
def link_grades(spark, sf):
    levels = F.array_compact(F.array(*[F.when(F.col("text").contains(m), F.lit(k)) for k, m in ((1, "the"), (2, "license"), (3, "http"))]))
    l = V.read(spark, sf, "documents").select("doc_id", F.explode(levels).alias("level"))
    return l.groupBy("doc_id").agg(F.when(F.min("level") == 1, "EXACT").when(F.min("level") == 2, "SAME_INDEX").otherwise("CLASS_ONLY").alias("grade"), F.count("*").alias("rules"))


@query("FN_2_3_text_features", """WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}_]', '', 'g') AS t FROM part), b AS (SELECT *, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS g FROM n) SELECT a.p_partkey, a.t, round(len(list_intersect(a.g, c.g))::DOUBLE / nullif(len(list_distinct(list_concat(a.g, c.g))), 0), 6) AS similarity FROM b a JOIN b c ON c.p_partkey = a.p_partkey + 1""")
def text_features(spark, sf):
    n = V.read(spark, sf, "part").select("p_partkey", C.normalised_text(F.concat_ws(" ", "p_name", "p_brand")).alias("t")).withColumn("g", C.bigrams("t"))
    c = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("g").alias("h"))
    return n.join(c, "p_partkey").select("p_partkey", "t", F.round(C.jaccard("g", "h"), 6).alias("similarity"))


@query("DOM_28_29_composite", f"""{B}, {RETS}, f AS (SELECT symbol, trade_date, unnest([{{'v': least(1, greatest(-1, ret)), 'c': 0.9, 'w': 0.3}}, {{'v': least(1, amount / 400), 'c': 0.8, 'w': 0.3}}, {{'v': least(1, volume / 10), 'c': 0.5, 'w': 0.4}}]) AS e FROM rets) SELECT symbol, trade_date, round(sum(e.v * e.c * e.w) FILTER (WHERE e.v IS NOT NULL) / nullif(sum(e.c * e.w) FILTER (WHERE e.v IS NOT NULL), 0), 6) AS composite, count(e.v) AS factors FROM f WHERE e.v IS NOT NULL GROUP BY 1, 2""".replace("least(1, greatest(-1, ret))", "CASE WHEN ret IS NOT NULL THEN least(1, greatest(-1, ret)) END"))
def composite(spark, sf):
    parts = [(C.clip("ret"), 0.9, 0.3), (F.least(F.lit(1.0), F.col("amount") / 400), 0.8, 0.3), (F.least(F.lit(1.0), F.col("volume") / 10), 0.5, 0.4)]
    long = rets(spark, sf).select("symbol", "trade_date", F.explode(F.array(*[F.struct(v.alias("v"), F.lit(c).alias("c"), F.lit(w).alias("w")) for v, c, w in parts])).alias("e")).select("symbol", "trade_date", "e.*").where("v IS NOT NULL")
    return long.groupBy("symbol", "trade_date").agg(F.round(C.ratio(F.sum(F.col("v") * F.col("c") * F.col("w")), F.sum(F.col("c") * F.col("w"))), 6).alias("composite"), F.count("v").alias("factors"))


def _capped_sql(cap: float, rounds: int) -> str:
    """Each round cuts at the cap and gives what is cut to the others in proportion."""
    steps = ["w0 AS (SELECT trade_date, symbol, amount / sum(amount) OVER (PARTITION BY trade_date) AS w FROM top)"]
    for k in range(rounds):
        over, free = (f"sum({x}) OVER (PARTITION BY trade_date)" for x in (f"greatest(w - {cap}, 0)", f"CASE WHEN w < {cap} THEN w ELSE 0 END"))
        steps.append(f"w{k + 1} AS (SELECT trade_date, symbol, CASE WHEN w >= {cap} THEN {cap} ELSE w + coalesce(w * {over} / nullif({free}, 0), 0) END AS w FROM w{k})")
    return f"""{B}, {RETS}, top AS (SELECT trade_date, symbol, amount FROM rets QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) <= 10), {', '.join(steps)} SELECT trade_date, symbol, round(w, 6) AS weight FROM w{rounds}"""


@query("DOM_52_capped_weights", _capped_sql(0.15, 8))
def capped_weights(spark, sf):
    top = rets(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc("amount"), "symbol"))).where("k <= 10")
    own = top.groupBy("trade_date").agg(F.array_sort(F.collect_list(F.struct("k", "symbol", "amount"))).alias("a"))
    w = E.capped_weights(F.transform("a", lambda x: x["amount"]), 0.15)
    return own.select("trade_date", F.explode(F.arrays_zip(F.transform("a", lambda x: x["symbol"]).alias("symbol"), w.alias("weight"))).alias("z")).select("trade_date", F.col("z.symbol").alias("symbol"), F.round("z.weight", 6).alias("weight"))


@query("DOM_62_decisions", f"""{A}, z AS (SELECT symbol, trade_date, close, min(low) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo, max(high) {BY} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi FROM bars_a), s AS (SELECT *, (close - lo) / nullif(hi - lo, 0) AS x FROM z) SELECT CASE WHEN x IS NULL THEN 'WAIT' WHEN x > 0.8 THEN 'REDUCE' WHEN x < 0.2 THEN 'ADD' ELSE 'HOLD' END AS action, count(*) AS n, round(sum(CASE WHEN x < 0.2 THEN greatest(0, 1 - x * 5) ELSE 0 END), 4) AS size FROM s GROUP BY 1""")
def decisions(spark, sf):
    w = C.trailing(T.SYMBOL, 20)
    z = V.bars_a(spark, sf).withColumns({"lo": F.min("low").over(w), "hi": F.max("high").over(w)}).withColumn("x", C.ratio(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")))
    action = F.when(F.col("x").isNull(), "WAIT").when(F.col("x") > 0.8, "REDUCE").when(F.col("x") < 0.2, "ADD").otherwise("HOLD")
    return z.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("x") < 0.2, F.greatest(F.lit(0.0), 1 - F.col("x") * 5)).otherwise(0.0)), 4).alias("size"))


@query("DOM_63_divergence", f"""{B}, {RETS}, k AS (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, symbol) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol) AS b FROM rets) SELECT trade_date, count(*) FILTER (WHERE a <= 10 AND b <= 10) AS both_top, count(*) FILTER (WHERE a <= 10 AND b > 10) AS only_a, round(avg(abs(a - b)), 4) AS distance FROM k GROUP BY 1""")
def divergence(spark, sf):
    by = Window.partitionBy("trade_date")
    k = rets(spark, sf).select("trade_date", F.row_number().over(by.orderBy(F.desc("amount"), "symbol")).alias("a"), F.row_number().over(by.orderBy(F.desc("volume"), "symbol")).alias("b"))
    return k.groupBy("trade_date").agg(F.count_if(F.expr("a <= 10 AND b <= 10")).alias("both_top"), F.count_if(F.expr("a <= 10 AND b > 10")).alias("only_a"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 4).alias("distance"))


@query("DOM_65_universe", """WITH x AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'NEGATIVE_BALANCE' WHEN s_suppkey % 11 = 0 THEN 'SUSPENDED' END AS reason FROM supplier) SELECT coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n, sha256(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey)) AS digest FROM x GROUP BY 1""")
def universe(spark, sf):
    reason = F.when(F.col("s_acctbal") < 0, "NEGATIVE_BALANCE").when(F.col("s_suppkey") % 11 == 0, "SUSPENDED")
    x = V.read(spark, sf, "supplier").select("s_suppkey", F.coalesce(reason, F.lit("ELIGIBLE")).alias("reason"))
    return x.groupBy("reason").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("s_suppkey")), lambda v: v.cast("string")), ","), 256).alias("digest"))


@query("DOM_66_statement_flags", f"""{V.ctes('statements')}, p AS (SELECT *, lag(profit) OVER (PARTITION BY symbol ORDER BY period) AS pp FROM statements) SELECT symbol, period, array_to_string(list_filter([CASE WHEN profit < 0 THEN 'LOSS' END, CASE WHEN profit < pp * 0.7 AND pp > 0 THEN 'PROFIT_DOWN' END, CASE WHEN profit / nullif(assets, 0) < 0.005 THEN 'LOW_RETURN' END], lambda x: x IS NOT NULL), ',') AS flags FROM p""")
def statement_flags(spark, sf):
    p = V.statements(spark, sf).withColumn("pp", F.lag("profit").over(Window.partitionBy("symbol").orderBy("period")))
    return p.select("symbol", "period", F.array_join(C.flags(LOSS=F.col("profit") < 0, PROFIT_DOWN=(F.col("profit") < F.col("pp") * 0.7) & (F.col("pp") > 0), LOW_RETURN=C.ratio("profit", "assets") < 0.005), ",").alias("flags"))


@query("DOM_71_relative_snapshot", f"""{V.ctes('bars_a', 'industries')}, {PATH}, x AS (SELECT symbol, trade_date, (close - pc) / nullif(pc, 0) AS ret, sector FROM path JOIN industries USING (symbol)) SELECT symbol, trade_date, round(ret - avg(ret) OVER (PARTITION BY trade_date), 6) AS to_market, round(ret - avg(ret) OVER (PARTITION BY trade_date, sector), 6) AS to_sector FROM x""")
def relative_snapshot(spark, sf):
    x = T.path_features(V.bars_a(spark, sf)).join(V.industries(spark, sf), "symbol")
    return r(x, ["symbol", "trade_date"], to_market=F.col("ret") - F.avg("ret").over(Window.partitionBy("trade_date")), to_sector=F.col("ret") - F.avg("ret").over(Window.partitionBy("trade_date", "sector")))


@query("DOM_72_latest_modules", """WITH k AS (SELECT user_id, event_type, value, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts < TIMESTAMP '2024-01-20'), l AS (SELECT * FROM k WHERE k = 1) SELECT user_id, max(value) FILTER (WHERE event_type = 'view' AND d >= DATE '2024-01-17') AS "view", max(value) FILTER (WHERE event_type = 'click' AND d >= DATE '2024-01-17') AS click, count(*) FILTER (WHERE d < DATE '2024-01-17') AS stale FROM l GROUP BY 1""")
def latest_modules(spark, sf):
    known = V.read(spark, sf, "events").where("ts < TIMESTAMP_NTZ '2024-01-20'")
    l = pit.latest_revision(known, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).withColumn("fresh", F.to_date("ts") >= F.to_date(F.lit("2024-01-17")))
    one = lambda k: F.max(F.when((F.col("event_type") == k) & F.col("fresh"), F.col("value"))).alias(k)
    return l.groupBy("user_id").agg(one("view"), one("click"), F.count_if(~F.col("fresh")).alias("stale"))


@query("DOM_73_claims", f"""{V.ctes('bars_a')}, c AS (SELECT symbol, trade_date, close * CASE WHEN symbol % 3 = 0 THEN 1.5 ELSE 1.0001 END AS claim FROM bars_a), v AS (SELECT c.symbol, CASE WHEN abs(claim - close) <= 0.001 * greatest(abs(claim), abs(close)) THEN 'VERIFIED' ELSE 'CONFLICTING' END AS verdict FROM c JOIN bars_a b ON c.symbol = b.symbol AND c.trade_date = b.trade_date) SELECT symbol, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def claims(spark, sf):
    bars = V.bars_a(spark, sf).select("symbol", "trade_date", "close")
    c = bars.select("symbol", "trade_date", (F.col("close") * F.when(F.col("symbol") % 3 == 0, 1.5).otherwise(1.0001)).alias("claim"))
    j = c.join(bars, ["symbol", "trade_date"])
    return j.groupBy("symbol", F.when(C.close_enough("claim", "close", 0.0, 0.001), "VERIFIED").otherwise("CONFLICTING").alias("verdict")).agg(F.count("*").alias("n"))


@query("DOM_77_position_risk", f"""{V.ctes('trades')}, p AS (SELECT portfolio, symbol, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS q, avg(price) AS mean, arg_max(price, trade_id) AS last FROM trades GROUP BY 1, 2), g AS (SELECT *, last / nullif(mean, 0) - 1 AS move FROM p) SELECT portfolio, symbol, round(move, 6) AS move, CASE WHEN q = 0 THEN 0 WHEN move < -0.5 THEN 3 WHEN move < -0.2 THEN 2 ELSE 1 END AS level FROM g""")
def position_risk(spark, sf):
    q = F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")))
    g = V.trades(spark, sf).groupBy("portfolio", "symbol").agg(q.alias("q"), F.avg("price").alias("mean"), F.max_by("price", "trade_id").alias("last")).withColumn("move", C.ratio("last", "mean") - 1)
    return g.select("portfolio", "symbol", F.round("move", 6).alias("move"), F.when(F.col("q") == 0, 0).when(F.col("move") < -0.5, 3).when(F.col("move") < -0.2, 2).otherwise(1).alias("level"))


@query("DOM_76_attribution", f"""{B}, {RETS}, d AS (SELECT trade_date, avg(ret) AS m, sum(amount) AS a FROM rets GROUP BY 1), c AS (SELECT trade_date, list_filter([CASE WHEN m > 0 THEN 'RISING' END, CASE WHEN a > avg(a) OVER () THEN 'ACTIVE' END, CASE WHEN m <= 0 THEN 'FALLING' END], lambda x: x IS NOT NULL) AS flags FROM d), u AS (SELECT trade_date, unnest(flags) AS flag FROM c) SELECT flag, count(ret) AS n, round(avg(ret), 6) AS mean, round(count(*) FILTER (WHERE ret > 0) / nullif(count(ret), 0), 6) AS win FROM rets JOIN u USING (trade_date) GROUP BY 1""")
def attribution(spark, sf):
    x = rets(spark, sf)
    d = x.groupBy("trade_date").agg(F.avg("ret").alias("m"), F.sum("amount").alias("a")).withColumn("mean_a", F.avg("a").over(Window.partitionBy(F.lit(0))))
    flags = d.select("trade_date", F.explode(C.flags(RISING=F.col("m") > 0, ACTIVE=F.col("a") > F.col("mean_a"), FALLING=F.col("m") <= 0)).alias("flag"))
    return x.join(F.broadcast(flags), "trade_date").groupBy("flag").agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 6).alias("mean"), F.round(C.ratio(F.count_if(F.col("ret") > 0), F.count("ret")), 6).alias("win"))  # a few rows for each day
