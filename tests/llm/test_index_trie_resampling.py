"""Decontamination, the prefix trie and resampling against brute force, with the odd cases their docstrings state."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asoflab.llm import common, decontamination, prefix_trie, resampling

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, row long, term string, words string, weight string, rank string, item string"


def docs(spark, texts, ids=None):
    rows = [(i, t, 3, "x", "y", "z", "r", "i") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def items(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in zip(ids or range(len(texts)), texts, strict=True)], "item_id long, text string, item string, n int").repartition(2)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# decontamination


def plain_scan(texts, tests, size, span):
    out = []
    for text in texts:
        w, hit, ids, close = words(text), set(), set(), set()
        for i, t in tests:
            own = words(t)
            width = min(size, len(own))
            for s in range(len(own) - width + 1 if own else 0):
                window = own[s : s + width]
                for k in range(len(w) - width + 1):
                    if w[k : k + width] == window:
                        hit.update(range(k, k + width))
                        ids.add(i)
                if any(set(window) <= set(w[k : k + span]) for k in range(len(w))):
                    close.add(i)
        named = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit), len(close - {None})))
    return out


@pytest.mark.parametrize(("size", "span", "rarest"), [(10, 20, 2), (4, 7, 3), (3, 3, 1)])
def test_decontamination(spark, size, span, rarest):
    tests = [(k, prose(100 + k, 6 + 3 * k)) for k in range(6)]
    tests += [(50, "omega only here"), (51, "Zeta"), (None, "nobody named me at all"), (3, "again three"), (52, None), (53, " .,! "), (54, "the the the the"), (55, "mu nu mu xi nu mu pi rho mu tau sigma eta")]
    texts = [prose(k, 40) for k in range(12)]
    texts += [f"{prose(20, 9)} {tests[4][1].upper()} {prose(21, 5)} {tests[4][1]}", tests[5][1], " ".join(tests[3][1].split()[1:]), None, "", "!!", "ZETA", "nobody, named; me at all"]
    texts += ["the the the the the the", "again three " * 40, " ".join(reversed(tests[1][1].split())), "mu nu mu xi nu mu pi rho mu tau sigma eta", "Éta étA éta zeta"]
    texts += [tests[2][1] + " " + prose(9, 3000), texts[12], texts[12]]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # a repeated row
    got = decontamination.scan(docs(spark, texts, ids), items(spark, [t for _, t in tests], [i for i, _ in tests]), size, span, rarest).collect()
    want = plain_scan(texts, tests, size, span)
    assert sorted((r["doc_id"], *list(r)[1:]) for r in got) == sorted((i, *w) for i, w in zip(ids, want, strict=True))


def test_decontamination_of_empty_tables(spark):
    some, none = docs(spark, ["alpha beta", None]), docs(spark, ["x"]).limit(0)
    assert {(r["n_words"], r["n_hit"], r["contaminated"]) for r in decontamination.scan(some, items(spark, ["x"]).limit(0)).collect()} == {(2, 0, False), (0, 0, False)}
    assert decontamination.scan(none, items(spark, ["alpha"])).collect() == []


def test_decontamination_joins_by_shuffle_alike(spark, monkeypatch):
    d, t = docs(spark, [prose(k, 60) for k in range(20)]), items(spark, [prose(k, 30) for k in range(0, 8, 2)])
    few = sorted(map(str, decontamination.scan(d, t, 6, 12).collect()))
    monkeypatch.setattr(decontamination, "FEW", 0)
    assert sorted(map(str, decontamination.scan(d, t, 6, 12).collect())) == few


def test_an_index_of_all_terms_serves_later_items(spark):
    own = decontamination.index(docs(spark, [prose(k, 50) for k in range(6)]))
    assert own.postings.count() == 300
    tests = decontamination.test_items(items(spark, [" ".join(prose(3, 50).split()[7:19])]))
    assert {(r["start"], r["width"]) for r in decontamination.phrases(own, tests).collect()} == {(7, 10), (8, 10), (9, 10)}


# prefix trie


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int, t int").repartition(3)


def plain_trie(rows, group=5, most=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(w)] for c, w in own.items()}
    members, ends = {}, {}
    for c, w in own.items():
        h = zlib.crc32(str(c).encode()) % most
        path = own.get(int(c - math.fmod(c, group)), [])[:h] + w[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = sum(saved[x] for x in children.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(children.get(p, [])), leaves[p], saved[p], digest(p)) for p, m in members.items())


def told(df):
    return sorted((r["conv_id"], r["depth"], -99 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("width", [8, 2, 1])
def test_trie(spark, width):
    r = random.Random(5)
    rows = []
    for c in [*range(30), 41, 43, 77, -3, -5, 10**12]:
        for turn in range(r.choice([1, 2, 5, 9, 17])):
            rows.append((c, turn, r.choice(["user", None, "bot"]) if turn > 2 else "user", r.choice(["hi", "é", None, ""]) if turn > 1 else "hello"))
    rows += [(200, None, "a", "null turn"), (200, 0, "b", "x"), (200, 0, "b", "x"), (200, 0, "a", "y"), (None, 1, "a", "nobody")]
    for c in range(300, 312):  # copies of one long conversation, and one that leaves it late
        rows += [(c, k, "u", f"turn {k % 7}" if (c, k) != (305, 60) else "else") for k in range(70)]
    r.shuffle(rows)
    assert told(prefix_trie.trie(talks(spark, rows), width=width)) == plain_trie(rows)


def test_trie_in_small_pieces_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    rows = [(5 * c, k, "u", f"t{k}" if k < 9 or c % 3 else f"{c}") for c in range(15) for k in range(12)]
    assert told(prefix_trie.trie(talks(spark, rows))) == plain_trie(rows)
    b = [prefix_trie.pa.RecordBatch.from_pydict({"conv_id": [1, 1, 1, 2], "depth": [3] * 4, "member": [1, 4, 9, 2]})]
    assert [x.to_pydict() for x in prefix_trie._hashed(prefix_trie._pieces(b))] == [{"conv_id": [c], "depth": [3], "ends_sha256": [hashlib.sha256(t).hexdigest()]} for c, t in ((1, b"1,4,9"), (2, b"2"))]


def test_trie_of_no_conversations(spark):
    assert prefix_trie.trie(talks(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []


def test_places_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 100 + 1).otherwise(0).alias("k"), (F.col("id") * 7919 % 500).alias("v"))
    rows = common.written(rows, "hot")
    got = {}
    for x in common.places_of(rows, "k", [F.col("v")]).collect():
        got.setdefault(x["k"], []).append((x["place"], x["v"]))
    for k, x in got.items():
        assert [p for p, _ in sorted(x)] == list(range(1, len(x) + 1)), k
        assert [v for _, v in sorted(x)] == sorted(v for _, v in x)
    ordered = sorted((x["place"], x["v"]) for x in common.global_places(rows, [F.col("v").desc()]).collect())
    assert [p for p, _ in ordered] == list(range(1, 3001)) and [v for _, v in ordered] == sorted((v for _, v in ordered), reverse=True)


# resampling


def test_crc_of_spans():
    r = np.random.default_rng(3)
    data = r.integers(0, 256, 5000).astype(np.uint8)
    starts = np.array([0, 5, 5, 17, 100, 100, 0, 4999, 64, 64, 64, 7])
    ends = np.array([5000, 5, 6, 81, 165, 228, 1, 5000, 128, 129, 127, 3000])
    assert resampling.crc32_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    starts = r.integers(0, 4000, 800)
    ends = starts + r.integers(0, 300, 800)
    assert resampling.crc32_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_crc_in_small_strides(monkeypatch):
    monkeypatch.setattr(resampling, "STRIDE", 50)
    test_crc_of_spans()


def plain_resampling(texts, ids, target, shortest, longest, buckets, percent, least, seed):
    grams = lambda t: [" ".join(words(t)[k : k + n]) for n in range(shortest, longest + 1) for k in range(len(words(t)) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    held, goal = [0] * buckets, [0] * buckets
    for own, some in ((held, texts), (goal, target)):
        for t in some:
            for g in grams(t):
                own[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(held) + buckets) / ((s + 1) * (sum(goal) + buckets)))) for s, t in zip(held, goal, strict=True)]
    rows = []
    for i, t in zip(ids, texts, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(t))
        rows.append([i, len(words(t)), len(grams(t)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    most = percent * len(able) // 100
    for x in rows:
        x.append(0)
    for k, x in enumerate(able[:most]):
        x[5] = k + 1
    return sorted(map(str, rows))


@pytest.mark.parametrize(("shortest", "longest", "chunk"), [(1, 1, 1 << 22), (1, 3, 1 << 22), (2, 2, 30)])
def test_resampling(spark, monkeypatch, shortest, longest, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    texts = [prose(k, 5 + k) + (" " + "long" * k + "word" if k % 3 else "") for k in range(40)] + [None, "", "...", "Éa éA İK", prose(3, 4000), "w" * 700, prose(5, 30), prose(5, 30)]
    ids = [*range(len(texts) - 3), None, 7, 7]
    target = [*(prose(500 + k, 12) + " longlongword" for k in range(5)), None]
    got = resampling.resampled(docs(spark, texts, ids), docs(spark, target), shortest, longest, 97, 40, 10, 11).collect()
    assert sorted(str([*list(r)[:5], r["rank"] or 0]) for r in got) == plain_resampling(texts, ids, target, shortest, longest, 97, 40, 10, 11)


def test_resampling_of_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    assert resampling.resampled(none, none).collect() == []
    got = resampling.resampled(docs(spark, [prose(1, 30), None]), none, percent=100).collect()
    assert {(r["n_features"], r["rank"]) for r in got} == {(30, 1), (0, None)}
