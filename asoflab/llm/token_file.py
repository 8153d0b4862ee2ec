"""Token-ID output with fixed-width bit packing.

A token file is a folder of block rows, written and read by Spark alone, so that
any store will do. A block holds the ids of consecutive documents:

    shard int, block int       place in the order of the documents
    bits int                   the minimum width that holds the vocabulary
    n_ids long                 ids in the block
    nameless int               documents without an id, which come first
    doc_ids array<long>        the other documents
    offsets binary             uint32 little-endian: first id of each document, then n_ids
    payload binary             ids of ``bits`` bits each, least significant bit first

``offsets`` and the fixed width give random access: id k of a block starts at bit
k * bits. ``starts`` of the shards are in the table ``shards``: the ids before each.
Documents are in ascending id order (null ids first); repeated ids keep one row each.
A document longer than a block is a block of its own.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_IDS = 1 << 18
CACHE = 1_000_000  # pieces that a worker remembers: about 160 bytes each
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SHAPE = re.compile(rf"([{LATIN}]+)([.,])?(?:\n([{LATIN}]+)([.,])?)?")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
END = 0
FIELDS = "shard int, block int, bits int, n_ids long, nameless int, doc_ids array<long>, offsets binary, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Whole-byte widths are a plain cast; others go through a bit matrix."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """ids first .. first + count of a block, touching only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    a, b = first * bits, (first + count) * bits
    part = np.unpackbits(np.frombuffer(payload, np.uint8, -(-b // 8) - a // 8, a // 8), bitorder="little")[a % 8 : a % 8 + b - a].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = part
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class _Loose(Exception):
    """A piece begins or ends with white space: its text can't be cut at every space."""


class _Pieces(dict):
    """Ids, as bytes, of pieces that stand after ``mark`` (a space, or nothing); a missing one is encoded when asked for."""

    def __init__(self, owner: Encoder, mark: str) -> None:
        self.owner, self.mark, self.strict = owner, mark, True

    def __missing__(self, piece: str) -> bytes:
        own = self.owner
        if m := SHAPE.fullmatch(piece):
            word, stop, next_word, next_stop = m.groups()
            if stop or next_word:
                start = own.starts
                out = self[word] + (start[stop] if stop else b"") + (start["\n"] + start[next_word] if next_word else b"") + (start[next_stop] if next_stop else b"")
            else:
                out = array("I", [t.id for t in own.model.tokenize((self.mark + word).translate(own.level))]).tobytes()
        elif self.strict and piece != "\n" and (piece[:1].isspace() or piece[-1:].isspace() or (not piece and self.mark)):
            raise _Loose
        else:
            out = array("I", own.tokenizer.encode(self.mark + piece, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out


def by_pieces(told: dict) -> bool:
    """Whether a tokenizer (its own description) is byte-level BPE that cuts texts as Encoder does: nothing is
    normalised, cut off or dropped, and no added token holds white space or could be part of a word."""
    model, cuts = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space", True)
    added = all(not re.search(r"\s", t["content"]) and re.search(rf"[^{LATIN}.,]", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
    return bool(plain and level and added and not told["normalizer"] and not told["truncation"] and not told["padding"])


class Encoder:
    """The tokenizers library, asked once for each distinct piece between single spaces.

    The vocabulary's own pre-tokenizer always cuts before a space that stands
    between two characters that aren't white space, so pieces encode as in the
    whole text; texts with other white space around a space are cut only there.
    A word of Latin letters is one pre-token, so it goes to the BPE model directly,
    and a piece of such words, full stops, commas and a line end is the sum of its parts.
    That holds for byte-level BPE as ``by_pieces`` tells; texts are encoded whole with
    any other tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not by_pieces(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: a character's bytes as the model's alphabet writes them
        self.level = {c: "".join(t for t, _ in level.pre_tokenize_str(chr(c))) for c in range(0x250)}
        self.starts, self.spaced = _Pieces(self, ""), _Pieces(self, " ")  # pieces at a text's or line's start; after a space

    def _ids(self, parts: list[str]) -> np.ndarray:
        return np.frombuffer(self.starts[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:])), "<u4")

    def encode(self, text: str) -> np.ndarray:
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if text[:1].isspace() or text[-1:].isspace():
            return self._loose(text)
        try:
            return self._ids(text.split(" "))
        except _Loose:
            return self._loose(text)

    def _loose(self, text: str) -> np.ndarray:
        self.starts.strict = self.spaced.strict = False
        try:
            return self._ids(SINGLE.split(text))
        finally:
            self.starts.strict = self.spaced.strict = True


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: what it has learned serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _blocks(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        bits = max(1, int(own.size - 1).bit_length())
        shard, number, held, ids, docs, nameless = 0, 0, 0, [], [], 0

        def block() -> pd.DataFrame:
            every = np.concatenate(ids)
            offsets = np.cumsum([0, *map(len, ids)]).astype("<u4")
            return pd.DataFrame({"shard": [shard], "block": [number], "bits": [bits], "n_ids": [len(every)], "nameless": [nameless], "doc_ids": [np.array(docs, np.int64)], "offsets": [offsets.tobytes()], "payload": [pack(every, bits)]})

        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                shard = int(part["shard"].iat[0])
                for i, t in zip(part["doc_id"].astype("Int64"), part["text"], strict=True):
                    x = own.encode(t or "")
                    if ids and held + len(x) + 1 > BLOCK_IDS:
                        yield block()
                        number, held, ids, docs, nameless = number + 1, 0, [], [], 0
                    ids.append(np.append(x, np.uint32(END)))
                    held += len(x) + 1
                    if i is pd.NA:
                        nameless += 1
                    else:
                        docs.append(i)
        if ids:
            yield block()

    return run


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes docs(doc_id, text) as a token file in the folder path."""
    common.importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    ordered = ordered.withColumn("shard", F.spark_partition_id())
    ordered.mapInPandas(_blocks(tokenizer), FIELDS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.schema(FIELDS).parquet(f"{path}/blocks")
    # one row for each shard, as many as the writer had partitions
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")).write.parquet(f"{path}/shards")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out: dict[str, list] = {"doc_id": [], "shard": [], "block": [], "offset": [], "n_tokens": [], "ids_crc32": []}
        for r in f.itertuples():
            at = np.frombuffer(r.offsets, "<u4").astype(np.int64)
            for i, a, b in zip([*[None] * r.nameless, *r.doc_ids.tolist()], at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = unpack(r.payload, r.bits, a, b - a)
                for k, v in zip(out, (i, r.shard, r.block, a, b - a, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    out[k].append(v)
        yield pd.DataFrame(out | {"doc_id": pd.array(out["doc_id"], "Int64")})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token file, from its packed ids."""
    common.importable(spark)
    blocks = spark.read.schema(FIELDS).parquet(f"{path}/blocks")
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_start")).join(shards, "shard")
    docs = blocks.mapInPandas(_digests, "doc_id long, shard int, block int, offset long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
