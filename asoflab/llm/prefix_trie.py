"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

Conversations are put together first (``rebuilt``): the first ``h`` turns of the group's
first conversation ``c - c % group``, all if it has fewer and none if it is absent, then the
turns of ``c`` after its own first ``h``; h is the crc32 of the decimal id modulo ``most``.
Turns are ordered by turn number, null first, then by the SHA-256 of role and text; null
roles and texts are empty. Rows without a conv_id belong to no conversation. Repeated rows
are turns of their own. No conversations, no nodes, not even the root.

A turn's id stands for its role and text. A conversation is laid out in blocks of ``width``
id columns, one row for each block. ``GROUP BY block, prior, ROLLUP(t1, ..., t8)`` counts the
members of all prefixes at once; grouping_id tells the depth, and rows whose deepest id is
missing are no prefixes. ``prior`` is the node at the end of the block before, named by its
smallest member. For long conversations those names come by doubling: a name of the last 2^k
blocks and the name 2^k blocks earlier give one of 2^(k+1) blocks, so a conversation of n
blocks takes log2(n) rounds and no block waits for the one before.

A node is known by its smallest member m and its depth, so sums over subtrees need no walk:
each node belongs to its m. Of a node's members, all nodes that belong to them lie in its
subtree but those of m above it. A second ROLLUP adds the members' totals, and a running sum
along m takes off what lies above.

Hot conversations are numbered by ranges and hot prefixes pre-aggregated before they are
shuffled; joins have one side with unique keys, so adaptive execution may split the other.
The digest of the ids that end at a node runs over their text in order: ids are joined in
pieces by ranges of (node, id), then one pass over the pieces feeds the hash, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Nodes of a path that one running sum takes.
STRETCH = 4096
#: Ids of a piece of text.
PIECE = 4096


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t): turns numbered from 1 in each conversation; t is a struct of the turn's id and its text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    placed = common.places_of(common.written(turns, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")])
    placed = common.written(placed.select("conv_id", "place", "digest", "bytes"), "placed")
    ids = common.written(placed.groupBy("digest").agg(F.max("bytes").alias("bytes")).withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    return common.written(placed.drop("bytes").join(ids, "digest").select("conv_id", "place", F.struct("id", "bytes").alias("t")), "turns")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length), turnless ones too, and their turns (conv_id, place, t) as they are put together."""
    sizes = common.written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), heads.alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = common.written(convs.withColumn("length", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    first = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "t")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").where("place <= h").select("conv_id", "place", "t")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "t")
    return convs.select("conv_id", "length"), lent.union(own)


def _blocks(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(conv_id, length, block, prior, t1, t2, ...): prior is null in the first block, which turnless conversations have too."""
    columns = [f"t{k + 1}" for k in range(width)]
    slot = (F.col("place") - 1) % width
    rows = turns.select("conv_id", F.floor((F.col("place") - 1) / width).cast("long").alias("block"), slot.alias("slot"), "t")
    wide = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("slot") == k, F.col("t"))).alias(c) for k, c in enumerate(columns)])
    none = convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast(wide.schema[c].dataType).alias(c) for c in columns])
    wide = common.written(wide.union(none).join(convs, "conv_id"), "blocks")
    # names of the nodes at the ends of whole blocks, of conversations that end there too
    full = wide.where((F.col("block") + 1) * width <= F.col("length"))
    names = common.written(_named(full.select("conv_id", "block", *columns), columns), "names")
    step, last = 1, names.agg(F.max("block")).first()[0] or 0
    while step <= last:
        before = names.select("conv_id", (F.col("block") + step).alias("block"), F.col("name").alias("before"))
        longer = _named(names.where(F.col("block") >= step).join(before, ["conv_id", "block"]), ["name", "before"])
        names = common.written(names.where(F.col("block") < step).union(longer), "names")
        step *= 2
    prior = names.select("conv_id", (F.col("block") + 1).alias("block"), F.col("name").alias("prior"))
    return common.written(wide.join(prior, ["conv_id", "block"], "left").select("conv_id", "length", "block", "prior", *columns), "blocks")


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """(conv_id, block, name): rows that agree in block and by share a name, the smallest conv_id among them."""
    least = rows.groupBy("block", *by).agg(F.min("conv_id").alias("least"))
    return rows.join(least.select("block", *by, "least"), ["block", *by]).select("conv_id", "block", F.col("least").alias("name"))


def _rolled(blocks: DataFrame, width: int, sums: str) -> DataFrame:
    """(block, prior, path, depth, t) and sums, a row for each prefix; t is its last turn, null at the root."""
    columns = [f"t{k + 1}" for k in range(width)]
    sql = f"SELECT block, prior, {', '.join(columns)}, {width} - bit_count(grouping_id()) AS level, {sums} FROM {{blocks}} GROUP BY block, prior, ROLLUP({', '.join(columns)})"
    rows = blocks.sparkSession.sql(sql, blocks=blocks)
    path = F.slice(F.array(*columns), 1, F.col("level"))
    rows = rows.withColumn("path", path).withColumn("t", F.get("path", F.col("level") - 1))
    rows = rows.where("(level > 0 AND t IS NOT NULL) OR (level = 0 AND block = 0)")
    return rows.withColumn("depth", F.col("block") * width + F.col("level")).drop("level", *columns)


def _above(nodes: DataFrame, column: str) -> Column:
    """Sum of column over the nodes of the same conv_id above each; stretches of the path are summed first."""
    stretch = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(stretch), F.lit(0)) + F.col("earlier")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) to pieces (conv_id, depth, member of the first, text)."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "member": [ids[0]], "text": [",".join(map(str, ids))]})

    for b in batches:
        for c, d, m in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if node != (c, d) or len(ids) == PIECE:
                if ids:
                    yield piece()
                node, ids = (c, d), []
            ids.append(m)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (conv_id, depth, ends_sha256); one hash is open at a time."""
    node, hash_ = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv_id": [node[0]], "depth": [node[1]], "ends_sha256": [hash_.hexdigest()]})

    for b in batches:
        for c, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if node != (c, d):
                if node:
                    yield done()
                node, hash_ = (c, d), hashlib.sha256()
            else:
                hash_.update(b",")
            hash_.update(text.encode())
    if node:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of a written table ends(conv_id, depth, member)."""
    common.importable(ends.sparkSession)
    order = ["conv_id", "depth", "member"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order).mapInArrow(_pieces, "conv_id long, depth long, member long, text string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 5, most: int = 9, width: int = 8) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations, of conversations(conv_id, turn, role, text)."""
    convs, turns = rebuilt(turn_ids(conversations), group, most)
    blocks = _blocks(convs, turns, width)
    nodes = _rolled(blocks, width, "count(*) AS n_convs, min(conv_id) AS conv_id")
    nodes = common.written(nodes.withColumn("place", F.struct("block", F.coalesce("prior", F.lit(0)).alias("prior"), "path")), "nodes")

    # a conversation's nodes are a stretch of its path: only the parent of the first belongs to another
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    tops = nodes.join(tops, ["conv_id", "depth"]).where("depth > 0").withColumn("level", F.size("path"))
    root = nodes.where("depth = 0").select("conv_id").first()  # one row, or none without conversations
    inside = tops.where("level > 1").select("conv_id", "depth", F.struct("block", F.col("place.prior").alias("prior"), F.slice("path", F.lit(1), F.col("level") - 1).alias("path")).alias("place"))
    inside = inside.join(nodes.select("place", F.col("conv_id").alias("parent")), "place").select("conv_id", "depth", "parent")
    first = tops.where("level = 1 AND block > 0").select("conv_id", "depth", F.col("prior").alias("parent"))
    under_root = tops.where("depth = 1").select("conv_id", "depth", F.lit(root[0] if root else None).cast("long").alias("parent"))
    known = nodes.join(inside.union(first).union(under_root), ["conv_id", "depth"], "left")
    known = common.written(known.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", F.coalesce("t.bytes", F.lit(0)).alias("bytes")), "tree")

    children = known.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = known.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = own.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    own = common.written(own, "weights")
    totals = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    told = blocks.join(common.written(totals, "totals"), "conv_id", "left")
    sums = _rolled(told, width, "coalesce(sum(saved), 0) AS all_saved, coalesce(sum(leaves), 0) AS n_leaves, min(conv_id) AS conv_id").select("conv_id", "depth", "all_saved", "n_leaves")
    stretches = own.groupBy("conv_id", "stretch").agg(F.sum("saved").alias("sum"))
    running = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select("conv_id", "stretch", F.coalesce(F.sum("sum").over(running), F.lit(0)).alias("earlier"))
    above = own.join(stretches, ["conv_id", "stretch"]).withColumn("above", _above(own, "saved"))

    last = blocks.where(F.col("block") == F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / width))
    path = F.filter(F.array(*[f"t{k + 1}" for k in range(width)]), lambda t: t.isNotNull())
    ends = last.select(F.col("conv_id").alias("member"), F.struct("block", F.coalesce("prior", F.lit(0)).alias("prior"), path.alias("path")).alias("place"))
    ends = common.written(ends.join(nodes.select("place", "conv_id", "depth"), "place").select("conv_id", "depth", "member"), "ends")
    digests = common.written(end_digests(ends), "end-digests")

    full = above.join(sums, ["conv_id", "depth"]).join(digests, ["conv_id", "depth"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
