"""The trie of conversation prefixes, found by blocks of turns.

A turn's hash covers its place, and a prefix is known by the exclusive or of its turns' hashes,
128 bits. Conversations are first grouped by whole blocks of turns: all that come to a block by
the same prefix and hold the same block are one row from there on. Only where the conversations
that come by one prefix hold different blocks, or end in them, siblings diverge, and only there
the boundaries of single turns are looked at; anywhere else each turn of the block is a node of
exactly the block's conversations.

Sums over subtrees need no walk through the tree. Every node belongs to its smallest member; a
conversation adds up, from its end on, the nodes that belong to it, and what it has at a node's
depth, summed over the node's members, is the sum over the node's subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanmill.llm.base import numbered_in_order, ship
from loanmill.sources.scratch import Scratch

#: Turns of a block.
BLOCK = 4
# Rows of one conversation that a window sees, and ids in one piece of a list.
_RUN, _LIST = 4096, 4096

_NODE = ["depth", "k1", "k2"]


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (`conv_id`, `depth` from 1, `role`, `text`) and `conv_id`s of the conversations, each
    led by the first turns of the one whose id is its hundred.

    Turns go by `turn`, null first; turns that share it by role and text. A null role or text is
    empty. Rows with a null conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    known = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", *texts)
    placed = numbered_in_order(known, ["conv_id", "turn", "role", "text"], scratch, "turns", "conv_id")
    placed = scratch.keep(placed.drop("turn"), "placed")
    sizes = scratch.keep(placed.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
    head = (F.crc32(F.col("conv_id").cast("string")) % 6).alias("head")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    ids = sizes.select("conv_id", head, base).join(of_base, "base", "left")
    ids = scratch.keep(
        ids.withColumn("led", F.least("head", F.coalesce("base_size", F.lit(0)))), "ids"
    )
    own = (
        placed.join(ids.select("conv_id", "head", "led"), "conv_id")
        .where("place >= head")
        .select("conv_id", (F.col("place") - F.col("head") + F.col("led") + 1).alias("depth"), "role", "text")
    )
    heads = placed.where("place < 6").withColumnRenamed("conv_id", "base")
    led = (
        ids.select("conv_id", "base", "led").join(heads, "base").where("place < led")
        .select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text")
    )
    return own.unionByName(led), ids.select("conv_id")


def _running(rows: DataFrame, by: str, backwards: bool, sums: dict[str, tuple]) -> DataFrame:
    """Adds running aggregates along each `conv_id` in the order of `by`.

    `sums` names a column, its aggregate and whether the row itself counts. Long conversations
    are cut into runs; what the runs before bring is found from one row per run.
    """
    run = F.floor(F.col(by) / _RUN)
    rows = rows.withColumn("run", run)
    order = F.col("run").desc() if backwards else F.col("run")
    before = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "run").agg(*(f(c).alias(c) for c, f, _ in sums.values()))
    totals = totals.select(
        "conv_id", "run", *(F.coalesce(f(c).over(before), F.lit(0)).alias(f"{name}_before")
                            for name, (c, f, _) in sums.items()),
    )
    inside = Window.partitionBy("conv_id", "run").orderBy(F.col(by).desc() if backwards else F.col(by))

    def upto(last: int) -> Window:
        return inside.rowsBetween(Window.unboundedPreceding, last)

    def joined(name: str, c: str, f, itself: bool) -> Column:
        here = F.coalesce(f(c).over(upto(0 if itself else -1)), F.lit(0))
        earlier = F.col(f"{name}_before")
        return (here.bitwiseXOR(earlier) if f is F.bit_xor else here + earlier).alias(name)

    kept = [c for c in rows.columns if c != "run"]
    found = [joined(name, *how) for name, how in sums.items()]
    return rows.join(totals, ["conv_id", "run"]).select(*kept, *found)


def _steps(blocks: DataFrame, *also: str, size: int) -> DataFrame:
    """One row per turn of each block: its node, the node's parent and the turn's length."""
    at = F.posexplode("turns").alias("at", "turn")

    def prefix(n: int, length: Column) -> Column:
        turns = F.slice("turns", F.lit(1), length)
        return F.aggregate(turns, F.col(f"before{n}"), lambda a, t: a.bitwiseXOR(t[f"h{n}"]))

    rows = blocks.select("block", "before1", "before2", "turns", *also, at)
    return rows.select(
        (F.col("block") * size + F.col("at") + 1).alias("depth"),
        *(prefix(n, F.col("at") + 1).alias(f"k{n}") for n in (1, 2)),
        *(prefix(n, F.col("at")).alias(f"parent{n}") for n in (1, 2)),
        F.col("turn.chars").alias("chars"),
        *also,
    )


def _lists(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ascending ids in `ends`, joined by commas.

    Ids are sorted over the cluster and joined in pieces; a node's pieces then stream through one
    hash, so no list is ever held whole.
    """
    spread = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [*_NODE, "first", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            rows = []
            for *at, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (at != node or len(ids) == _LIST):
                    rows.append((*node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = at
                ids.append(conv_id)
            yield _rows(rows, names)
        if ids:
            yield _rows([(*node, ids[0], ",".join(map(str, ids)))], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if at != node:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(rows, [*_NODE, "ends_sha256"])
        if node:
            yield _rows([(*node, digest.hexdigest())], [*_NODE, "ends_sha256"])

    order = [*_NODE, "conv_id"]
    sorted_ends = ends.select(*order).repartitionByRange(spread, *order).sortWithinPartitions(*order)
    kind = ", ".join(f"{c} long" for c in _NODE)
    cut = sorted_ends.mapInArrow(pieces, f"{kind}, first long, ids string")
    return (
        cut.repartition(spread, *_NODE).sortWithinPartitions(*_NODE, "first")
        .mapInArrow(digests, f"{kind}, ends_sha256 string")
    )


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.string() if name in ("ids", "ends_sha256") else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def prefix_trie(
    turns: DataFrame, members: DataFrame, scratch: Scratch, size: int = BLOCK
) -> DataFrame:
    """The nodes of the trie of `members` (`conv_id`, distinct) and their `turns` (`conv_id`,
    `depth` 1, 2, ... without gaps, `role`, `text`, none null).

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens (over the subtree, members but one times code points of the
    last text), ends_sha256 (of the members that end there). Members without turns end at the
    root. Without members there is no node. `size` changes the work, not the result.
    """
    ship(turns.sparkSession)
    hashes = [F.xxhash64(F.lit(n), "depth", "role", "text").alias(f"h{n}") for n in (1, 2)]
    hashed = turns.select("conv_id", "depth", *hashes, F.char_length("text").alias("chars"))
    block = F.floor((F.col("depth") - 1) / size).alias("block")
    own = hashed.groupBy("conv_id", block).agg(
        F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "chars"))).alias("turns"),
        *(F.bit_xor(f"h{n}").alias(f"b{n}") for n in (1, 2)),
    )
    own = scratch.keep(own, "own")
    before = {f"before{n}": (f"b{n}", F.bit_xor, False) for n in (1, 2)}
    blocks = scratch.keep(_running(own, "block", False, before), "blocks")

    came = ["block", "before1", "before2"]
    held = scratch.keep(
        blocks.groupBy(*came, "b1", "b2").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.first("turns").alias("turns"),
        ),
        "held",
    )
    siblings = held.groupBy(*came).agg(F.count("*").alias("siblings"))
    held = scratch.keep(held.join(siblings, came), "marked")
    alike = _steps(held.where("siblings = 1"), "n_convs", "conv_id", size=size)
    refined = (
        _steps(held.where("siblings > 1"), "n_convs", "conv_id", size=size)
        .groupBy(*_NODE, "parent1", "parent2", "chars")
        .agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    )
    found = scratch.keep(alike.unionByName(refined), "found")

    parent = [(F.col("depth") - 1).alias("depth"), F.col("parent1").alias("k1"), F.col("parent2").alias("k2")]
    children = found.groupBy(*parent).agg(F.count("*").alias("n_children"))
    children = scratch.keep(children, "children")
    n_children = F.coalesce("n_children", F.lit(0)).alias("n_children")
    nodes = found.join(children, _NODE, "left").select(
        *found.columns, n_children, ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        (n_children == 0).cast("long").alias("leaf"),
    )
    nodes = scratch.keep(nodes, "nodes")

    belongs = nodes.select("conv_id", "depth", "saved", "leaf")
    paths = _steps(blocks, "conv_id", size=size).select("conv_id", *_NODE)
    paths = paths.join(belongs, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaf"])
    paths = scratch.keep(paths, "paths")
    below = {"saved_tokens": ("saved", F.sum, True), "n_leaves": ("leaf", F.sum, True)}
    sums = (
        _running(paths, "depth", True, below).groupBy(*_NODE)
        .agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    )
    inner = nodes.join(sums, _NODE).select(
        *_NODE, "parent1", "parent2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    )
    saved, leaves, n_top = nodes.agg(
        F.sum("saved"), F.sum("leaf"), F.count_if(F.col("depth") == 1)
    ).first()
    of_all = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = of_all.where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in _NODE),
        *(F.lit(None).cast("long").alias(c) for c in ("parent1", "parent2")),
        "conv_id", "n_convs", F.lit(n_top).cast("long").alias("n_children"),
        F.lit(leaves or 1).cast("long").alias("n_leaves"),
        F.lit(saved or 0).cast("long").alias("saved_tokens"),
    )
    every = scratch.keep(inner.unionByName(root), "every")

    last = own.groupBy("conv_id").agg(
        F.max(F.element_at("turns", -1)["depth"]).alias("depth"),
        F.bit_xor("b1").alias("k1"), F.bit_xor("b2").alias("k2"),
    )
    ends = members.select("conv_id").join(last, "conv_id", "left").fillna(0, _NODE)
    every = every.join(_lists(ends), _NODE, "left")
    above = every.select(
        F.col("depth").alias("above"), F.col("k1").alias("above1"), F.col("k2").alias("above2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    above = scratch.keep(above, "above")
    is_parent = (
        (F.col("depth") - 1 == F.col("above"))
        & (F.col("parent1") == F.col("above1"))
        & (F.col("parent2") == F.col("above2"))
    )
    empty = hashlib.sha256().hexdigest()
    return scratch.keep(every, "listed").join(above, is_parent, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
