"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group; groups stand in the order of a hash of the
text. The smallest capacity for which a greedy pass needs no more than the wanted shards is
found by binary search, and the order is cut where that pass cuts. A group above the fair
share takes a shard alone, else the one capacity it forces would leave the others uneven.

The driver never holds the groups. It holds sums over ranges of the hash: 2^16 at first,
then, six bits at a time, parts of those ranges that a cut can still fall into, at most 2,048
ranges at once. The least capacity lies between that of ranges that may be cut anywhere and
that of ranges that may not be cut. Where many ranges are open, those that decide whether the
middle of the two will do come first, in their order, since an early cut settles later ones.
The result is the exact minimax partition.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanmill.llm.base import numbered_in_order
from loanmill.sources.scratch import Scratch

_FIRST_BITS, _MORE_BITS = 16, 6
# Ranges refined at once; each gives up to 2^6 parts.
_REFINED = 2048


def greedy_cuts(reach: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Index after the last piece of each shard, or None where the capacity is too small.

    `reach` holds the running sum of the piece sizes.
    """
    ends, done, n = [], 0, len(reach)
    for _ in range(shards):
        end = int(np.searchsorted(reach, done + capacity, side="right"))
        ends.append(end)
        if end == n:
            return ends
        done = int(reach[end - 1]) if end else 0
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least maximum of a contiguous partition of `sizes` into at most `shards` parts."""
    reach = np.cumsum(sizes)
    low = max(int(sizes.max()), -(-int(reach[-1]) // shards))
    return _least(low, int(reach[-1]), lambda c: greedy_cuts(reach, c, shards) is not None)


def furthest(reach: np.ndarray, whole: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Piece in which each shard ends if pieces that aren't `whole` may be cut anywhere, or
    None where even then the capacity is too small."""
    ends, done, n = [], 0, len(reach)
    for _ in range(shards):
        end = int(np.searchsorted(reach, done + capacity, side="right"))
        ends.append(end)
        if end == n:
            return ends
        done = done + capacity if not whole[end] else int(reach[end - 1]) if end else 0
    return None


def _least(low: int, high: int, enough) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def _between(reach: np.ndarray, whole: np.ndarray, low: int, high: int, shards: int) -> list[int]:
    """Pieces that may be cut by a greedy pass with some capacity from `low` to `high`."""
    far = furthest(reach, whole, high, shards) or []
    open_, done = np.zeros(len(reach) + 1, bool), 0
    for i in range(shards):
        near = int(np.searchsorted(reach, done + low, side="right"))
        done = int(reach[near - 1]) if near else 0
        open_[near : (far[i] if i < len(far) else len(reach)) + 1] = True
    return np.flatnonzero(open_[:-1] & ~whole).tolist()


def _ranges(groups: DataFrame, shift: int) -> dict[int, tuple[int, int]]:
    part = groups.groupBy(F.shiftright("group_key", shift).alias("k"))
    rows = part.agg(F.sum("group_size").alias("size"), F.count("*").alias("n")).collect()
    return {r.k << shift: (r.size, r.n) for r in rows}


def cut_keys(groups: DataFrame, shards: int, largest: int) -> list[int]:
    """First `group_key` of every shard but the first."""
    shift = 64 - _FIRST_BITS
    pieces = {k: (*v, shift) for k, v in _ranges(groups, shift).items()}
    while pieces:
        keys = sorted(pieces)
        sizes = np.array([pieces[k][0] for k in keys])
        whole = np.array([pieces[k][1] == 1 or not pieces[k][2] for k in keys])
        reach = np.cumsum(sizes)
        high = smallest_capacity(sizes, shards)
        fair = max(largest, -(-int(reach[-1]) // shards))
        low = _least(fair, high, lambda c: furthest(reach, whole, c, shards) is not None)
        asked = _between(reach, whole, low, high, shards)
        if len(asked) > _REFINED:
            middle = (low + high) // 2
            asked = _between(reach, whole, middle, middle, shards)
        if not asked:
            return [keys[e] for e in greedy_cuts(reach, high, shards) if e < len(keys)]
        wide = max(pieces[keys[i]][2] for i in asked)
        refine = [keys[i] for i in asked if pieces[keys[i]][2] == wide][:_REFINED]
        inside = F.shiftright("group_key", wide).isin([k >> wide for k in refine])
        shift = max(0, wide - _MORE_BITS)
        fresh = _ranges(groups.where(inside), shift)
        gone = set(refine)
        pieces = {k: v for k, v in pieces.items() if k not in gone}
        pieces |= {k: (*v, shift) for k, v in fresh.items()}
    return []


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shard(
    docs: DataFrame, scratch: Scratch, shards: int = 40, carry: list[Column] | None = None
) -> DataFrame:
    """`row` (the columns to `carry`, by default all), `size`, `shard`, `slot`.

    Size: UTF-8 bytes plus 16; a null text counts 16 and is a group apart from empty ones.
    Slots number the documents of a shard from 0 in the order of text hash and doc_id, null
    first; which of two equal rows comes first makes no difference. With fewer groups than
    shards some shards stay empty. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*(carry or ["*"])).alias("row"), F.xxhash64("text").alias("group_key"),
        _size(F.col("text")).alias("size"), "doc_id",
    )
    groups = scratch.keep(
        rows.groupBy("group_key").agg(F.sum("size").alias("group_size")), "groups"
    )
    left, rest = shards, groups.agg(F.sum("group_size")).first()[0] or 0
    alone, top = [], groups.orderBy(F.desc("group_size"), "group_key").limit(shards).collect()
    while top and left > 1 and top[0].group_size > rest / left:
        rest, left = rest - top[0].group_size, left - 1
        alone.append(top.pop(0).group_key)
    others = groups.where(~F.col("group_key").isin(alone)) if alone else groups
    cuts = cut_keys(others, left, top[0].group_size if top else 0)

    key = F.col("group_key")
    number = reduce(lambda a, c: a + (key >= c).cast("int"), cuts, F.lit(0))
    for i, k in enumerate(alone):
        number = F.when(key == k, left + i).otherwise(number)
    placed = rows.withColumn("shard", number.cast("int"))
    return numbered_in_order(
        placed, ["shard", "group_key", "doc_id"], scratch, "placed", within="shard"
    ).select("row", "size", "shard", F.col("place").alias("slot"))
