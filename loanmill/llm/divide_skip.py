"""Near-duplicate links and groups by T-occurrence search over shingle lists.

Documents with equal shingle sets form a class; classes are linked where their sets overlap
enough. A class of n shingles needs T = ceil(n * least / 100) common ones with any partner.

Inverted lists. In any order of shingles common to all, two partners share at least c of
their first n - T + c shingles. The order here puts shingles of many documents last, so the
lists of that prefix are short. Their entries are dealt by shingle range, packed; shingles
of a single class leave here, which is nearly all of them.

Order and place also bound the overlap: shingles before the first ones a class shares with
anybody are lost to all. Classes left without room for enough drop out, which leaves few
that merely quote the same passage.

Search. Groups of near copies are joined first, so that a group of thousands isn't compared
pair by pair: in a few rounds, each list asks for one class only, the one whose shingles are
shared most, and each component found so far checks the class it meets most often. Then
every class asks, in the lists that still hold different components, and misses no link
between them. A query sets its longest lists aside (DivideSkip), heap-merges the others, and keeps the
classes that occur c less the lists set aside times. The rest of the count, long lists
included, is probed by binary search in the candidate's own sorted shingles, which asks the
same as probing the lists. Lists are cut by ranges of partners, so none is a task's burden.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanmill.llm.base import ship
from loanmill.llm.links import components
from loanmill.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from loanmill.llm.wordbytes import mixed, shingle_sets
from loanmill.sources.scratch import Scratch

# A shingle of more documents goes to the end of the order; so many of them are remembered,
# the most frequent ones. Any such set gives the same links.
HEAVY, HEAVY_KEPT = 64, 1 << 20
# Shingles a task gathers before it packs them, and shingles of a range.
_FLUSH, _RANGE = 1 << 19, 1 << 19
# Rows of two numbers that are sent to every task, about 50 MB; more are dealt by key.
_SENT = 1_000_000
# Rounds of joining before the full search, at most. Any number gives the same groups.
_JOINING = 3
# Classes of a list that one search row holds.
_PIECE = 2048
# Weight of the list length in DivideSkip's choice of how many lists to set aside.
_MU = 0.2


def needed(n, least: int):
    """Shingles a set of n must share with a partner of any size."""
    return -(-n * least // 100)


def hits(n, least: int):
    """c: shingles that a set of n shares, at least, among the first n - T + c of its order."""
    return 1 + needed(n, least) // 8


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class_key(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return None, None
    with np.errstate(over="ignore"):
        first = mixed(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))
        second = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(_signed(mixed(first))[0]), int(_signed(mixed(second))[0])


def _new_classes(texts: Iterator[pa.Array], seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Key and shingles of each class, once a task: copies that a task meets count as one."""
    met = set()
    for s in (s for column in texts for s in shingle_sets(column, seed)):
        key = _class_key(s)
        if len(s) and key not in met:
            met.add(key)
            yield key[0], s


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _members(docs: DataFrame, seed: int) -> DataFrame:
    """`doc_id`, `text_key`, `n`, `cid`, `check`; the last two null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_class_key(s)) for s in shingle_sets(batch.column(2), seed)]
            n, cid, check = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, cid, check))],
                names=["doc_id", "text_key", "n", "cid", "check"],
            )

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, n long, cid long, check long")


def _range_bits(total: int) -> int:
    return max(0, math.ceil(math.log2(max(1, total) / _RANGE)))


def _by_range(shingles: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted shingles that fall into the same of 2^bits ranges."""
    place = np.zeros(len(shingles), np.int64)
    if bits:
        place = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(place[a]), slice(a, b)


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names
    )


def _flushed(gathered: Iterator, size_of, out) -> Iterator[pa.RecordBatch]:
    """Hands what was gathered to `out` whenever it is enough, and at the end."""
    held, size = [], 0
    for x in gathered:
        held.append(x)
        size += size_of(x)
        if size >= _FLUSH:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _heavy(docs: DataFrame, total: int, seed: int) -> tuple[np.ndarray, np.uint64]:
    """The shingles that most documents hold, sorted, and how many last bits they lack."""
    bits = _range_bits(total)
    low = np.uint64(max(0, 32 - bits))

    def out(held):
        every = np.sort(np.concatenate(held))
        rows = [(k, pack_sorted(every[part] >> low)) for k, part in _by_range(every, bits)]
        return _batch(["part", "packed"], rows, [pa.int64(), pa.binary()])

    def packed(batches):
        classes = _new_classes((batch.column(0) for batch in batches), seed)
        return _flushed((s for _, s in classes), len, out)

    def frequent(frame: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([unpack_sorted(x) for x in frame["packed"]])
        values, counts = np.unique(every, return_counts=True)
        often = counts > HEAVY
        return pd.DataFrame({"shingle": _signed(values[often]), "docs": counts[often]})

    top = (
        docs.select("text").mapInArrow(packed, "part long, packed binary")
        .groupBy("part").applyInPandas(frequent, "shingle long, docs long")
        .orderBy(F.desc("docs"), "shingle").limit(HEAVY_KEPT).select("shingle").toArrow()
    )
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64)), low


def _shared(docs: DataFrame, total: int, seed: int, least: int) -> DataFrame:
    """`shingle`, `cid`, `pos` (place in the class's order) of the prefixes, for the shingles
    in whose list two classes or more stand.
    """
    heavy, low = _heavy(docs, total, seed)
    known = docs.sparkSession.sparkContext.broadcast(heavy)
    bits = _range_bits(total // 4)

    def prefix(s: np.ndarray) -> np.ndarray:
        often, late = known.value, np.zeros(len(s), bool)
        if len(often):
            cut = s >> low
            late = often[np.minimum(np.searchsorted(often, cut), len(often) - 1)] == cut
        length = len(s) - needed(len(s), least) + hits(len(s), least)
        return np.concatenate([s[~late], s[late]])[:length]

    def out(held):
        shingles = np.concatenate([s for _, s in held])
        owner = np.repeat(np.array([cid for cid, _ in held]), [len(s) for _, s in held])
        pos = np.concatenate([np.arange(len(s)) for _, s in held])
        order = np.lexsort((owner, shingles))
        shingles, owner, pos = shingles[order], owner[order], pos[order]
        rows = []
        for key, part in _by_range(shingles, bits):
            names, place = np.unique(owner[part], return_inverse=True)
            packed = pack_sorted(shingles[part]), pack(place), names.tobytes(), pack(pos[part])
            rows.append((key, *packed))
        kinds = [pa.int64()] + [pa.binary()] * 4
        return _batch(["part", "packed", "place", "names", "pos"], rows, kinds)

    def packed(batches):
        classes = _new_classes((batch.column(0) for batch in batches), seed)
        return _flushed(((cid, prefix(s)) for cid, s in classes), lambda x: len(x[1]), out)

    def lists(frame: pd.DataFrame) -> pd.DataFrame:
        shingles = np.concatenate([unpack_sorted(x) for x in frame["packed"]])
        owner = np.concatenate(
            [
                np.frombuffer(names, np.int64)[unpack(place).astype(np.int64)]
                for names, place in zip(frame["names"], frame["place"])
            ]
        )
        pos = np.concatenate([unpack(x) for x in frame["pos"]]).astype(np.int64)
        order = np.lexsort((owner, shingles))
        shingles, owner, pos = shingles[order], owner[order], pos[order]
        # Several tasks may have met a class.
        fresh = np.r_[True, (np.diff(shingles) != 0) | (np.diff(owner) != 0)]
        shingles, owner, pos = shingles[fresh], owner[fresh], pos[fresh]
        _, which, sizes = np.unique(shingles, return_inverse=True, return_counts=True)
        several = sizes[which] > 1
        columns = _signed(shingles[several]), owner[several], pos[several]
        return pd.DataFrame(dict(zip(("shingle", "cid", "pos"), columns)))

    blobs = "part long, packed binary, place binary, names binary, pos binary"
    return (
        docs.select("text").mapInArrow(packed, blobs)
        .groupBy("part").applyInPandas(lists, "shingle long, cid long, pos long")
    )


def _small(rows: DataFrame) -> DataFrame:
    """Written ids or pairs, to be sent to every task if they are few enough."""
    return F.broadcast(rows) if rows.count() <= _SENT else rows


def _sets(docs: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """`id`, `shingles` (sorted, as bytes) of the classes in `wanted` (`cid`, `text_key` of one of
    its texts, `id`)."""

    def out(held):
        rows = [(cid, s.tobytes()) for cid, s in held]
        return _batch(["cid", "shingles"], rows, [pa.int64(), pa.binary()])

    def run(batches):
        classes = _new_classes((batch.column(0) for batch in batches), seed)
        return _flushed(classes, lambda x: len(x[1]), out)

    keyed = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    texts = keyed.join(_small(wanted.select("text_key")), "text_key", "left_semi")
    made = texts.select("text").mapInArrow(run, "cid long, shingles binary")
    # Texts whose keys collide also bring sets nobody asked for.
    asked = made.join(_small(wanted.select("cid", "id")), "cid")
    return asked.groupBy("id").agg(F.first("shingles").alias("shingles"))


def _linked(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (`a`, `b`) whose sets overlap enough: a's shingles are probed in b's."""

    def probe(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                small, large = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= least * (len(small) + len(large) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    of_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    few = _small(pairs)
    of_b = of_b.join(few.select("b"), "b", "left_semi")
    return few.join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(
        probe, "a long, b long"
    )


def _can_link(n: Column, room: Column, m: Column, other_room: Column, least: int) -> Column:
    """Whether sets of n and m shingles can overlap enough, with no more in common than
    either has room for."""
    return F.least(room, other_room) * (100 + least) >= (n + m) * least


def _hits(n: Column, least: int) -> Column:
    return F.floor(F.ceil(n * least / 100) / 8) + 1


def _merge_lists(least: int):
    """Per search row the partners met in enough of the lists that are not set aside.

    A list comes as partners and, packed in one number each, their sizes and the place of
    the list's shingle in their order. Lists are merged in the order of the query's own
    shingles; at the last one met, what both sides have left bounds the overlap, too.
    """

    def run(batches):
        for batch in batches:
            rows = []
            # One row at a time as Python numbers: a batch of long lists is large.
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                lists = [
                    zip(x["partners"], repeat(x["pos"]), x["facts"]) for x in row["lists"]
                ]
                for partner, met in groupby(heapq.merge(*lists), key=itemgetter(0)):
                    met = list(met)
                    _, i, fact = met[-1]
                    m, j = fact >> 32, fact & 0xFFFFFFFF
                    common = len(met) + row["aside"] + min(row["n"] - i, m - j) - 1
                    if len(met) >= row["enough"] and common * (100 + least) >= (row["n"] + m) * least:
                        rows.append((row["id"], partner))
            yield _batch(["a", "b"], rows, [pa.int64(), pa.int64()])

    return run


def _best_pairs(entries: DataFrame, least: int) -> DataFrame:
    """Per label the pair that meets most often of one of its classes and a list's top class.

    Every list has one top class, the one whose shingles are shared most, and asks for that
    one only, so the pairs met are no more than the entries.
    """
    top = entries.groupBy("shingle").agg(
        F.max(F.struct("share", "id", "n", "room", "label")).alias("top")
    )
    asked = top.select(
        "shingle", F.col("top.id").alias("b"), F.col("top.n").alias("m"),
        F.col("top.room").alias("other_room"), F.col("top.label").alias("of"),
    )
    can = _can_link(F.col("n"), F.col("room"), F.col("m"), F.col("other_room"), least)
    return (
        entries.join(asked, "shingle")
        .where((F.col("label") != F.col("of")) & can)
        .groupBy("label", F.col("id").alias("a"), "b")
        .agg(F.count("*").alias("met"), F.first(F.least("n", "m")).alias("n"))
        .where(F.col("met") >= _hits(F.col("n"), least))
        .groupBy("label")
        .agg(F.max(F.struct("met", "a", "b")).alias("best"))
        .select("best.a", "best.b")
        .distinct()
    )


def _open_lists(entries: DataFrame) -> DataFrame:
    """The lists that still hold two labels, with their `length`."""
    several = (
        entries.groupBy("shingle")
        .agg(F.count("*").alias("length"), F.min("label").alias("l"), F.max("label").alias("h"))
        .where("l <> h")
        .select("shingle", "length")
    )
    return entries.join(several, "shingle")


def _search(open_lists: DataFrame, least: int) -> DataFrame:
    """Pairs of different labels (`a` < `b`) that meet often enough, by DivideSkip."""
    longest = open_lists.agg(F.max("length")).first()[0] or 0
    pieces = -(-longest // _PIECE)
    if not pieces:
        return open_lists.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    piece = F.pmod(F.xxhash64("id"), F.lit(pieces))

    # c for the smallest partner; of that many meetings, those in the lists set aside may lack.
    met = _hits(F.ceil(F.col("n") * least / 100), least)
    aside = F.least(met - 1, F.floor(met / (_MU * F.log2(F.max("length") + 1) + 1)))
    asking = (
        open_lists.groupBy("id", "label", "n", "room")
        .agg(
            F.sort_array(F.collect_list(F.struct("length", "shingle", "pos"))).alias("all"),
            aside.cast("int").alias("aside"),
        )
        .where(F.size("all") >= met)
        .select(
            "id", "label", "n", "room", "aside", (met - F.col("aside")).alias("enough"),
            F.explode(
                F.slice("all", 1, F.greatest(F.lit(0), F.size("all") - F.col("aside")))
            ).alias("list"),
        )
        .select("id", "label", "n", "room", "aside", "enough", "list.shingle", "list.pos")
    )
    held = (
        open_lists.groupBy("shingle", piece.alias("piece"))
        .agg(F.sort_array(F.collect_list(F.struct("id", "label", "n", "room", "pos"))).alias("held"))
    )

    def fitting(y):
        other = (y["label"] != F.col("label")) & (y["id"] > F.col("id"))
        return other & _can_link(F.col("n"), F.col("room"), y["n"], y["room"], least)

    partners = F.transform("list", lambda y: y["id"])
    facts = F.transform("list", lambda y: F.shiftleft(y["n"], 32) + y["pos"])
    searches = (
        asking.join(held, "shingle")
        .withColumn("list", F.filter("held", fitting))
        .where(F.size("list") > 0)
        .select(
            "id", "n", "aside", "enough", "piece",
            F.struct("pos", partners.alias("partners"), facts.alias("facts")).alias("list"),
        )
        .groupBy("id", "n", "aside", "enough", "piece")
        .agg(F.collect_list("list").alias("lists"))
        .where(F.size("lists") >= F.col("enough"))
        .drop("piece")
    )
    return searches.mapInArrow(_merge_lists(least), "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, least: int = 80) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` (smallest doc_id reachable by links) per row; also
    `text_key` (of its text) and `group`, the same for just the rows of one component and null
    without shingles.

    Two documents link when 100 * |common shingles| >= `least` * |all shingles of both|.
    Documents without words, or null, have no shingles and stand alone. A null doc_id links as
    any other and names no component while there is another; one of nulls only is named null.
    Rows with equal texts are in one component. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    for seed in range(8):
        members = scratch.keep(_members(docs, seed), f"members_{seed}")
        classes = scratch.keep(
            members.where("cid IS NOT NULL").groupBy("cid", "check")
            .agg(
                F.min("doc_id").alias("rep"), F.max("n").alias("n"),
                F.min("text_key").alias("text_key"),
            ),
            f"classes_{seed}",
        )
        row = classes.agg(F.count("*").alias("all"), F.countDistinct("cid").alias("ids")).first()
        if row["all"] == row["ids"]:
            break
    else:
        raise RuntimeError("different sets of shingles share a key under every seed")
    total = members.agg(F.sum("n")).first()[0] or 0

    shared = scratch.keep(_shared(docs, total, seed, least), "shared")
    n = F.col("n")
    prefix_size = n - F.ceil(n * least / 100) + _hits(n, least)
    # A partner shares c shingles of the prefix or more, so none before the c-th that any
    # other class has there, but for the c - 1 shared ones: that is the room for an overlap.
    few = _hits(F.ceil(n * least / 100), least)
    nth = F.get(F.sort_array("places"), (few - 1).cast("int"))
    active = (
        shared.groupBy("cid").agg(F.collect_list("pos").alias("places"))
        .join(classes, "cid")
        .where(F.size("places") >= few)
        .select(
            "cid", "rep", "text_key", "n", (F.size("places") / prefix_size).alias("share"),
            (n - nth + few - 1).alias("room"),
        )
        .where(F.col("room") >= F.ceil(n * least / 100))
        # Written ids close together pack better than keys.
        .withColumn("id", F.monotonically_increasing_id())
    )
    active = scratch.keep(active, "active")
    entries = scratch.keep(shared.join(active.drop("rep", "text_key"), "cid").drop("cid"), "entries")
    sets = scratch.keep(_sets(docs, active, seed), "sets")

    links, tried, current = None, None, entries.withColumn("label", F.col("id"))
    for step in range(_JOINING):
        pairs = _best_pairs(current, least)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"pairs_{step}")
        tried = pairs if tried is None else tried.union(pairs)
        new = scratch.keep(_linked(pairs, sets, least), f"links_{step}")
        if step and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        labels = components(links, scratch.inner(f"near_{step}"))
        current = entries.join(labels, "id", "left").withColumn(
            "label", F.coalesce("label", "id")
        )
        current = scratch.keep(_open_lists(current), f"open_{step}").drop("length")
    current = scratch.keep(_open_lists(current), "open")
    pairs = scratch.keep(_search(current, least), "pairs")
    more = scratch.keep(_linked(pairs, sets, least), "links")
    labels = components(links.union(more), scratch.inner("near"))

    grouped = active.join(labels, "id").select("cid", "rep", "label")
    first = grouped.groupBy("label").agg(
        F.min("rep").alias("component_id"), F.min("cid").alias("group")
    )
    grouped = grouped.join(first, "label").select("cid", "component_id", "group")
    alone = F.col("group").isNull()
    named = classes.join(grouped, "cid", "left").select(
        "cid", F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("group", "cid").alias("group"),
    )
    named = scratch.keep(named, "named")
    return members.join(named, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "text_key", "group",
    )
