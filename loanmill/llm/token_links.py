"""Tokens of two tokenizers aligned over the same bytes, and how often their ids meet.

Texts are shuffled by their full text, so that each distinct one is tokenised and aligned once,
and counts for as many documents as hold it. Both tokenizers cut the bytes of space + text.
Between two neighbouring cuts, of either, lies a part of exactly one token of each, and no pair
of tokens shares two such parts: the parts are the links. Places where both cut end a group.

Pair counts. A task gathers the texts of a block, some four million links, or one long text, and
hands on each id pair of the block once, with the documents that hold it. These are added up over
the corpus, the highest of each A id is looked up, and the counts go back to the blocks that
asked, so what is shuffled are distinct pairs per block, not links. Each block then sums up its
texts, and the sums are joined to the documents by the text's digest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loanmill.llm.base import ship
from loanmill.llm.bpe_fragments import Sent, _Reader
from loanmill.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from loanmill.sources.scratch import Scratch

# Links that a block gathers.
_BLOCK = 1 << 22
# Texts that are tokenised together.
_TOGETHER = 256


def piece_bytes(processor) -> list[bytes]:
    """The bytes behind every id of a sentencepiece model; control pieces have none."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            out.append(b"")
        else:
            out.append(piece.replace("▁", " ").encode())
    return out


class Pieces:
    """The second tokenizer, from the bytes of a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of = piece_bytes(self.processor)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def _pieces(_digest: str, read) -> Pieces:
    return Pieces(read())


class SentPieces:
    """A sentencepiece model, sent to every worker."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as file:
            model = file.read()
        self._sent = spark.sparkContext.broadcast(model)
        self._digest = hashlib.sha256(model).hexdigest()

    def pieces(self) -> Pieces:
        return _pieces(self._digest, _Reader(self._sent))


class Aligner:
    """Tokens and links of texts; the vocabularies' byte lengths and decimal ids as tables."""

    def __init__(self, codec, pieces: Pieces):
        self.codec, self.pieces = codec, pieces
        tables = codec.bytes_of, pieces.bytes_of
        self.lengths = [np.array([len(b) for b in table], np.int64) for table in tables]
        # What is written for an id inside and at the end of its side of a group.
        self.written = [
            [np.array([f"{i}{mark}" for i in range(len(table))], object) for mark in marks]
            for table, marks in zip(tables, (",|", ",;"))
        ]

    def _covers(self, side: int, ids: np.ndarray, data: bytes) -> bool:
        table = (self.codec, self.pieces)[side].bytes_of
        return b"".join(map(table.__getitem__, ids.tolist())) == data

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids of both; none where the text is empty, or the bytes of either's
        tokens aren't those of space + text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for text, b in zip(texts, self.pieces.encode(texts)):
            data = b" " + text.encode()
            b = np.array(b, np.int64)
            if not text or not self._covers(1, b, data):
                yield none
                continue
            a = self.codec.encode(data).astype(np.int64)
            yield (a, b) if self._covers(0, a, data) else none

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int, str]:
        """A id << 32 | B id of every pair of overlapping tokens in order, the number of groups,
        and the groups as `a1,a2|b1;a3|b2,b3`."""
        if not len(a):
            return np.zeros(0, np.int64), 0, ""
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        cuts_a, cuts_b = np.zeros((2, end_a[-1] + 1), bool)
        cuts_a[end_a] = cuts_b[end_b] = True
        every = np.flatnonzero(cuts_a | cuts_b)

        def before(cuts: np.ndarray) -> np.ndarray:
            return np.cumsum(cuts) - cuts

        pairs = a[before(cuts_a[every])] << 32 | b[before(cuts_b[every])]

        last_a, last_b = cuts_b[end_a], cuts_a[end_b]
        group_a, group_b = before(last_a), before(last_b)
        n = int(group_a[-1]) + 1
        upto_a = np.cumsum(np.bincount(group_a, minlength=n))
        of_b = np.bincount(group_b, minlength=n)
        parts = np.empty(len(a) + len(b), object)
        for side, ids, last, place in (
            (0, a, last_a, np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]),
            (1, b, last_b, np.arange(len(b)) + upto_a[group_b]),
        ):
            inside, ending = self.written[side]
            parts[place] = np.where(last, ending[ids], inside[ids])
        return pairs, n, "".join(parts.tolist())[:-1]


def _blocks(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Texts with their links, block by block."""
    held, size = [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, _TOGETHER):
            part = batch.slice(first, _TOGETHER)
            texts, copies = part.column(0).to_pylist(), part.column(1).to_pylist()
            for text, n, (a, b) in zip(texts, copies, aligner.tokens(texts)):
                pairs, n_groups, groups = aligner.links(a, b)
                distinct, times = np.unique(pairs, return_counts=True)
                measures = {
                    "text_key": hashlib.sha256(text.encode()).digest(),
                    "n_a": len(a), "n_b": len(b), "n_groups": n_groups, "n_links": len(pairs),
                    "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
                }
                held.append((measures, n, distinct, times))
                size += len(pairs)
                if size >= _BLOCK:
                    yield _block(held)
                    held, size = [], 0
    if held:
        yield _block(held)


_TEXT = (
    "text_key: binary, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint,"
    " groups_sha256: string"
)
_MEASURES = f"{_TEXT}, n_best: bigint, count_sum: bigint"
_BLOCKS = f"pairs: binary, docs: binary, places: binary, times: binary, texts: array<struct<{_TEXT}>>"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _block(held: list[tuple]) -> dict:
    """One row: the block's distinct pairs, with the documents that hold them; the pairs of its
    texts, each as the text's number times all distinct pairs plus the pair's place among these,
    with the times it occurs; and the texts' measures."""
    sizes = [len(pairs) for *_, pairs, _ in held]
    pairs, place = np.unique(np.concatenate([pairs for *_, pairs, _ in held]), return_inverse=True)
    weights = np.repeat([copies for _, copies, *_ in held], sizes)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(pairs)))
    docs = np.add.reduceat(weights[order], starts) if len(pairs) else weights
    return {
        "pairs": pack_sorted(pairs.astype(np.uint64)),
        "docs": pack(docs.astype(np.uint64)),
        "places": pack_sorted(np.repeat(np.arange(len(held)), sizes) * len(pairs) + place),
        "times": pack(np.concatenate([times for *_, times in held]).astype(np.uint64)),
        "texts": [measures for measures, *_ in held],
    }


def _aligned(docs: DataFrame, first: Sent, second: SentPieces) -> DataFrame:
    """The blocks of the distinct texts."""
    schema = _arrow(_BLOCKS)

    def run(batches):
        aligner = Aligner(first.codec(), second.pieces())
        for block in _blocks(aligner, batches):
            yield pa.RecordBatch.from_pylist([block], schema)

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return texts.groupBy("text").agg(F.count("*").alias("copies")).mapInArrow(run, _BLOCKS)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and distinct pair."""
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = unpack_sorted(batch.column(1)[i].as_py()).view(np.int64)
            block = np.full(len(pairs), batch.column(0)[i].as_py())
            docs = unpack(batch.column(2)[i].as_py()).view(np.int64)
            for j in range(0, len(pairs), 1 << 16):
                part = slice(j, j + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[part]) for x in (block, pairs, docs)], names=["block", "pair", "docs"]
                )


def pair_counts(asked: DataFrame) -> DataFrame:
    """`pair`, `count` (documents holding it) and `best`: whether no other pair of its A id
    has a higher count."""
    counts = asked.groupBy("pair").agg(F.sum("docs").alias("count"))
    highest = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("highest"))
    # One row per id of the A vocabulary at most.
    return counts.join(
        F.broadcast(highest), F.shiftright("pair", 32) == F.col("a")
    ).select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _summed(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Measures per text of a block, given the counts of its pairs."""

    def run(block: pa.Table, facts: pa.Table) -> pa.Table:
        facts = facts.sort_by("pair")
        texts = pa.chunked_array(block.column("texts")).combine_chunks().flatten()
        count = facts.column("count").to_numpy()
        best = facts.column("best").to_numpy().astype(np.int64)
        places = unpack_sorted(block.column("places")[0].as_py()).astype(np.int64)
        times = unpack(block.column("times")[0].as_py()).astype(np.int64)
        owner, place = np.divmod(places, max(1, len(count)))
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        columns = texts.flatten()
        for of in (best, count):
            upto = np.concatenate([[0], np.cumsum(times * of[place])])
            columns.append(pa.array(upto[edges[1:]] - upto[edges[:-1]]))
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def align(docs: DataFrame, byte_path: str, piece_path: str, scratch: Scratch) -> DataFrame:
    """`row` (the columns of `docs`) and the measures of its `text`: n_a, n_b (tokens of the
    byte-level tokenizer and of the pieces), n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or whose tokens don't make up space + text again, has zeros
    and no hash ('') and adds nothing to the counts. Equal rows all come back and all count. Any
    other columns may be null and bear any names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    first, second = Sent(spark, byte_path, specials=False), SentPieces(spark, piece_path)
    blocks = scratch.keep(
        _aligned(docs, first, second).withColumn("block", F.monotonically_increasing_id()), "blocks"
    )
    asked = scratch.keep(
        blocks.select("block", "pairs", "docs").mapInArrow(_asked, "block long, pair long, docs long"),
        "asked",
    )
    counts = scratch.keep(pair_counts(asked), "counts")
    facts = asked.select("block", "pair").join(counts, "pair")
    measures = scratch.keep(
        blocks.select("block", "places", "times", "texts").groupBy("block").cogroup(facts.groupBy("block"))
        .applyInArrow(_summed(_arrow(_MEASURES)), _MEASURES),
        "measures",
    )
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select(F.struct("*").alias("row"), key.alias("text_key"))
    return rows.join(measures, "text_key").drop("text_key")
