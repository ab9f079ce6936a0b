"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be met with k = m // `per_error` errors (edits) anywhere in a
document. Cut into k + 1 pieces, one of them is met unchanged, so only places around exact
piece hits can match; these are found by one Aho-Corasick automaton over all pieces. Each
such place is verified with Myers' bit-parallel distance, one machine step per character
and item. Case, punctuation and spacing are levelled first, on both sides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanmill.llm.base import ship

# Characters of items one pass over the documents looks for; more items take more passes.
_BLOCK = 4_000_000

_APART = re.compile(r"[\W_]+")
_TOKEN = re.compile(r"[^\W_]+")


def levelled(text: str) -> str:
    return _APART.sub(" ", text.lower()).strip()


def closest(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(errors, end) of the first best match of the whole pattern within the text (Myers)."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, last = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, errors = full, 0, len(pattern)
    best = None
    for end, c in enumerate(text, 1):
        match = where.get(c, 0)
        vertical = match | down
        diagonal = (((match & up) + up) ^ up) | match
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        if rise & last:
            errors += 1
        elif fall & last:
            errors -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        if errors <= most and (best is None or errors < best[0]):
            best = errors, end
    return best


@dataclass(frozen=True)
class Match:
    item: int
    errors: int
    start: int
    end: int


class Finder:
    """The pieces of a block of items, ready to search."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        self.items, self.pieces = [], defaultdict(list)
        for item_id, text in items:
            pattern = levelled(text)
            if not pattern:
                continue
            most = len(pattern) // per_error
            cuts = [round(i * len(pattern) / (most + 1)) for i in range(most + 2)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces[pattern[a:b]].append((len(self.items), a))
            self.items.append((item_id, pattern, most))
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def _places(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): where the item can begin, hits of nearby diagonals together."""
        begins = defaultdict(set)
        for end, piece in self.automaton.iter(text):
            for which, offset in self.pieces[piece]:
                begins[which].add(end + 1 - len(piece) - offset)
        for which, found in begins.items():
            reach = self.items[which][2]
            group = None
            for begin in sorted(found):
                if group and begin - group[1] <= 2 * reach:
                    group[1] = begin
                    continue
                if group:
                    yield which, *group
                group = [begin, begin]
            yield which, *group

    def find(self, text: str) -> list[Match]:
        """The best match of every item in a levelled text, in the order of the items."""
        best: dict[int, Match] = {}
        for which, first, last in self._places(text) if self.items and text else ():
            item_id, pattern, most = self.items[which]
            a, b = max(0, first - most), last + len(pattern) + most
            found = closest(pattern, text[a:b], most)
            if found is None:
                continue
            errors, end = found
            # Backwards from its end, the match is the one with as few errors.
            back = closest(pattern[::-1], text[a : a + end][::-1], errors)
            match = Match(item_id, errors, a + end - back[1], a + end)
            held = best.get(which)
            if held is None or (match.errors, match.start) < (held.errors, held.start):
                best[which] = match
        return [best[which] for which in sorted(best)]


def _span(text: str, plain: str, match: Match) -> tuple[int, int]:
    """The match in the text as it was: from its first to its last word."""
    first = plain.count(" ", 0, match.start + (plain[match.start] == " "))
    last = plain.count(" ", 0, match.end - (plain[match.end - 1] == " "))
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return spans[min(first, len(spans) - 1)][0], spans[min(last, len(spans) - 1)][1]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    for row in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        block.append((row.item_id, row.text))
        size += len(row.text)
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, per_error: int = 12) -> DataFrame:
    """`doc_id`, `item_id`, `errors`, `start`, `end` (code points): each item's best match per row.

    Null and empty texts match nothing, nor do items without letters or digits. Items that
    repeat are matched each for itself, as are documents that repeat; a document without a
    match has no row. Without documents or items there are no rows.
    """
    ship(docs.sparkSession)
    kind = "doc_id long, item_id long, errors int, start int, end int"

    def finding(block):
        def run(batches):
            finder = Finder(block, per_error)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    plain = levelled(text or "")
                    for m in finder.find(plain):
                        rows.append((doc_id, m.item, m.errors, *_span(text, plain, m)))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64()] * 2 + [pa.int32()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "item_id", "errors", "start", "end"],
                )

        return run

    found = docs.sparkSession.createDataFrame([], kind)
    for block in _blocks(items):
        found = found.union(docs.select("doc_id", "text").mapInArrow(finding(block), kind))
    return found


def clean(docs: DataFrame, items: DataFrame, per_error: int = 12) -> DataFrame:
    """The documents in which no item is met, with all their columns."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), "text")

    def keeping(block):
        def run(batches):
            finder = Finder(block, per_error)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                keep = [not finder.find(levelled(text or "")) for text in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for block in _blocks(items):
        rows = rows.mapInArrow(keeping(block), rows.schema)
    return rows.select("row.*")
