"""Byte-level BPE by forced boundaries: texts to token ids and back.

Two adjacent bytes that stand side by side in no token of the vocabulary can never be merged,
so the place between them is a certain cut: what lies on either side is encoded by itself and
the ids are put one after the other. The vocabulary alone tells these pairs, in one table of
256 x 256.

The pattern that the tokenizer splits texts with looks at neighbours too. Between a printable
ASCII character and white space it always splits, whatever stands around, and that is where
texts are cut first. The fragments, nearly words, repeat: each distinct one of a task is encoded
once. A long fragment, as of a script without spaces, is split as the tokenizer does and its
pieces are cut at all certain cuts. Texts are worked through in stretches of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanmill.llm.base import ship

# Fragments worked on at a time, fragments remembered, and bytes of one worth remembering.
_STRETCH, _KNOWN, _SHORT = 1 << 17, 1 << 19, 64
# Rows handed on together.
_ROWS = 512


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable,
    otherwise the next one from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    letters = dict(zip(shown, map(chr, shown))) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes with the tokenizer of a JSON description.

    With `specials` the strings of special tokens in a text become those tokens, otherwise
    they are text like any other.
    """

    def __init__(self, description: str, specials: bool = True):
        from tokenizers import Tokenizer

        parts = json.loads(description)
        split = parts["pre_tokenizer"] or {}
        if (parts["model"]["type"], split.get("type"), split.get("use_regex")) != ("BPE", "ByteLevel", True):
            raise ValueError("no byte-level BPE")
        if parts["normalizer"] or parts["post_processor"] or split.get("add_prefix_space"):
            raise ValueError("fragments can't be encoded apart if texts are changed first")
        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not specials
        byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = [s for s in added.values() if s] if specials else []
        size = max([*vocabulary.values(), *added]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(byte_of[ord(c)] for c in token)
        for i, content in added.items():
            self.bytes_of[i] = content.encode()

        self.inside = np.zeros(1 << 16, bool)
        for token in self.bytes_of:
            b = np.frombuffer(token, np.uint8).astype(np.uint16)
            self.inside[(b[:-1] << 8) | b[1:]] = True
        left, right = np.divmod(np.arange(1 << 16), 256)
        printable = (left > 0x20) & (left < 0x7F)
        white = (right == 0x20) | ((right >= 0x09) & (right <= 0x0D))
        self.cuts_text = ~self.inside & printable & white
        letters = byte_letters()
        self._apart = {letters[a] + letters[b] for a, b in zip(left, right) if not self.inside[a << 8 | b]}
        self._before_space = self.cuts_text[0x20::256].tolist()
        self.lengths = np.array([len(token) for token in self.bytes_of])
        self.known: dict[bytes, bytes] = {}

    def _pieces(self, piece: str) -> Iterator[str]:
        """A piece in byte letters, cut wherever two neighbours are inside no token."""
        start = 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] in self._apart:
                yield piece[start:i]
                start = i
        yield piece[start:]

    def _encode_long(self, fragment: bytes) -> list[int]:
        text = fragment.decode()
        if any(s in text for s in self.specials):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        tokenize = self.tokenizer.model.tokenize
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [t.id for piece, _ in split for part in self._pieces(piece) for t in tokenize(part)]

    def _learn(self, fragments: list[bytes]) -> None:
        # Those that begin with a space go through the library in one string, where each joint
        # is a certain cut again; the lengths of the tokens tell whose they are.
        alike, others = [], []
        for x in fragments:
            fits = len(x) <= _SHORT and x[0] == 0x20 and self._before_space[x[-1]]
            (alike if fits else others).append(x)
        for x in others:
            self.known[x] = np.array(self._encode_long(x), "<u4").tobytes()
        if alike:
            whole = b"".join(alike).decode()
            found = self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(x) for x in alike]))
            packed, at = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            for x, i, j in zip(alike, at, at[1:]):
                self.known[x] = packed[i:j]

    def fragments(self, data: bytes) -> np.ndarray:
        """Where the fragments of a text begin and the last one ends."""
        b = np.frombuffer(data, np.uint8).astype(np.uint16)
        cuts = np.flatnonzero(self.cuts_text[(b[:-1] << 8) | b[1:]]) + 1
        return np.concatenate([[0], cuts, [len(data)]]) if len(data) else np.zeros(1, np.int64)

    def ids(self, data: bytes) -> Iterator[np.ndarray]:
        """The ids of a text in UTF-8, stretch by stretch; those of short fragments are kept."""
        edges = self.fragments(data)
        for first in range(0, len(edges) - 1, _STRETCH):
            at = edges[first : first + _STRETCH + 1].tolist()
            parts = [data[a:b] for a, b in zip(at, at[1:])]
            known = self.known
            new = list(set(parts).difference(known))
            self._learn(new)
            yield np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")
            for x in new:
                if len(x) > _SHORT:
                    del known[x]
            if len(known) > _KNOWN:
                known.clear()

    def encode(self, data: bytes) -> np.ndarray:
        found = list(self.ids(data))
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def _codec(_digest: str, specials: bool, read: Callable[[], str]) -> Codec:
    return Codec(read(), specials)


class Sent:
    """A tokenizer's description, sent to every worker, which builds one codec of it."""

    def __init__(self, spark, path: str, specials: bool = True):
        with open(path, encoding="utf-8") as file:
            description = file.read()
        Codec(description, specials)
        self._sent = spark.sparkContext.broadcast(description)
        self._digest = hashlib.sha256(description.encode()).hexdigest()
        self._specials = specials

    def codec(self) -> Codec:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        return _codec(self._digest, self._specials, _Reader(self._sent))


class _Reader:
    """Reads what was sent; all are alike to the cache, which tells them by the digest."""

    def __init__(self, sent):
        self._sent = sent

    def __call__(self) -> str:
        return self._sent.value

    def __eq__(self, other) -> bool:
        return isinstance(other, _Reader)

    def __hash__(self) -> int:
        return 0


def encode(docs: DataFrame, path: str, specials: bool = True, check: bool = False) -> DataFrame:
    """`row` (the columns of `docs`), `ids` (unsigned 32-bit little-endian) and `n_tokens` of
    the column `text`, as the tokenizer file at `path` has them without added special tokens.
    With `check`, also `decoded`, the text that the ids stand for.

    A null text counts as empty and has no ids; any other columns may be null and bear any
    names; every row comes back, equal ones too. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    sent = Sent(docs.sparkSession, path, specials)

    def run(texts: pa.Array) -> list[pa.Array]:
        codec, ids, decoded = sent.codec(), [], []
        for text in texts:
            found = codec.encode((text.as_py() or "").encode())
            ids.append(found.tobytes())
            if check:
                decoded.append(codec.decode(found))
        return [pa.array(ids, pa.binary())] + [pa.array(decoded, pa.string())] * check

    made = _mapped(docs, "text", "ids binary" + ", decoded string" * check, run)
    return made.withColumn("n_tokens", F.expr("octet_length(ids) div 4"))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """`row` (the columns of `rows`) and `decoded`, the text of the column `ids`.

    Null ids give a null text, none the empty one. Ids outside of the vocabulary fail.
    """
    ship(rows.sparkSession)
    sent = Sent(rows.sparkSession, path)

    def run(packed: pa.Array) -> list[pa.Array]:
        codec = sent.codec()
        texts = [
            codec.decode(np.frombuffer(ids.as_py(), "<u4")) if ids.is_valid else None for ids in packed
        ]
        return [pa.array(texts, pa.string())]

    return _mapped(rows, "ids", "decoded string", run)


def _mapped(rows: DataFrame, column: str, added: str, of: Callable) -> DataFrame:
    """`row` (all columns) and what `of` makes of the values of `column`, few rows at a time."""
    whole = rows.select(F.struct("*").alias("row"), F.col(column).alias("value"))
    schema = T.StructType([whole.schema["row"], *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                made = [part.column(0), *of(part.column(1))]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return whole.mapInArrow(run, schema)
