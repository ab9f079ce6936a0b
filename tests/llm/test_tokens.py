"""Encoding by fragments and alignment of tokenizers, against the libraries and plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edge import frame, odd_rows
from tokenizers import Tokenizer

from loanmill.llm import bpe_fragments, queries, token_links
from loanmill.sources.scratch import Scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"

ODD = [
    *" \t\n\r\x0b\x0c 　 \x85\x1c'sdmlrtve.,!?0129abXYZ", "é", "ß", "中文", "한", "ไทย", "अ",
    "😀", "👍🏽", "‍", "\x00", "\x7f", "<|endoftext|>", "<|", "|>", "'ll", "'re", "hello", " world",
    "▁", "<s>", "<0x41>", "ﬁ", "́", "Ⅳ",
]


@pytest.fixture
def scratch(spark, folder):
    return Scratch(spark, folder)


def odd_texts(n, longest=40):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def library(specials=True):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = not specials
    return tokenizer


def described():
    with open(BYTES, encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("short, stretch", [(64, 1 << 17), (0, 1 << 17), (3, 2)])
def test_fragments_give_the_library_s_ids(monkeypatch, specials, short, stretch):
    monkeypatch.setattr(bpe_fragments, "_SHORT", short)
    monkeypatch.setattr(bpe_fragments, "_STRETCH", stretch)
    monkeypatch.setattr(bpe_fragments, "_KNOWN", 50)
    codec, tokenizer = bpe_fragments.Codec(described(), specials), library(specials)
    for text in odd_texts(1500):
        ids = codec.encode(text.encode())
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == text


def test_any_ids_are_decoded_as_by_the_library():
    codec, tokenizer, rng = bpe_fragments.Codec(described()), library(), random.Random(6)
    for _ in range(1500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 10))]
        assert codec.decode(np.array(ids, "<u4")) == tokenizer.decode(ids, skip_special_tokens=False)


def test_cuts_lie_between_bytes_that_no_token_joins():
    codec = bpe_fragments.Codec(described())
    inside = {t[i : i + 2] for t in codec.bytes_of for i in range(len(t) - 1)}
    assert all(bytes(divmod(i, 256)) not in inside for i in np.flatnonzero(codec.cuts_text))
    data = "one two  three\n\nfour  five <|endoftext|> ".encode()
    edges = codec.fragments(data).tolist()
    assert [data[a:b] for a, b in zip(edges, edges[1:])] == [
        b"one", b" two", b"  three", b"\n\nfour\xc2\xa0 five", b" <|endoftext|>", b" ",
    ]


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError, match="no byte-level BPE"):
        bpe_fragments.Codec(described().replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'))


def test_encode_and_decode_odd_rows(spark):
    rows = odd_rows() + [(100 + i, t, "x") for i, t in enumerate(odd_texts(60))]
    docs = frame(spark, rows)
    encoded = bpe_fragments.encode(docs, BYTES)
    decoded = bpe_fragments.decode(encoded.select("row.doc_id", "row.label", "ids", "n_tokens"), BYTES).collect()
    tokenizer = library()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want[doc_id, np.array(ids, "<u4").tobytes(), len(ids), text or "", "extra label"] += 1
    got = Counter((r.row.doc_id, bytes(r.row.ids), r.row.n_tokens, r.decoded, r.row.label) for r in decoded)
    assert got == want
    assert encoded.limit(0).count() == 0 == bpe_fragments.encode(docs.limit(0), BYTES).count()


def test_null_ids_give_a_null_text(spark):
    rows = spark.createDataFrame([(1, None), (2, b"")], "i int, ids binary")
    assert {(r.row.i, r.decoded) for r in bpe_fragments.decode(rows, BYTES).collect()} == {(1, None), (2, "")}


def test_encode_query(spark):
    tokenizer = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op11_bpe_fragments(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# --- alignment ---------------------------------------------------------------------------


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def plain_alignment(texts):
    """Per text its measures, by comparing every token with every other of its text."""
    first, second = library(False), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {ord(c): i for i, c in enumerate(bpe_fragments.byte_letters())}
    vocabulary = {i: bytes(byte_of[ord(c)] for c in t) for t, i in first.get_vocab(False).items()}
    table = token_links.piece_bytes(second)
    aligned, docs = [], Counter()
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        sides = [vocabulary[i] for i in a], [table[i] for i in b]
        if not text or any(b"".join(s) != whole for s in sides):
            aligned.append(None)
            continue
        at_a, at_b = map(spans, sides)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, start = [], 0
        for end in both:
            inside = [[str(x) for x, (s, e) in zip(ids, at) if start <= s and e <= end] for ids, at in ((a, at_a), (b, at_b))]
            groups.append(",".join(inside[0]) + "|" + ",".join(inside[1]))
            start = end
        aligned.append((len(a), len(b), links, ";".join(groups), len(groups)))
        docs.update(set(links))
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    for x in aligned:
        if x is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, links, groups, n = x
            yield (
                n_a, n_b, n, len(links), sum(docs[p] == highest[p[0]] for p in links),
                sum(docs[p] for p in links), hashlib.sha256(groups.encode()).hexdigest(),
            )


def measures(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_alignment_of_odd_rows(spark, monkeypatch, scratch, block):
    monkeypatch.setattr(token_links, "_BLOCK", block)
    texts = odd_texts(150, 12) + ["Some words, some more words.", "naïve café 日本"] * 3
    rows = [r for r in odd_rows() if r[0] != 10] + [(100 + i, t, "x") for i, t in enumerate(texts)]
    got = token_links.align(frame(spark, rows), BYTES, PIECES, scratch).select("row.doc_id", "row.copies", "*").collect()
    want = Counter((r[0], m) for r, m in zip(rows, plain_alignment([t for _, t, _ in rows])))
    assert Counter((r.doc_id, measures(r)) for r in got) == want
    assert any(m[0] and m[2] < min(m[:2]) for _, m in want) and any(not m[0] for _, m in want)


def test_alignment_of_an_empty_table(spark, scratch):
    docs = frame(spark, odd_rows()).limit(0)
    assert token_links.align(docs, BYTES, PIECES, scratch).count() == 0


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: measures(r) for r in queries.op13_token_links(spark, SMALL).collect()}
    short = [r for r in rows if len(r.text or "") < 3000]
    assert len(got) == len(rows) and len(short) > 100
    # Counts are of the whole table, so only what doesn't hang on them is compared text by text.
    for r, m in zip(short, plain_alignment([r.text for r in short])):
        assert got[r.doc_id][:4] == m[:4] and got[r.doc_id][6] == m[6]
        assert got[r.doc_id][5] >= m[5]
