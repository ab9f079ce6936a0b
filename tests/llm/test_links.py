"""Near-duplicate groups against brute force, and the parts they are made of."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from edge import frame, odd_rows, prose, words

from loanmill.llm import divide_skip, links, packing, wordbytes
from loanmill.sources.scratch import Scratch


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def groups(rows):
    """(doc_id, n_shingles, component_id) by comparing every pair."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(rows):
        least[find(i)] += [doc_id] if doc_id is not None else []
    return Counter(
        (d, len(s), min(least[find(i)], default=d)) for i, (d, s) in enumerate(zip((r[0] for r in rows), sets))
    )


def found(docs, folder):
    got = divide_skip.near_duplicates(docs, Scratch(docs.sparkSession, folder)).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_odd_rows(spark, folder):
    assert found(frame(spark, odd_rows()), folder) == groups(odd_rows())


@pytest.mark.parametrize("ids", [(None, 7), (7, None), (None, None), (7, 7)])
def test_links_of_null_and_shared_ids(spark, folder, ids):
    near = prose(3, 100).replace("w3x35 ", "changed ")
    rows = [(ids[0], prose(3, 100), "a"), (ids[1], near, "a"), (8, prose(4, 100), "a"), (None, prose(5, 9), "a")]
    rows += [(9, prose(6, 60), "a"), (9, prose(7, 60), "a"), (None, None, "a")]
    assert found(frame(spark, rows), folder) == groups(rows)
    got = divide_skip.near_duplicates(frame(spark, rows), Scratch(spark, folder + "/again")).collect()
    assert len({r.group for r in got}) == 6 and sum(r.group is None for r in got) == 1


def edited(draw, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("heavy", [2, divide_skip.HEAVY])
def test_chains_and_common_passages(spark, folder, monkeypatch, heavy):
    """Copies of copies, one large group, and a passage that stands in a third of the texts."""
    monkeypatch.setattr(divide_skip, "HEAVY", heavy)
    monkeypatch.setattr(divide_skip, "_PIECE", 16)
    draw = random.Random(4)
    passage, rows = prose(77, 60), []
    for i in range(60):
        text = edited(draw, prose(i, draw.randrange(4, 150)), 2)
        rows.append((len(rows), text + " " + passage * (i % 3 == 0), "a"))
        for _ in range(draw.randrange(0, 4)):
            text = edited(draw, text, draw.randrange(0, 4))
            rows.append((len(rows), text, "a"))
    base = prose(500, 200)
    rows += [(1000 + i, edited(draw, base, draw.randrange(1, 8)), "b") for i in range(80)]
    draw.shuffle(rows)
    expected = groups(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 80
    assert found(frame(spark, rows), folder) == expected


def test_nothing(spark, folder):
    docs = frame(spark, odd_rows())
    assert found(docs.limit(0), folder + "/a") == Counter()
    only_empty = docs.where("text IS NULL OR text = ''")
    assert sum(found(only_empty, folder + "/b").values()) == 3


def test_components_of_a_long_chain(spark, folder):
    ids = list(range(0, 400))
    random.Random(1).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (1001, 1001)]
    got = links.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, folder))
    assert {r.id: r.label for r in got.collect()} == {**dict.fromkeys(ids, 0), 1000: 1000, 1001: 1000}


def test_word_hashes_tell_words_apart():
    texts = ["a b  c", None, "", "A\tb\nC", "é É", " x ", "ab c", "long" * 400_000 + " b"]
    table = pa.array(texts, pa.string())
    got = []
    for _, data, offsets in wordbytes.slices(table):
        w, doc = wordbytes.words(data, offsets)
        got += [list(w[doc == i]) for i in range(len(offsets) - 1)]
    names = {}
    for text, hashes in zip(texts, got):
        assert len(hashes) == len(words(text))
        for word, h in zip(words(text), hashes):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_shingle_sets_equal_those_of_python():
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (*range(12), 60, 300)]
    sets = list(wordbytes.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for a, x in zip(sets, texts):
        for b, y in zip(sets, texts):
            assert len(np.intersect1d(a, b)) == len(shingles(x) & shingles(y))


def test_packing():
    numbers = np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
    ascending = np.sort(numbers)
    assert (packing.unpack_sorted(packing.pack_sorted(ascending)) == ascending).all()
    assert (packing.unpack(packing.pack(numbers)) == numbers).all()
    assert len(packing.unpack(packing.pack(numbers[:0]))) == 0


def test_prefixes_share_enough():
    """The bound the search rests on, for all sizes and any order."""
    for n in range(1, 400):
        assert divide_skip.needed(n, 80) == -(-n * 80 // 100)
        assert divide_skip.hits(n, 80) <= divide_skip.needed(n, 80)
        assert n == 1 or divide_skip.hits(n, 80) >= divide_skip.hits(n - 1, 80)
