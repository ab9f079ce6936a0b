"""The conversation trie against plain Python and against SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from loanmill.llm import conversation_trie, queries
from loanmill.llm.oracles import OP12
from loanmill.sources.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def scratch(spark, folder):
    return Scratch(spark, folder)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        hundred = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(hundred, [])[:h] + turns[h:]
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    rows = Counter()
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = sorted(c for c in inside if len(paths[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        rows[min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, digest] += 1
    return rows


def odd_conversations(n=160, seed=3):
    rng = random.Random(seed)
    rows = [(None, 1, "user", "lost"), (None, None, None, None)]
    for c in [*range(n), *range(990, 1010), -5, -100, -130, 10**15 + 7]:
        if c in (100, 1000):  # hundreds that don't exist
            continue
        for turn in range(rng.choice([1, 2, 3, 5, 6, 9, 14])):
            text = rng.choice(["yes", "no", "", None, "日本", "👍🏽"])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None, "assistant"]), text))
    for c in range(300, 330):  # equal conversations
        rows += [(c, t, "user", f"turn {t}") for t in range(11)]
    return rows + rows[5:9]  # repeated rows


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
             "saved_tokens", "ends_sha256"]
    return Counter(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("size, run, pieces", [(4, 4096, 4096), (1, 2, 3), (3, 1, 1), (50, 4096, 2)])
def test_trie_of_odd_conversations(spark, scratch, monkeypatch, size, run, pieces):
    monkeypatch.setattr(conversation_trie, "_RUN", run)
    monkeypatch.setattr(conversation_trie, "_LIST", pieces)
    rows = odd_conversations()
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS depth", "'y' AS k1", "1 AS block")
    turns, members = conversation_trie.rebuilt(table, scratch.inner("a"))
    got = as_rows(conversation_trie.prefix_trie(turns, members, scratch.inner("b"), size))
    assert got == plain_trie(plain_rebuilt(rows))


def test_only_diverging_blocks_are_refined(spark, scratch):
    """Two conversations that part in the second of three blocks."""
    rows = [(c, t, "user", f"t{t}" if c == 300 or t < 6 else f"other {t}") for c in (300, 300 + 60) for t in range(12)]
    turns = spark.createDataFrame([(c, t + 1, r, x) for c, t, r, x in rows], "conv_id long, depth long, role string, text string")
    members = turns.select("conv_id").distinct()
    got = as_rows(conversation_trie.prefix_trie(turns, members, scratch))
    paths = {c: [(r, x) for d, _, r, x in rows if d == c] for c in (300, 360)}
    assert got == plain_trie(paths)
    marked = spark.read.parquet(scratch.path("marked"))
    assert sorted((r.block, r.siblings) for r in marked.collect()) == [(0, 1), (1, 2), (1, 2), (2, 1), (2, 1)]


def test_turnless_members_end_at_the_root(spark, scratch):
    turns = spark.createDataFrame([], "conv_id long, depth long, role string, text string")
    members = spark.createDataFrame([(7,), (3,)], "conv_id long")
    got = as_rows(conversation_trie.prefix_trie(turns, members, scratch.inner("a")))
    assert got == plain_trie({7: [], 3: []})
    assert conversation_trie.prefix_trie(turns, members.limit(0), scratch.inner("b")).count() == 0


def test_sql_and_query_agree(spark, folder):
    spark.createDataFrame(odd_conversations(60), SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    result = con.execute(OP12)
    names = [d[0] for d in result.description]
    got = queries.op12_conversation_trie(spark, folder).collect()
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(result.fetchall())
