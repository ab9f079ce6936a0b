"""The registered queries on the given tables, and the pipeline against its parts by hand."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from edge import frame, odd_rows, prose, words
from pyspark.sql import functions as F
from test_links import groups, shingles
from test_native import shares

import corpus_pipeline
from __spark_entry__ import queries
from loanmill.llm import pigeonhole
from loanmill.llm.oracles import OP5, OP9, OP10
from loanmill.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in queries()
    assert set(QUERIES) <= set(queries())


def test_mix_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op1_pareto_mix"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(words(docs[r.doc_id].text)) and r.taken <= 2 * r["size"]
        sizes[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
    largest = max(r["size"] for r in got)
    for source, wanted in shares(sizes).items():
        assert abs(taken[source] - wanted) <= largest
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in got)


def test_search_query_returns_each_query_first(spark):
    got = QUERIES["op8_block_max"](spark, SMALL).where("rank = 1").collect()
    assert {r.query_id for r in got} == {0, 100}


def odd_with(spark, folder):
    """Tables in which everything odd about documents occurs, written as an input folder."""
    rows = odd_rows() + [(300, f"{prose(70, 40)} {prose(71, 30)}", "c")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(1, prose(71, 30)), (2, None)], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    return rows


@pytest.mark.parametrize("name, sql", [("op5_line_runs", OP5), ("op9_blob_ledger", OP9), ("op10_divide_skip", OP10)])
def test_sql_and_query_agree_on_odd_rows(spark, folder, name, sql):
    rows = [r for r in odd_with(spark, folder) if r[0] is not None]
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    got = Counter(tuple(r[c] for c in names) for r in QUERIES[name](spark, folder).collect())
    assert got == Counter(result.fetchall())


def one_of_each(rows):
    """Of every group the row with the smallest doc_id, null last; wordless texts all."""
    sets, left, kept = [shingles(t) for _, t, _ in rows], set(range(len(rows))), Counter()
    while left:
        group, new = set(), {min(left)}
        while new:
            group |= new
            new = {
                j for j in left - group for i in new
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            }
        left -= group
        kept[min(((rows[i][0] is None, rows[i][0], rows[i][1]) for i in group), key=lambda r: r[:2] if r[1] is not None else (True, 0))[1:]] = 1
    return kept


def test_near_copies_of_null_and_shared_ids_go(spark, folder):
    near = prose(3, 100).replace("w3x35 ", "changed ")
    rows = [(None, prose(3, 100), "a"), (7, near, "a"), (9, prose(4, 60), "a"), (9, prose(5, 60), "a")]
    rows += [(12, prose(5, 60), "a"), (None, prose(6, 50), "a"), (None, prose(6, 50), "b"), (13, "", "a")]
    got = corpus_pipeline.without_near_copies(spark, frame(spark, rows), folder).collect()
    assert Counter((r.doc_id, r.text) for r in got) == one_of_each(rows)
    assert len(got) == 5


def test_pipeline_by_hand(spark, folder):
    rows = odd_with(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert len(names) == 5

    kept = stages[names[0]](spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == len(rows)  # no labels, no rejects

    alone = stages[names[1]](spark, docs, folder)
    assert alone.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in alone.collect()) == one_of_each(rows)

    clean = stages[names[2]](spark, docs, folder)
    assert {r[0] for r in rows} - {r.doc_id for r in clean.collect()} == {300}

    mixed = stages[names[3]](spark, docs, folder)
    assert mixed.columns == docs.columns
    assert set(Counter(r.doc_id for r in mixed.where("doc_id <> 9").collect()).values()) <= {1, 2}

    placed = stages[names[4]](spark, mixed, folder)
    assert placed.count() == mixed.count()
    assert placed.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("NOT ok").isEmpty()


def test_pipeline_on_the_documents(spark):
    """What the whole run keeps has no near copies, no benchmark items and no gaps."""
    got = queries()["pipeline"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = {r.doc_id for r in got}
    assert 100 < len(ids) <= len(texts)
    own = [(i, texts[i], None) for i in ids]
    assert all(doc_id == component for doc_id, _, component in groups(own))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    finder = pigeonhole.Finder(items, 12)
    assert not any(finder.find(pigeonhole.levelled(texts[i])) for i in ids)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_pipeline_of_empty_tables(spark, folder):
    odd_with(spark, folder + "/a")
    for name in ("documents", "benchmark", "labels"):
        table = spark.read.parquet(f"{folder}/a/{name}.parquet")
        table.limit(0).write.parquet(f"{folder}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, folder + "/b").collect() == []
