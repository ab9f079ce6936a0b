"""From raw documents to shards, in five stages over whole texts.

Each stage takes the session, the documents its predecessor kept and the folder of the
tables, and returns the documents that go on, with the columns of `documents`; the last
returns where every document goes. Stages are written and reread one by one, so a lost
executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanmill.llm import divide_skip, minimax_shards, pareto_mix, pigeonhole, rff_quality
from loanmill.llm.base import session_scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: empty and null texts are scored as
    any other, equal rows alike. Without labels none is rejected.
    """
    model = rff_quality.fit(docs, table(spark, sf_dir, "labels"), session_scratch(spark))
    return rff_quality.score(docs, model).where(F.col("score") >= 0.3).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, null last.

    Where texts of a group share that doc_id, one text stays, and of rows equal in doc_id and
    text one row. Texts without words are in no group and stay.
    """
    groups = divide_skip.near_duplicates(docs, session_scratch(spark))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least")
    first = groups.where("group IS NOT NULL").groupBy("group").agg(least).select("least.*")
    alone = groups.where("group IS NULL")
    kept = first.select("doc_id", "text_key").union(alone.select("doc_id", "text_key")).distinct()
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = docs.select(F.struct("*").alias("row"), divide_skip.text_key(F.col("text")).alias("text_key"))
    stays = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    return (
        rows.join(kept, stays, "left_semi")
        .select("row", F.col("row.doc_id").alias("doc_id"), "text_key")
        .dropDuplicates(["doc_id", "text_key"])
        .select("row.*")
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is met. Null and empty texts or items meet nothing;
    equal rows fare alike; without items all stay.
    """
    return pigeonhole.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources holds it. A null source is one of its own;
    documents without words take no part; equal rows are drawn one by one.
    """
    chosen = pareto_mix.mix(docs, session_scratch(spark)).where("copies > 0")
    return chosen.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select(
        "row.*"
    )


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the copies of a text share a shard, null and empty texts
    too. Ties go by the text's hash. An empty table gives no rows.
    """
    carry = [F.col(name) for name in ("doc_id", "source", "lang")]
    placed = minimax_shards.shard(docs, session_scratch(spark), carry=carry)
    return placed.select("row.*", "size", "shard", "slot")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]
#: The classifier, the draws and the search of the capacity have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    scratch = session_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage_{i}")
    return docs
