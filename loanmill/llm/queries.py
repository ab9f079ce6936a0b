"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanmill.llm import (
    blob_ledger,
    block_max,
    bpe_fragments,
    conversation_trie,
    divide_skip,
    licence_paragraphs,
    line_runs,
    minimax_shards,
    pareto_mix,
    pigeonhole,
    rff_quality,
    surrogates,
    token_links,
)
from loanmill.llm.base import session_scratch, table
from loanmill.llm.oracles import ORACLES  # noqa: F401


def public_tokenizer(name: str) -> str:
    """Where this machine has a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = pareto_mix.mix(docs, session_scratch(spark))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = line_runs.drop_repeated_lines(docs, session_scratch(spark))
    n_lines, n_kept = F.size("lines"), F.size("kept")
    return split.select(
        "row.doc_id",
        n_lines.cast("long").alias("n_lines"),
        (n_lines - n_kept).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    safe = surrogates.replace_entities(docs, "corpus-key-1", session_scratch(spark))
    return safe.select("row.doc_id", "n_entities", F.col("safe_text").alias("text"))


def op3_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_paragraphs.scan(docs, licence_paragraphs.train(docs))


def op4_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pigeonhole.matches(docs, table(spark, sf_dir, "benchmark"))


def op6_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rff_quality.fit(docs, table(spark, sf_dir, "labels"), session_scratch(spark))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return (
        rff_quality.score(docs, model)
        .select("row.doc_id", "score")
        .select(
            "doc_id", held_out.alias("held_out"), "score",
            (F.col("score") >= 0.3).cast("int").alias("predicted"),
        )
    )


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    carry = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")]
    placed = minimax_shards.shard(docs, session_scratch(spark), carry=carry)
    return placed.select(
        "row.*", "size", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return block_max.search(docs, docs.where("doc_id % 100 = 0"), session_scratch(spark))


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = blob_ledger.BlobLedger(spark, session_scratch(spark).path("ledger"))
    found = blob_ledger.find_secrets(docs, ledger)

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def number(kind):
        n = F.size(F.filter("spans", lambda s: s["kind"] == kind))
        return n.cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "row.doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op10_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = divide_skip.near_duplicates(docs, session_scratch(spark))
    return groups.select("doc_id", "n_shingles", "component_id")


def op11_bpe_fragments(
    spark: SparkSession, sf_dir: str, tokenizer: str | None = None
) -> DataFrame:
    """`tokenizer`: path of the tokenizer file; the public one of 50,257 ids where not given."""
    path = tokenizer or public_tokenizer("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_fragments.encode(docs, path, check=True).select(
        "row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = session_scratch(spark)
    turns, members = conversation_trie.rebuilt(table(spark, sf_dir, "conversations"), scratch)
    return conversation_trie.prefix_trie(turns, members, scratch)


def op13_token_links(
    spark: SparkSession, sf_dir: str, byte_file: str | None = None, piece_file: str | None = None
) -> DataFrame:
    """`byte_file`, `piece_file`: paths of the tokenizer files; public ones where not given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = token_links.align(
        docs, byte_file or public_tokenizer("byte_bpe_50k.json"),
        piece_file or public_tokenizer("piece_bpe_32k.model"), session_scratch(spark),
    )
    return linked.select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_surrogates": op2_surrogates,
    "op3_licence_paragraphs": op3_licence_paragraphs,
    "op4_pigeonhole": op4_pigeonhole,
    "op5_line_runs": op5_line_runs,
    "op6_rff_quality": op6_rff_quality,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_block_max": op8_block_max,
    "op9_blob_ledger": op9_blob_ledger,
    "op10_divide_skip": op10_divide_skip,
    "op11_bpe_fragments": op11_bpe_fragments,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_links": op13_token_links,
}
