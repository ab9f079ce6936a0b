"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The ledger holds,
per blob, the rule versions it was scanned with and what they found. A scan looks only at
pairs of blob and rule version that the ledger lacks, whichever and however many paths hold
the blob, appends them, and findings are joined back to all paths.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose `group` has fewer than `shortest` characters do not count."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: In order: ties in position are listed in this order.
RULES = [
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"([A-Za-z0-9+/_.=-]+)",
        group=2,
        shortest=6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]

_LEDGER = (
    "blob binary, rules array<string>,"
    " hits array<struct<rule:string,pieces:array<struct<gap:int,length:int,counts:boolean>>>>"
)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _pieces(text: Column, rule: Rule) -> Column:
    """Per match: code points since the match before, its length, whether it counts."""

    def found(group):
        return F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))

    gaps = F.split(text, rule.pattern, -1)
    return F.transform(
        F.arrays_zip(found(0).alias("m"), found(rule.group).alias("g"), gaps.alias("gap")),
        lambda x: F.struct(
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["m"]).alias("length"),
            (F.char_length(x["g"]) >= rule.shortest).alias("counts"),
        ),
    )


class BlobLedger:
    """The ledger kept at `path`, one folder per scan."""

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LEDGER).parquet(f"{self.path}/scan=*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LEDGER)

    def scan(self, files: DataFrame) -> None:
        """Scans the `text` of files as far as the ledger does not know it."""
        wanted = F.array(*(F.lit(rule.key) for rule in self.rules))
        blobs = files.select(
            address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")
        )
        known = self.entries()
        if known.inputFiles():
            # Addresses are held against the ledger before any text is moved.
            done = known.select("blob", F.explode("rules").alias("rule"))
            done = done.groupBy("blob").agg(F.collect_set("rule").alias("done"))
            lacks = F.array_except(wanted, F.coalesce("done", F.array()))
            asked = f"{self.path}/asked/{uuid.uuid4().hex}"
            (
                blobs.select("blob").distinct().join(done, "blob", "left")
                .select("blob", lacks.alias("rules")).where(F.size("rules") > 0)
                .write.parquet(asked)
            )
            lacking = self.spark.read.schema("blob binary, rules array<string>").parquet(asked)
            if lacking.isEmpty():
                return
            blobs = blobs.join(lacking, "blob")
        else:
            blobs = blobs.withColumn("rules", wanted)
        unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
        hits = F.array(
            *(
                F.when(
                    F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern),
                    F.struct(
                        F.lit(rule.key).alias("rule"),
                        _pieces(F.col("text"), rule).alias("pieces"),
                    ),
                )
                for rule in self.rules
            )
        )
        unseen.select("blob", "rules", F.array_compact(hits).alias("hits")).write.parquet(
            f"{self.path}/scan={uuid.uuid4().hex}"
        )

    def findings(self) -> DataFrame:
        """`blob` and `spans` (kind, start, end, order), sorted; of the present rule versions."""
        current = {rule.key: (rule.kind, i) for i, rule in enumerate(self.rules)}
        names = F.create_map(*(F.lit(x) for k, (kind, _) in current.items() for x in (k, kind)))
        ranks = F.create_map(*(F.lit(x) for k, (_, i) in current.items() for x in (k, i)))
        by_blob = Window.partitionBy("blob", "rule").orderBy("pos")
        end = F.sum(F.col("p.gap") + F.col("p.length")).over(by_blob)
        return (
            self.entries()
            .select("blob", F.explode("hits").alias("hit"))
            .where(F.col("hit.rule").isin(list(current)))
            # A scan that was repeated after a failure may have added a blob twice.
            .groupBy("blob", F.col("hit.rule").alias("rule"))
            .agg(F.first("hit.pieces").alias("pieces"))
            .select("blob", "rule", F.posexplode("pieces").alias("pos", "p"))
            .select("blob", "rule", "p", end.alias("end"))
            .where("p.counts")
            .groupBy("blob")
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            (F.col("end") - F.col("p.length")).alias("start"),
                            ranks[F.col("rule")].alias("rank"),
                            "end",
                            names[F.col("rule")].alias("kind"),
                        )
                    )
                ).alias("spans")
            )
        )


def find_secrets(docs: DataFrame, ledger: BlobLedger) -> DataFrame:
    """`row` (all columns of the document) and `spans`, after scanning what is new.

    Spans are structs of start, rank, end and kind, by start and then in the order of the
    rules; code points, end exclusive. Null texts count as empty. A document without secrets
    has an empty array, equal rows have equal spans, an empty table gives no rows.
    """
    ledger.scan(docs)
    rows = docs.select(F.struct("*").alias("row"), address(F.col("text")).alias("blob"))
    return rows.join(ledger.findings(), "blob", "left").select(
        "row", F.coalesce("spans", F.array()).alias("spans")
    )
