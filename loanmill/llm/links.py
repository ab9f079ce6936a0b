"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanmill.sources.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """`id`, `label` (smallest id reachable) of every id in the edges (`a`, `b`).

    Each round, an id hears the labels of its neighbours; the smallest also goes to the id
    that labels it, so that whole groups join at once, and every label is then replaced by
    its own label. The number of rounds follows the logarithm of the longest chain. Each
    round is a written table.
    """
    both = scratch.keep(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    labels = scratch.keep(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
        .select("id", F.least("id", "label").alias("label")),
        "labels_0",
    )
    step = 0
    while True:
        step += 1
        heard = (
            both.join(labels, both["a"] == labels["id"])
            .groupBy(F.col("b").alias("id"))
            .agg(F.min("label").alias("heard"))
        )
        heard = scratch.keep(labels.join(heard, "id"), f"heard_{step}")
        passed = heard.groupBy(F.col("label").alias("id")).agg(F.min("heard").alias("passed"))
        nearer = heard.join(passed, "id", "left").select(
            "id", F.least("label", "heard", "passed").alias("label"), F.col("label").alias("old")
        )
        nearer = scratch.keep(nearer, f"nearer_{step}")
        of_label = nearer.select(F.col("id").alias("label"), F.col("label").alias("farther"))
        jumped = nearer.join(of_label, "label").select(
            "id", "farther", (F.col("farther") < F.col("old")).alias("moved")
        )
        jumped = scratch.keep(jumped, f"labels_{step}")
        labels = jumped.select("id", F.col("farther").alias("label"))
        if jumped.where("moved").isEmpty():
            return labels
