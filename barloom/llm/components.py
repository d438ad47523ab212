"""Connected components of an edge table, by least labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of ``edges`` (a, b); label is the least id that can be reached. Staged.

    Each round takes the least label among neighbours and then the label of that label, so paths shorten as they spread.
    The last round finds nothing to change; there is no cap on rounds.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    step = stage(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("label")).withColumn("old", F.col("id")), "labels")
    while step.where("old <> label").limit(1).count():
        labels = step.select("id", "label")
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("id").alias("_up"), F.col("label").alias("_label"))
        # labels are ids of ends, so each has a row of its own
        jumped = lower.join(up, lower["new"] == up["_up"]).select("id", F.least("new", "_label").alias("label"), F.col("label").alias("old"))
        last, step = step, stage(jumped, "labels")
        discard(last)
    discard(both)
    labels = step.select("id", "label")
    labels.staged_at = step.staged_at
    return labels
