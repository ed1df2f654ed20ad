"""Connected components of an edge table, by label passing and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialized


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge.

    ``edges`` has columns a and b of one comparable type. Every round, all edges move to the
    roots known so far, the smallest neighbouring root is taken, and labels jump to their
    label's label, so long chains shrink geometrically. A round is a few aggregations with
    map-side combining, written to the shared folder; no node's neighbours are collected.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialized(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    open_ = both
    while True:
        # Jump: a label becomes its label's label.
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        jumped = materialized(labels.join(up, F.col("root") == F.col("_n")).select("node", F.col("_up").alias("root")))
        # Edges between different roots are all that is left to do.
        a, b = (jumped.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"_r{x}")) for x in "ab")
        moved = open_.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
        open_ = materialized(moved.where("_ra <> _rb").select(F.col("_ra").alias("a"), F.col("_rb").alias("b")).distinct())
        # Roots take the smallest root across an edge; other nodes follow when they jump.
        best = open_.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_m")).where(F.col("_m") < F.col("_a"))
        new = jumped.join(best, F.col("root") == F.col("_a"), "left").select(
            "node", F.coalesce("_m", "root").alias("root"), (F.col("_m").isNotNull() | (F.col("root") != F.col("node"))).alias("_"))
        if not open_.limit(1).count():
            flat = jumped.join(up_of(jumped), F.col("root") == F.col("_n")).where(F.col("root") != F.col("_up"))
            if not flat.limit(1).count():
                return jumped
        labels = materialized(new.select("node", "root"))


def up_of(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
