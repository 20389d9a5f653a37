"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm._common import written


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id in ``links`` (``a, b``): ids share ``comp`` when links join them; ``comp`` is one of the ids.

    Each round every id takes the least id within two links, then the links between
    the ids so taken remain. Sums are combined before they are shuffled, so a hub costs
    one row per task; rounds are written out, so a lost executor costs one round.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    labels = None
    while True:
        edges = written(edges, "links")
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c"))
        via = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("d"))
        step = near.join(via, "a").select(F.col("a").alias("id"), F.least("c", "d").alias("comp"))
        step = written(step, "labels")
        over = step.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        step = written(step.join(over, "comp").select("id", F.col("next").alias("comp")), "labels")
        over = step.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        labels = step if labels is None else labels.join(over, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
        labels = written(labels, "labels")
        ends = edges.join(step.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
        edges = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")) if labels is None else labels
