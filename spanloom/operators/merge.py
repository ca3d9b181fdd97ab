"""Spans of all detectors to disjoint spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(spans: DataFrame) -> DataFrame:
    """spans with `island`: overlapping spans, directly or through others, share a number within their document; touching ones don't."""
    order = W.partitionBy("case_id", "doc_id").orderBy("start", "end", "seq")
    reach = spans.withColumn("_reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), 1).otherwise(0)
    return reach.withColumn("island", F.sum(new).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_reach")


def merged(spans: DataFrame) -> DataFrame:
    """One span for each island: high confidence first, then the narrower, then the earlier. What the others cover beyond it stays uncovered."""
    best = W.partitionBy("case_id", "doc_id", "island").orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), F.col("end") - F.col("start"), "start", "end", "seq")
    return islands(spans).withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "island")
