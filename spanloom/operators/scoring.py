"""Recall against labelled corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RECALL_FLOORS


def caught(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, category, gt_text, hit): hit if every run of the document has a value that holds the truth. found: (doc, run, value), value null for a run
    without values."""
    runs = found.groupBy("doc", "run").agg(F.collect_set("value").alias("_values"))
    each = expected.join(runs, "doc", "left").withColumn("_hit", F.coalesce(F.exists("_values", lambda v: F.contains(v, F.col("gt_text"))), F.lit(False)))
    return each.groupBy("doc", "category", "gt_text").agg(F.bool_and("_hit").alias("hit"))


def recall(hits: DataFrame) -> DataFrame:
    """(category, recalled, total, recall, passed) for both categories; one without truths counts as fully recalled."""
    spark = hits.sparkSession
    floors = spark.createDataFrame(list(RECALL_FLOORS.items()), "category string, floor double")
    counted = hits.groupBy("category").agg(F.count_if("hit").alias("recalled"), F.count("*").alias("total"))
    rate = F.when(F.col("total") > 0, F.col("recalled") / F.col("total")).otherwise(1.0)
    full = floors.join(counted, "category", "left").na.fill(0, ["recalled", "total"])
    return full.select("category", "recalled", "total", rate.alias("recall"), (rate >= F.col("floor")).alias("passed"))


def over_masked(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, value): values of a document that neither hold a truth nor are part of one."""
    values = found.filter("value is not null").select("doc", "value").distinct()
    related = reduce(lambda a, b: a | b, [F.contains("value", F.col("gt_text")), F.contains("gt_text", F.col("value"))])
    return values.join(expected.select(F.col("doc").alias("_doc"), "gt_text"), (F.col("doc") == F.col("_doc")) & related, "left_anti")
