"""Documents as they arrive: each micro-batch is masked with the mapping so far, which it extends. An extension; one writer for each mapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.case import CasePlan
from ..plans.staging import released, staged


def mask_stream(docs: DataFrame, lexicon: DataFrame, answers: Callable[[DataFrame], DataFrame], mapping_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """docs: a streaming table (case_id, doc_id, text). The mapping after batch n is written to mapping_path/batch=n, so a batch that is run again after a
    failure starts from the one before it and overwrites its own results.

    A batch is one plan: the model is asked once, and the mapping that is stored is the one that the texts are masked with."""

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        schema = "case_id string, label string, num int, token string, value string"
        prior = spark.read.schema(schema).parquet(f"{mapping_path}/batch={number - 1}") if number else spark.createDataFrame([], schema)
        with released(spark):
            held = staged(part, "batch")
            plan = CasePlan(held, lexicon, answers(held), prior)
            plan.mapping.write.mode("overwrite").parquet(f"{mapping_path}/batch={number}")
            plan.masked.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
