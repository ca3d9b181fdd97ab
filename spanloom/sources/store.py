"""The mapping as an encrypted table: one row a case, AES-GCM over its JSON, keys from a provider."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "array<struct<label:string,num:int,token:string,value:string>>"


class Keys(Protocol):
    """Gives a key of 16, 24 or 32 bytes for a case; `create` makes one where there is none. Any failure but a missing key must raise."""

    def get(self, case_id: str) -> bytes | None: ...

    def create(self, case_id: str) -> bytes: ...

    def delete(self, case_id: str) -> None: ...


def _key_table(spark: SparkSession, keys: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame([(c, bytearray(k)) for c, k in keys.items()], "case_id string, _key binary")


def save_mapping(mapping: DataFrame, path: str, keys: Keys) -> None:
    """Replace the stored mapping of the cases at hand. Fails closed: without a key nothing is written."""
    spark = mapping.sparkSession
    cases = [r[0] for r in mapping.select("case_id").distinct().toLocalIterator()]  # as many as cases in this run, one key each
    held = {c: keys.get(c) or keys.create(c) for c in cases}
    packed = mapping.groupBy("case_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("label", "num", "token", "value")))).alias("_json"))
    sealed = packed.join(F.broadcast(_key_table(spark, held)), "case_id").select("case_id", F.base64(F.aes_encrypt("_json", "_key", F.lit("GCM"))).alias("sealed"))
    sealed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(path)


def load_mapping(spark: SparkSession, path: str, case_ids: list[str], keys: Keys) -> DataFrame:
    """mapping rows of the cases. A case without a stored mapping has none; a stored one whose key is gone, or wrong, is an error."""
    empty = "case_id string, label string, num int, token string, value string"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], empty)
    stored = spark.read.schema("sealed string, case_id string").parquet(path).filter(F.col("case_id").isin(case_ids))
    there = [r[0] for r in stored.select("case_id").toLocalIterator()]
    held = {c: keys.get(c) for c in there}
    if missing := [c for c, k in held.items() if k is None]:
        raise KeyError(f"no key for {len(missing)} stored mappings")
    opened = stored.join(F.broadcast(_key_table(spark, held)), "case_id").select("case_id", F.aes_decrypt(F.unbase64("sealed"), "_key", F.lit("GCM")).cast("string").alias("_json"))
    return opened.select("case_id", F.explode(F.from_json("_json", ENTRIES)).alias("m")).select("case_id", "m.*")
