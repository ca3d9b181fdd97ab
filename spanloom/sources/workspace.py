"""What is kept of cases: raw files, extracted texts, candidates and approved texts, each a table with one current row for each key.

A run appends; the current row of a key is that of its last run, so a document that is worked on again replaces its candidate (files that differ in their
ending only share a stem, and so one text). Approved texts stay as they are when a later run holds their document back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gate import leaks, split_by_leaks
from ..plans.case import check_case_name
from .store import Keys

KINDS = ("raw", "text", "candidate", "approved")


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, kind: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def save(self, kind: str, rows: DataFrame, run: int) -> None:
        """rows: (case_id, stem, doc_id, text), for raw (case_id, filename, content). Of several rows with a key in one run that with the largest doc_id
        stays, of raw ones any. Runs count upwards; a run that is written again replaces itself."""
        if kind not in KINDS:
            raise ValueError(f"not a kind of table: {kind!r}")
        key = ["case_id", "filename" if kind == "raw" else "stem"]
        one = rows.dropDuplicates(key) if kind == "raw" else rows.groupBy(*key).agg(F.max("doc_id").alias("doc_id"), F.max_by("text", "doc_id").alias("text"))
        one.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "case_id").parquet(f"{self.root}/{kind}")

    def current(self, kind: str) -> DataFrame:
        """The rows of a table that hold now, without their run."""
        if not self._exists(kind):
            return self.spark.createDataFrame([], "case_id string, filename string, content binary" if kind == "raw" else "case_id string, stem string, doc_id long, text string")
        rows = self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(f"{self.root}/{kind}")
        key = ["case_id", "filename" if kind == "raw" else "stem"]
        rest = [c for c in rows.columns if c not in (*key, "run")]
        last = rows.groupBy(*(F.col(c).cast("string").alias(c) if c == "case_id" else F.col(c) for c in key)).agg(F.max_by(F.struct(*rest), "run").alias("row"))
        return last.select(*key, "row.*")

    def import_raw(self, path: str, case: str, run: int) -> None:
        """Copies the files under a folder into the case by their base names; a name that is there already is replaced."""
        name = check_case_name(case)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        base = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
        self.save("raw", files.select(F.lit(name).alias("case_id"), base.alias("filename"), "content"), run)

    def exported(self) -> DataFrame:
        """(case_id, stem, exported): of each candidate, whether an approved text of its name is there, from whichever run."""
        there = self.current("approved").select("case_id", "stem", F.lit(True).alias("exported"))
        return self.current("candidate").select("case_id", "stem").join(there, ["case_id", "stem"], "left").na.fill(False, ["exported"])

    def approve(self, case: str, mapping: DataFrame, lexicon: DataFrame, run: int) -> DataFrame:
        """Checks every current candidate of the case against the mapping as it is now, saves those without a leak as approved, and gives (stem, approved,
        n_leaks) of all."""
        texts = self.current("candidate").filter(F.col("case_id") == check_case_name(case))
        found = leaks(texts.select("case_id", "doc_id", "text"), mapping, lexicon)
        self.save("approved", split_by_leaks(texts, found)[0], run)
        counts = found.groupBy("doc_id").agg(F.count("*").alias("n_leaks"))
        return texts.join(counts, "doc_id", "left").select("stem", F.col("n_leaks").isNull().alias("approved"), F.coalesce("n_leaks", F.lit(0)).alias("n_leaks"))

    def forget(self, case: str, keys: Keys) -> None:
        """Deletes the case's key: its stored mapping can't be read by anyone from then on, and loading it is an error."""
        keys.delete(check_case_name(case))
