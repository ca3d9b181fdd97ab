"""Whole plans: mask a set of cases, check what comes out, decide what may leave."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunk, detect, gate, merge, report, tokens
from .staging import staged


def check_case_name(name: str) -> str:
    """The trimmed name, if it can be used as a partition path; else ValueError."""
    name = name.strip()
    if not name or "/" in name or "\\" in name or ".." in name:
        raise ValueError(f"not a case name: {name!r}")
    return name


@dataclass
class CasePlan:
    """Tables of a run over documents (case_id, doc_id, text), worked out when first asked for. `answers` are those of the entity detector (see
    chunk.model_entities())."""

    docs: DataFrame
    lexicon: DataFrame
    answers: DataFrame
    prior: DataFrame | None = None
    pages: DataFrame | None = None
    native_tables: DataFrame | None = None

    @cached_property
    def told(self) -> DataFrame:
        """Staged: an entity detector may not answer twice alike."""
        return staged(self.answers, "answers")

    @cached_property
    def spans(self) -> DataFrame:
        """Staged: masking and gate both read it, and it is small beside the texts."""
        return staged(detect.all_spans(detect.structured_spans(self.docs), detect.lexicon_spans(self.docs, self.lexicon), chunk.entity_spans(self.told)), "spans")

    @cached_property
    def merged(self) -> DataFrame:
        return merge.merged(self.spans)

    @cached_property
    def values(self) -> DataFrame:
        return staged(tokens.valued(self.docs, self.merged), "values")

    @cached_property
    def mapping(self) -> DataFrame:
        return staged(tokens.extended_mapping(self.values, self.prior), "mapping")

    @cached_property
    def masked(self) -> DataFrame:
        return tokens.masked(self.docs, self.values, self.mapping)

    @cached_property
    def duplicates(self) -> DataFrame:
        return detect.duplicate_entries(self.lexicon)

    @property
    def _stage_inputs(self) -> tuple[DataFrame | None, ...]:
        return self.docs, self.spans, chunk.entity_results(self.told), self.duplicates, self.pages, self.native_tables

    @cached_property
    def stages(self) -> DataFrame:
        return gate.stage_table(*self._stage_inputs)

    @cached_property
    def decisions(self) -> DataFrame:
        return gate.row_decisions(gate.stage_rows(*self._stage_inputs))

    @cached_property
    def candidates(self) -> DataFrame:
        """Staged: checks read the very texts that would go out."""
        return staged(self.masked.select("case_id", "doc_id", F.col("masked_text").alias("text")), "candidates")

    @cached_property
    def leaks(self) -> DataFrame:
        return staged(gate.leaks(self.candidates, self.mapping, self.lexicon), "leaks")

    @cached_property
    def clean_cases(self) -> DataFrame:
        return gate.clean_cases(self.decisions, self.leaks)

    def approved(self) -> tuple[DataFrame, DataFrame]:
        """Candidates that the second check lets out, and those that it holds back, all against the mapping as it is now."""
        return gate.split_by_leaks(self.candidates, self.leaks)

    @cached_property
    def growth(self) -> DataFrame:
        """(case_id, doc_id, mapping_size): entries of the case's mapping once the document has been worked on."""
        old = self.prior.groupBy("case_id").agg(F.count("*").alias("_old")) if self.prior is not None else None
        known = self.values.groupBy("case_id", "value").agg(F.min("doc_id").alias("doc_id"))
        if self.prior is not None:
            known = known.join(self.prior.select("case_id", "value"), ["case_id", "value"], "left_anti")
        new = known.groupBy("case_id", "doc_id").agg(F.count("*").alias("_new"))
        each = self.docs.select("case_id", "doc_id").join(new, ["case_id", "doc_id"], "left")
        if old is not None:
            each = each.join(old, "case_id", "left")
        # block by block of documents, so that a large case isn't one task
        block = each.withColumn("_block", F.floor(F.col("doc_id") / tokens.BLOCK))
        sums = block.groupBy("case_id", "_block").agg(F.sum(F.coalesce("_new", F.lit(0))).alias("_sum"))
        before = sums.select("case_id", "_block", F.coalesce(F.sum("_sum").over(W.partitionBy("case_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        within = F.sum(F.coalesce("_new", F.lit(0))).over(W.partitionBy("case_id", "_block").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0))
        total = within + F.col("_before") + (F.coalesce("_old", F.lit(0)) if old is not None else F.lit(0))
        return block.join(before, ["case_id", "_block"]).select("case_id", "doc_id", total.alias("mapping_size"))

    @cached_property
    def report_rows(self) -> DataFrame:
        told = self.leaks.groupBy("case_id", "doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("check_no", "ord", "message"))), lambda x: x["message"]).alias("_leaks"))
        return self._report_rows(self.decisions.join(self.growth, ["case_id", "doc_id"]).join(told, ["case_id", "doc_id"], "left"))

    @cached_property
    def unchecked_report_rows(self) -> DataFrame:
        """report_rows before the second check: no leaks are told, and none are looked for."""
        return self._report_rows(self.decisions.join(self.growth, ["case_id", "doc_id"]).withColumn("_leaks", F.lit(None).cast("array<string>")))

    def _report_rows(self, base: DataFrame) -> DataFrame:
        none = "array<struct<page_number:int,reason:string>>", "array<struct<page_number:int,image:string,lines:array<struct<text:string,confidence:double>>>>"
        return base.select(
            "case_id", F.col("doc_id").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "auto_export", "reasons", "mapping_size",
            F.coalesce("_leaks", F.array().cast("array<string>")).alias("leaks"), F.array().cast(none[0]).alias("failed_pages"), F.array().cast(none[1]).alias("flagged_pages"),
        )

    @cached_property
    def reports(self) -> DataFrame:
        return report.reports(self.report_rows, self.duplicates)
