"""The export gate, and the independent check of what is about to leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import lexicon_spans, structured_spans
from .literals import with_literals


def _reason(ok: Column, name: Column, low_n: Column) -> Column:
    """Why a stage holds a document back, or null."""
    return F.when(~ok, F.concat(name, F.lit(" 检测未能正常完成,需人工确认"))).when(low_n > 0, F.concat(name, F.lit(" 发现 "), low_n.cast("string"), F.lit(" 处需人工核实的疑似内容")))


def decisions(stages: DataFrame) -> DataFrame:
    """(case_id, doc_id, auto_export, reasons): a stage that failed, or found something it isn't sure of, holds the document back; a failure is named before a
    count. Reasons come in the stages' order."""
    reason = _reason(F.col("ok"), F.col("name"), F.col("low_n"))
    return _decided(stages.groupBy("case_id", "doc_id").agg(F.collect_list(F.when(reason.isNotNull(), F.struct("ord", reason.alias("reason")))).alias("_told")))


def row_decisions(rows: DataFrame) -> DataFrame:
    """decisions() of stage_rows(): a row a document goes through, not seven."""
    held = F.filter(F.transform("stages", lambda s: F.struct(s["ord"].alias("ord"), _reason(s["ok"], s["name"], s["low_n"]).alias("reason"))), lambda r: r["reason"].isNotNull())
    return _decided(rows.select("case_id", "doc_id", held.alias("_each")).groupBy("case_id", "doc_id").agg(F.flatten(F.collect_list("_each")).alias("_told")))


def _decided(told: DataFrame) -> DataFrame:
    return told.select("case_id", "doc_id", F.transform(F.sort_array("_told"), lambda r: r["reason"]).alias("reasons")).select("case_id", "doc_id", (F.size("reasons") == 0).alias("auto_export"), "reasons")


def stage_table(docs: DataFrame, spans: DataFrame, entity_results: DataFrame, duplicates: DataFrame, pages: DataFrame | None = None, native_tables: DataFrame | None = None) -> DataFrame:
    """stages: stage_rows() with a row for each document and stage."""
    rows = stage_rows(docs, spans, entity_results, duplicates, pages, native_tables)
    return rows.select("case_id", "doc_id", F.explode("stages").alias("s")).select("case_id", "doc_id", "s.*")


def stage_rows(docs: DataFrame, spans: DataFrame, entity_results: DataFrame, duplicates: DataFrame, pages: DataFrame | None = None, native_tables: DataFrame | None = None) -> DataFrame:
    """(case_id, doc_id, stages: array<struct<ord,name,ok,low_n>>), documents told apart by case and id: ocr, ledger, tables, same names, regex, lexicon, llm. Counts are of what detectors report, before
    spans are merged.

    pages: (case_id, doc_id, source, n_low, possible_table); native_tables: (case_id, doc_id) of files with a table of their own, counted on top of the pages'
    flags.
    """
    key = ["case_id", "doc_id"]
    seen = docs.select(*key)
    if pages is None:
        seen = seen.withColumns({n: F.lit(0).cast("long") for n in ("ocr", "failed", "tables")})
    else:
        counted = pages.groupBy(*key).agg(
            F.sum(F.when(F.col("source").isin("ocr", "mixed"), F.col("n_low")).otherwise(0)).cast("long").alias("ocr"), F.count_if(F.col("source") == "failed").alias("failed"), F.count_if("possible_table").alias("tables")
        )
        seen = seen.join(counted, key, "left").na.fill(0, ["ocr", "failed", "tables"])
    if native_tables is not None:
        seen = seen.join(native_tables.select(*key, F.lit(1).alias("_own")).distinct(), key, "left").withColumn("tables", F.col("tables") + F.coalesce("_own", F.lit(0))).drop("_own")
    names = duplicates.groupBy("case_id").agg(F.count("*").alias("names"))
    low = spans.filter("source = 'regex' and confidence = 'low'").groupBy(*key).agg(F.count("*").alias("low"))
    all_of = seen.join(names, "case_id", "left").join(low, key, "left").join(entity_results.select(*key, F.col("ok").alias("llm_ok"), F.col("n_spans").alias("llm")), key, "left")
    rows = [("ocr", F.lit(True), "ocr"), ("处理台账", F.col("failed") == 0, None), ("表格/表单", F.lit(True), "tables"), ("同名待确认", F.lit(True), "names"), ("regex", F.lit(True), "low"), ("lexicon", F.lit(True), None), ("llm", F.coalesce("llm_ok", F.lit(False)), "llm")]
    made = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), ok.alias("ok"), (F.coalesce(c, F.lit(0)) if c else F.lit(0)).cast("long").alias("low_n")) for i, (n, ok, c) in enumerate(rows)))
    return all_of.select(*key, made.alias("stages"))


def mapping_leaks(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(case_id, doc_id, value): mapped values of the case that a text still holds. One pass over each text (see literals), no join of texts and values."""
    found = with_literals(texts.select("case_id", "doc_id", "text"), mapping.select("case_id", F.col("value").alias("entry")))
    each = F.array_distinct(F.transform("found", lambda s: s["entry"]))
    return found.select("case_id", "doc_id", F.explode(each).alias("value"))


def leaks(texts: DataFrame, mapping: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(case_id, doc_id, check_no, ord, value, message) over final texts (case_id, doc_id, text): 1 mapped values, 2 structured patterns, 3 list names.
    A document is fine if it has no row. Values are personal data: keep them out of logs."""
    kept = mapping.filter("value <> ''").groupBy("case_id", "value").agg(F.min(F.struct("label", "num")).alias("_o"))
    first = mapping_leaks(texts, mapping).join(kept, ["case_id", "value"]).select("case_id", "doc_id", F.lit(1).alias("check_no"), F.xxhash64("_o").alias("ord"), "value", F.concat(F.lit("「"), "value", F.lit("」的脱敏未完全生效,在最终文本中仍能找到")).alias("message"))

    def found(spans: DataFrame, no: int, before, after) -> DataFrame:
        return spans.select("case_id", "doc_id", F.lit(no).alias("check_no"), F.col("seq").alias("ord"), "value", F.concat(before, F.lit("「"), "value", F.lit("」"), after).alias("message"))

    second = found(structured_spans(texts), 2, F.concat(F.lit("最终文本中发现疑似残留的敏感信息("), "entity_type", F.lit("): ")), F.lit(""))
    third = found(lexicon_spans(texts, lexicon), 3, F.lit("最终文本中发现「案件人员清单」里的姓名/机构名仍未脱敏: "), F.lit(""))
    return reduce(DataFrame.unionByName, [first, second, third])


def split_by_leaks(texts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that may go out and texts that may not."""
    bad = found.select("case_id", "doc_id").distinct()
    return texts.join(bad, ["case_id", "doc_id"], "left_anti"), texts.join(bad, ["case_id", "doc_id"], "left_semi")


def clean_cases(decided: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, all_clean): every document of the case may go out by itself and has no leak. decided: (case_id, doc_id, auto_export)."""
    bad = found.select("case_id", "doc_id").distinct().withColumn("_leak", F.lit(True))
    joined = decided.join(bad, ["case_id", "doc_id"], "left")
    return joined.groupBy("case_id").agg(F.bool_and(F.col("auto_export") & F.col("_leak").isNull()).alias("all_clean"))
