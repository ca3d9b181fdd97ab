"""The review report as ordered string aggregation, and the parts of an earlier one that are carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of the report.
TITLE = "# 脱敏处理报告"
HELD = "⚠️ 有文档需要人工核实,请看下面每份文档的详情,确认无误后再运行「批准并导出」。"
CLEAN = "✅ 所有文档均未发现需要人工核实的内容,可以直接批准导出。"
SAME_NAMES = "⚠️ 同名待确认"
SAME_NAMES_TEXT = "「案件人员清单」里以下姓名出现了不止一次,可能是本案里有两个不同的人恰好同名——系统目前没办法自动区分,会把它们当成同一个人替换成同一个占位符。请确认:如果确实是同一个人重复写了,把清单里多余的一行删掉;如果确实是两个不同的人,建议分开处理,或者先用其他能区分的方式(比如加上角色说明)手动核对每处指代的是谁。"
LEAK_TITLE = "### 🚨 检测到可能的信息残留(独立复查发现,优先处理)"
LEAK_TEXT = "系统在导出前对最终文本做了一次独立复查,发现以下内容可能仍然包含未脱敏的敏感信息。这个检查和上面的正常审核是分开的、更严格的一道关卡——即使其他部分显示「没问题」,这里列出的内容也必须先处理掉才能导出。"
FAILED_TITLE = "### ⚠️ 处理失败(以下内容未能识别,不能确认是否安全)"
FAILED_TEXT = "这些页面/图片的内容未能被识别,系统无法确认里面是否包含敏感信息。请打开原始文件人工检查这些页面,确认安全后再考虑是否导出。"
OCR_TITLE = "### OCR 核对(识别质量较低,建议对照原图逐条检查)"
OCR_TEXT = "如发现识别错误,可直接打开 01_文本化/ 里对应的 .txt 文件手动改正,改完后把这个 .txt 文件重新拖进「导入新卷宗」(填相同的案件名称)即可用你改正后的文字重新处理。"


def lines(*parts) -> Column:
    """One array of lines from strings, columns of strings and columns of arrays (marked by a tuple)."""
    return F.concat(*(p[0] if isinstance(p, tuple) else F.array(F.lit(p) if isinstance(p, str) else p) for p in parts))


def section(name="filename", auto="auto_export", reasons="reasons", count="mapping_size", leaks="leaks", failed="failed_pages", flagged="flagged_pages") -> Column:
    """Lines of one document's section. failed: array<struct<page_number,reason>>; flagged: array<struct<page_number,image,lines:array<struct<text,
    confidence>>>>. Arrays are in the order in which they are printed."""
    none = F.array().cast("array<string>")
    items = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    leak_part = F.when(F.size(leaks) > 0, lines(LEAK_TITLE, LEAK_TEXT, (items(F.col(leaks)),), "")).otherwise(none)
    state = F.when(F.col(auto), F.array(F.lit("状态: ✅ 未发现需要人工核实的内容"))).otherwise(lines("状态: ⚠️ 需要人工核实", (items(F.col(reasons)),)))
    failed_part = F.when(F.size(failed) > 0, lines("", FAILED_TITLE, (F.transform(failed, lambda p: F.format_string("- 第 %d 页处理失败: %s", p["page_number"], p["reason"])),), FAILED_TEXT)).otherwise(none)
    page = lambda p: F.concat(
        F.array(F.concat(F.format_string("- 第 %d 页,", p["page_number"]), F.when(p["image"].isNull(), "(未保存原图)").otherwise(F.concat(F.lit("原图: "), p["image"])))),
        F.transform(p["lines"], lambda x: F.format_string("  - 可疑文字(置信度 %.2f): 「%s」", x["confidence"], x["text"])),
    )
    shown = F.filter(flagged, lambda p: F.size(p["lines"]) > 0)
    ocr_part = F.when(F.size(shown) > 0, lines("", OCR_TITLE, (F.flatten(F.transform(shown, page)),), OCR_TEXT)).otherwise(none)
    return lines(F.concat(F.lit("## "), F.col(name)), (leak_part,), (state,), F.format_string("本文档共替换 %d 处敏感信息。", F.col(count)), (failed_part,), (ocr_part,), "")


def reports(docs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(case_id, report). docs: a row for each document (case_id, ord and what section() reads); duplicates: (case_id, entry, ord)."""
    parts = docs.select("case_id", "ord", section().alias("_lines"), (~F.col("auto_export") | (F.size("leaks") > 0)).alias("_held"))
    body = parts.groupBy("case_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_lines"))), lambda x: x["_lines"])).alias("_body"), F.bool_or("_held").alias("_held"))
    same = duplicates.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "entry"))), lambda x: F.concat(F.lit("- "), x["entry"])).alias("_same"))
    joined = body.join(same, "case_id", "left")
    names = F.when(F.col("_same").isNotNull(), lines(f"## {SAME_NAMES}", SAME_NAMES_TEXT, (F.col("_same"),), "")).otherwise(F.array().cast("array<string>"))
    text = lines(TITLE, "", F.when(F.col("_held"), HELD).otherwise(CLEAN), "", (names,), (F.col("_body"),))
    return joined.select("case_id", F.array_join(text, "\n").alias("report"))


def sections(reports_: DataFrame) -> DataFrame:
    """(case_id, heading, section): the parts of reports (case_id, report) under second-level headings, trailing line breaks cut off; of equal headings
    the last one counts. The section of equal names among them is one of them: callers leave it out."""
    parts = reports_.select("case_id", F.posexplode(F.split("report", r"(?<=\n)(?=## )")).alias("_part", "section")).filter(F.startswith("section", F.lit("## ")))  # cut before each heading: no line is a row of its own
    named = parts.select("case_id", "_part", F.substring(F.substring_index("section", "\n", 1), 4, 1 << 30).alias("heading"), F.regexp_replace("section", "\n+$", "").alias("section"))
    return named.groupBy("case_id", "heading").agg(F.max_by("section", "_part").alias("section"))


def with_preserved(fresh: DataFrame, earlier: DataFrame, processed: DataFrame) -> DataFrame:
    """(case_id, report): fresh reports followed by the sections that earlier ones have of documents outside this run (processed: case_id, filename), by
    name; the header is raised to needing review if one of those does."""
    others = sections(earlier).filter(F.col("heading") != SAME_NAMES).join(processed.select("case_id", F.col("filename").alias("heading")), ["case_id", "heading"], "left_anti")
    held = F.contains("section", F.lit("⚠️ 需要人工核实")) | F.contains("section", F.lit("🚨"))
    carried = others.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("heading", "section"))), lambda x: x["section"]).alias("_carried"), F.bool_or(held).alias("_held"))
    body = F.when(F.col("_held"), F.regexp_replace("report", r"(?m)^✅ 所有文档均未发现.*$", HELD)).otherwise(F.col("report"))
    text = F.concat(F.regexp_replace(body, "\n+$", ""), F.lit("\n\n"), F.array_join("_carried", "\n\n"), F.lit("\n"))
    return fresh.join(carried, "case_id", "left").select("case_id", F.when(F.col("_carried").isNull(), F.col("report")).otherwise(text).alias("report"))
