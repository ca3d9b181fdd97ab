"""The engine's queries over the driver's tables, and over inline rows where those hold no such text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import id_checksum_ok, name_type
from ..operators import chunk, detect, gate, layout, merge, report, scoring, tokens
from .case import CasePlan
from .staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Inline texts with structured data that the tables don't hold.
TEXTS = [
    (1, "身份证号:110101199003072316,请核实。"), (2, "身份证号:110101199003072315,请核实。"), (3, "如有疑问请拨打13812345678进行咨询。"), (4, "汇款至6222021234567890123账户。"),
    (5, "联系邮箱 zhangsan@example.com 谢谢。"), (6, "案号:(2024)京0105民初123456789012345678号"), (7, "请于5日内提交材料,共3份。"), (8, "原告张三,男,1990年3月12日出生,住北京市朝阳区。"),
    (9, "本案于2024年5月10日立案受理。"), (10, "案号:(2024)京0105民初12345号,原告诉称..."), (11, "本案已被(2023)最高法民申678号裁定驳回。"), (12, "卡号６２２２０２１２３４５６７８９０及4316522678525456"), (13, "😀身份证11010119900307211x,电话１3812345678"), (14, ""),
]
BOXES = {"grid": [0.1, 0.5] * 3, "margin": [0.1] * 6, "two_rows": [0.1, 0.5] * 2, "jitter": [0.098, 0.499, 0.1, 0.5, 0.102, 0.501], "chain": [0.1, 0.115, 0.13, 0.145, 0.16, 0.175], "one": [0.3]}
LINES = [(1, 0, "右上", 0.98, 0.6, 0.9001), (1, 1, "左上", 0.3, 0.1, 0.9002), (1, 2, "下", 0.5, 0.1, 0.2), (2, 0, "唯一", 0.4999, 0.0, 0.5)]
LAYERS = [(1, "这一页有足够多的文字层内容可以直接采用不必识别", [100]), (2, "短", []), (3, "这一页有足够多的文字层内容但是也有一张很大的图片", [39_999, 40_000]), (4, "   \n\t 很短的文字层   \n", [1_000_000]), (5, "这一页有足够多的文字层内容而且没有任何图片存在", [])]
PAGES = [(1, 1, "第一页", "text_layer"), (1, 2, "第二页", "ocr"), (1, 10, "第十页", "mixed"), (2, 1, "", "failed")]
NAMES = [(1, "张三"), (2, "李四贸易有限公司"), (3, "  张三 "), (4, "王芳"), (5, "李四贸易有限公司\t"), (6, "第一人民医院"), (7, ""), (8, "鸿运电子厂")]
STAGES = [(1, 0, "ocr", True, 0), (1, 1, "regex", True, 0), (2, 0, "ocr", True, 0), (2, 1, "regex", True, 2), (3, 0, "llm", False, 0), (4, 0, "ocr", True, 1), (4, 1, "llm", False, 5)]
#: Masked texts of two cases with residues of every kind, the mapping and the lists that they are held against. One doc_id is in both cases.
RESIDUES = [
    ("甲案", 1, "⟦人名001⟧与⟦机构001⟧签约,无其他内容。"), ("甲案", 2, "⟦人名001⟧即周启明,再见周启明。"), ("甲案", 3, "新留电话13912345678,邮箱 left@over.cn,证件110101199003072316"),
    ("甲案", 4, "另有白云贸易有限公司在场"), ("甲案", 5, "周启明、白云贸易有限公司、13912345678"), ("乙案", 1, "乙案不认识周启明"), ("乙案", 2, "林晓与林晓峰"), ("乙案", 6, ""),
]
RESIDUE_MAPPING = [("甲案", "人名", 1, "⟦人名001⟧", "周启明"), ("甲案", "机构", 1, "⟦机构001⟧", "白云贸易有限公司"), ("乙案", "人名", 1, "⟦人名001⟧", "林晓"), ("乙案", "人名", 2, "⟦人名002⟧", "")]
RESIDUE_LIST = [("甲案", 0, "白云贸易有限公司"), ("乙案", 0, "林晓峰"), ("乙案", 1, "林晓峰"), ("乙案", 2, "林晓")]
#: Pages, files with tables of their own, and entity results of documents of two cases.
GATE_DOCS = [("甲案", 1), ("甲案", 2), ("甲案", 3), ("乙案", 1), ("乙案", 2)]
GATE_PAGES = [("甲案", 1, "text_layer", 0, False), ("甲案", 1, "ocr", 2, False), ("甲案", 2, "failed", 0, False), ("甲案", 2, "mixed", 1, True), ("乙案", 1, "ocr", 0, True), ("乙案", 1, "text_layer", 7, False)]
GATE_TABLES = [("甲案", 3), ("乙案", 1)]
GATE_ANSWERS = [("甲案", 1, True, 0), ("甲案", 2, True, 3), ("甲案", 3, False, 0), ("乙案", 1, True, 0)]
GATE_NAMES = [("甲案", "王芳", 0)]
GATE_LOW = [("甲案", 3, "low"), ("乙案", 2, "low"), ("乙案", 2, "high")]
REPORT_OLD = "# 脱敏处理报告\n\n✅ 所有文档均未发现需要人工核实的内容,可以直接批准导出。\n\n## a.txt\n状态: ✅ 未发现需要人工核实的内容\n本文档共替换 1 处敏感信息。\n\n## b.txt\n状态: ⚠️ 需要人工核实\n- llm 发现 2 处需人工核实的疑似内容\n本文档共替换 2 处敏感信息。\n"
REPORT_NEW = "# 脱敏处理报告\n\n✅ 所有文档均未发现需要人工核实的内容,可以直接批准导出。\n\n## a.txt\n状态: ✅ 未发现需要人工核实的内容\n本文档共替换 3 处敏感信息。\n"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), "doc_id", "text")


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as the list of every case."""
    cases = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id")).distinct()
    return cases.crossJoin(F.broadcast(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("entry"))))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stand-in entity detector knows: the first four words of each passage."""
    return table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("name"), F.lit("ADDRESS").alias("entity_type"))


def plan(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, prior: DataFrame | None = None) -> CasePlan:
    docs = documents(spark, sf_dir) if docs is None else docs
    return CasePlan(docs, lexicon(spark, sf_dir), chunk.echo_entities(docs, names(spark, sf_dir)), prior)


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("case_id", F.lit("c"))


def shown(spans: DataFrame) -> DataFrame:
    return spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})


def _pattern(name: str, entity_type: str, inline: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = fixture(spark) if inline else documents(spark, sf_dir)
        return shown(detect.pattern_spans(docs, entity_type)).select("doc_id", "span_start", "span_end", "value")

    QUERIES[name] = run


for _name, _type, _inline in (
    ("span_phone", "PHONE", False), ("span_bank", "BANK_CARD", False), ("span_email", "EMAIL", False), ("span_phone_fixture", "PHONE", True), ("span_bank_fixture", "BANK_CARD", True), ("span_email_fixture", "EMAIL", True),
    ("span_id_fixture", "ID_CARD", True), ("span_birthdate_fixture", "BIRTHDATE", True), ("span_case_number_fixture", "CASE_NUMBER", True),
):
    _pattern(_name, _type, _inline)


@query
def id_checksum_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.pattern_spans(fixture(spark), "ID_CARD").select("doc_id", "value", id_checksum_ok(F.col("value")).alias("valid"))


@query
def span_structured_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.structured_spans(fixture(spark))).select("doc_id", "span_start", "span_end", "entity_type", "confidence")


@query
def span_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.structured_spans(documents(spark, sf_dir))).select("doc_id", "span_start", "span_end", "entity_type", "confidence")


@query
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(plan(spark, sf_dir).spans).select("doc_id", "source", "span_start", "span_end", "entity_type", "confidence")


@query
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.islands(plan(spark, sf_dir).spans)
    return found.groupBy("doc_id", "island").agg(F.min("start").alias("island_start"), F.max("end").alias("island_end"), F.count("*").alias("n")).withColumn("island", F.col("island").cast("long"))


@query
def span_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(plan(spark, sf_dir).merged).select("doc_id", "source", "span_start", "span_end", "entity_type", "confidence")


@query
def token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).mapping


@query
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).masked


@query
def masked_text_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, the second with the mapping of the first: the same as in one go."""
    docs = documents(spark, sf_dir).crossJoin(F.broadcast(table(spark, sf_dir, "documents").agg(F.avg("doc_id").alias("_half"))))
    early, late = (docs.filter(c).drop("_half") for c in (F.col("doc_id") <= F.col("_half"), F.col("doc_id") > F.col("_half")))
    one = plan(spark, sf_dir, early)
    return one.masked.unionByName(plan(spark, sf_dir, late, one.mapping).masked)


@query
def restored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    return tokens.restored(p.masked, p.mapping).select("doc_id", "restored_text")


@query
def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.lexicon_spans(documents(spark, sf_dir), lexicon(spark, sf_dir))).select("doc_id", "span_start", "span_end", "entity_type")


@query
def lexicon_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(NAMES, "ord long, entry string").select("ord", name_type(F.col("entry")).alias("entity_type"))


@query
def lexicon_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.duplicate_entries(spark.createDataFrame(NAMES, "ord long, entry string").withColumn("case_id", F.lit("c")))


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunks(documents(spark, sf_dir)).select("doc_id", "chunk_no", F.col("offset").alias("chunk_start"), F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query
def chunks_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their closing tags as paragraph breaks, so that chunks end at them."""
    docs = table(spark, sf_dir, "pages").select(F.lit("c").alias("case_id"), F.col("page_id").alias("doc_id"), F.replace("html", F.lit("</p>"), F.lit("\n\n")).alias("text"))
    return chunk.chunks(docs, 1200, 150).select("doc_id", "chunk_no", F.col("offset").alias("chunk_start"), F.length("chunk").alias("n_chars"))


@query
def entity_spans_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk.entity_spans(chunk.echo_entities(documents(spark, sf_dir), names(spark, sf_dir)))
    return shown(found).select("doc_id", "span_start", "span_end", "entity_type", "confidence")


@query
def entity_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in gives no answer for chunks with an at sign."""
    answers = chunk.echo_entities(documents(spark, sf_dir), names(spark, sf_dir), fails=F.contains("chunk", F.lit("@")))
    return chunk.entity_results(answers).select("doc_id", "ok", F.col("n_spans").cast("long").alias("n_spans"))


@query
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).stages.drop("case_id")


@query
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).decisions.select("doc_id", "auto_export", F.array_join("reasons", "|").alias("reasons"))


@query
def export_gate_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.decisions(spark.createDataFrame(STAGES, "doc_id long, ord int, name string, ok boolean, low_n long").withColumn("case_id", F.lit("c"))).select("doc_id", "auto_export", F.array_join("reasons", "|").alias("reasons"))


@query
def stage_counts_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven stages with something to tell, of documents whose ids are in two cases."""
    docs = spark.createDataFrame(GATE_DOCS, "case_id string, doc_id long")
    pages = spark.createDataFrame(GATE_PAGES, "case_id string, doc_id long, source string, n_low int, possible_table boolean")
    spans = spark.createDataFrame(GATE_LOW, "case_id string, doc_id long, confidence string").withColumn("source", F.lit("regex"))
    answers = spark.createDataFrame(GATE_ANSWERS, "case_id string, doc_id long, ok boolean, n_spans long")
    names_ = spark.createDataFrame(GATE_NAMES, "case_id string, entry string, ord long")
    return gate.stage_table(docs, spans, answers, names_, pages, spark.createDataFrame(GATE_TABLES, "case_id string, doc_id long"))


@query
def export_gate_cases_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.decisions(stage_counts_fixture(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", "|"))


def _residues(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    texts = spark.createDataFrame(RESIDUES, "case_id string, doc_id long, text string")
    mapping = spark.createDataFrame(RESIDUE_MAPPING, "case_id string, label string, num int, token string, value string")
    return texts, staged(gate.leaks(texts, mapping, spark.createDataFrame(RESIDUE_LIST, "case_id string, ord long, entry string")), "residues")


@query
def leak_check_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residues(spark)[1].groupBy("case_id", "doc_id", "check_no", "value", "message").agg(F.count("*").alias("n"))


@query
def approve_split_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = gate.split_by_leaks(*_residues(spark))
    return good.select("case_id", "doc_id", F.lit(True).alias("approved")).unionByName(bad.select("case_id", "doc_id", F.lit(False).alias("approved")))


@query
def report_leaks_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the part on leaks: one message a document, as their order among equals of one kind is no one's concern."""
    texts, found = _residues(spark)
    told = found.groupBy("case_id", "doc_id").agg(F.sort_array(F.collect_set("message")).alias("leaks"))
    none = "array<struct<page_number:int,reason:string>>", "array<struct<page_number:int,image:string,lines:array<struct<text:string,confidence:double>>>>"
    rows = texts.join(told, ["case_id", "doc_id"], "left").select(
        "case_id", F.col("doc_id").alias("ord"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(True).alias("auto_export"), F.array().cast("array<string>").alias("reasons"), F.lit(2).cast("long").alias("mapping_size"),
        F.coalesce("leaks", F.array().cast("array<string>")).alias("leaks"), F.array().cast(none[0]).alias("failed_pages"), F.array().cast(none[1]).alias("flagged_pages"),
    )
    return report.reports(rows, spark.createDataFrame([], "case_id string, entry string, ord long"))


@query
def leak_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped values against the unmasked texts: each must be found where it came from."""
    p = plan(spark, sf_dir)
    return gate.mapping_leaks(p.docs, p.mapping).select("doc_id", "value")


@query
def leak_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.structured_spans(plan(spark, sf_dir).candidates)).select("doc_id", "span_start", "span_end", "entity_type")


@query
def leak_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(detect.lexicon_spans(plan(spark, sf_dir).candidates, lexicon(spark, sf_dir))).select("doc_id", "span_start", "span_end")


@query
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).leaks.groupBy("doc_id", "check_no", "value", "message").agg(F.count("*").alias("n"))


@query
def approve_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = plan(spark, sf_dir).approved()
    return good.select("doc_id", F.lit(True).alias("approved")).unionByName(bad.select("doc_id", F.lit(False).alias("approved")))


@query
def case_all_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).clean_cases


def _plain_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    return report.reports(p.unchecked_report_rows, p.duplicates)


@query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_reports(spark, sf_dir)


@query
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sections(_plain_reports(spark, sf_dir))


@query
def report_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda t: spark.createDataFrame([("c", t)], "case_id string, report string")
    return report.with_preserved(made(REPORT_NEW), made(REPORT_OLD), spark.createDataFrame([("c", "a.txt")], "case_id string, filename string"))


@query
def table_flag_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_pages(spark.createDataFrame([(k, x) for k, v in BOXES.items() for x in v], "page_id string, left double"))


@query
def reading_order_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(LINES, "page_id long, n int, text string, confidence double, left double, bottom double")
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("n", "text", "confidence", "left", "bottom"))).alias("lines"))
    return pages.select("page_id", layout.reading_order(F.col("lines")).alias("text"))


@query
def ocr_low_conf_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(LINES, "page_id long, n int, text string, confidence double, left double, bottom double")
    pages = rows.groupBy("page_id").agg(F.collect_list(F.struct("text", "confidence")).alias("lines"))
    return pages.select("page_id", F.explode(layout.low_confidence(F.col("lines"))).alias("x")).select("page_id", "x.text", "x.confidence")


@query
def page_router_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(LAYERS, "page_id long, layer string, areas array<int>")
    route = layout.page_route(F.col("layer"), F.col("areas"))
    return rows.select("page_id", route.alias("route"), layout.routed_text(route, F.col("layer"), F.lit("识别")).alias("text"))


@query
def page_concat_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_pages(spark.createDataFrame(PAGES, "doc_id long, page_number int, text string, source string"))


@query
def case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("case_id").distinct()


def _truths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected: e-mail addresses and phones (identity), passages (standard) of each document. Found: the values that were masked, in two runs, the second
    without the entity detector's."""
    p = plan(spark, sf_dir)
    key = F.col("doc_id").cast("string").alias("doc")
    identity = detect.pattern_spans(p.docs, "EMAIL").unionByName(detect.pattern_spans(p.docs, "PHONE")).select(key, F.lit("identity").alias("category"), F.col("value").alias("gt_text"))
    listed = p.spans.filter("source = 'lexicon'").select(key, F.lit("standard").alias("category"), F.col("value").alias("gt_text"))
    second = merge.merged(p.spans.filter("source <> 'llm'"))
    found = p.values.select(key, F.lit(1).alias("run"), "value").unionByName(second.select(key, F.lit(2).alias("run"), "value"))
    return identity.unionByName(listed).distinct(), found


@query
def recall_every_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.caught(*_truths(spark, sf_dir))


@query
def recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recall(scoring.caught(*_truths(spark, sf_dir)))


@query
def over_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.over_masked(*_truths(spark, sf_dir))
