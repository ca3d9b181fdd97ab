"""What must not grow with the input: processes of a pass, texts that are matched or shuffled, rows and checks that no result needs."""

import pytest

from spanloom.operators import detect, gate, literals, report, tokens
from spanloom.plans import queries
from spanloom.plans.case import CasePlan

MAPPING = "case_id string, label string, num int, token string, value string"


def docs(spark, texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "case_id string, doc_id long, text string")


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_many_literals_are_one_pass(spark, monkeypatch):
    """However many blocks, one Python process a task."""
    monkeypatch.setattr(literals, "BLOCK_BYTES", 200)
    values = [("c", "信息", i, f"⟦信息{i:03d}⟧", f"值{i:03d}号") for i in range(20)]
    found = gate.mapping_leaks(docs(spark, ["值001号与值019号", None, "值020号", "值007号值007号"]), spark.createDataFrame(values, MAPPING))
    assert {(r.doc_id, r.value) for r in found.collect()} == {(0, "值001号"), (0, "值019号"), (3, "值007号")}
    assert plan_of(found).split("== Physical Plan ==")[1].count("MapInArrow") == 1


def test_texts_without_signs_are_not_matched(spark):
    """A text that cannot hold a match is left out by a filter before any pattern is tried."""
    d = docs(spark, ["无", "a@b.cn", "12345678901", "号", "日出生", None])
    held = plan_of(detect.structured_spans(d)).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    tried = [x for x in held.split("\n") if "Filter" in x]
    assert tried and all(s in tried[-1] for s in ("@", "日出生", "号", detect.DIGITS))
    assert "Filter" in plan_of(detect.pattern_spans(d, "EMAIL")).split("== Optimized Logical Plan ==")[1]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_texts_without_spans_are_not_shuffled(spark, monkeypatch, sent):
    monkeypatch.setattr(tokens, "SENT", sent)
    d = docs(spark, ["张三来", "无", "", None, "李四"]).unionByName(spark.createDataFrame([(None, 0, "张三来"), ("d", 0, "张三来")], "case_id string, doc_id long, text string"))
    values = spark.createDataFrame([("c", 0, 0, 2, "PERSON", "张三"), ("c", 4, 0, 2, "PERSON", "李四")], "case_id string, doc_id long, start int, end int, entity_type string, value string")
    got = tokens.masked(d, values, tokens.extended_mapping(values))
    want = {("c", 0, "⟦人名001⟧来", 1), ("c", 1, "无", 0), ("c", 2, "", 0), ("c", 3, None, 0), ("c", 4, "⟦人名002⟧", 1), (None, 0, "张三来", 0), ("d", 0, "张三来", 0)}
    assert got.count() == len(want) and {tuple(r) for r in got.collect()} == want
    whole, some = tokens._with_spans(d, values)
    assert (whole is None) == (not sent)
    if sent:
        assert whole.count() == 5 and some.count() == 2 and "hashpartitioning(case_id" not in plan_of(whole)


def test_decisions_of_rows(spark):
    """The gate over a row a document says what it says over seven."""
    d, pages, spans, answers, names, tables = (
        spark.createDataFrame(queries.GATE_DOCS, "case_id string, doc_id long"), spark.createDataFrame(queries.GATE_PAGES, "case_id string, doc_id long, source string, n_low int, possible_table boolean"),
        spark.createDataFrame([(*r, "regex") for r in queries.GATE_LOW], "case_id string, doc_id long, confidence string, source string"), spark.createDataFrame(queries.GATE_ANSWERS, "case_id string, doc_id long, ok boolean, n_spans long"),
        spark.createDataFrame(queries.GATE_NAMES, "case_id string, entry string, ord long"), spark.createDataFrame(queries.GATE_TABLES, "case_id string, doc_id long"),
    )
    inputs = (d.unionByName(d.limit(1)), spans, answers, names, pages, tables)  # one document is there twice
    by_row, by_stage = gate.row_decisions(gate.stage_rows(*inputs)), gate.decisions(gate.stage_table(*inputs))
    assert sorted(map(str, by_row.collect())) == sorted(map(str, by_stage.collect()))


def test_reports_before_the_check_look_for_no_leaks(spark, sf_dir, monkeypatch):
    def leaks(_):
        raise AssertionError("looked for leaks")

    monkeypatch.setattr(CasePlan, "leaks", property(leaks))
    assert queries.QUERIES["report_text"](spark, sf_dir).count() > 0


def test_sections_of_a_report_are_not_one_window(spark):
    text = "# t\n\n前\n## a\n一\n### 三\n\n\n## b\n## a\n二\n ## c\n"
    cut = report.sections(spark.createDataFrame([("c", text), ("d", "## x"), ("e", "无"), ("f", None)], "case_id string, report string"))
    assert {tuple(r) for r in cut.collect()} == {("c", "b", "## b"), ("c", "a", "## a\n二\n ## c"), ("d", "x", "## x")}
    assert "Window" not in plan_of(cut)
