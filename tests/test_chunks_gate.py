import json
import re

import pytest

from spanloom.operators import chunk, gate, layout, report, scoring
from spanloom.plans.case import CasePlan, check_case_name


def check_chunks(text, cut, size, overlap):
    """What has to hold of a text's (offset, chunk) rows."""
    ends = [at + len(c) for at, c in cut]
    assert all(text[at:end] == c for (at, c), end in zip(cut, ends)) and cut[0][0] == 0 and ends[-1] == len(text)
    assert (len(cut) == 1) == (len(text) <= size) and all(len(c) <= size for _, c in cut)
    assert [at for at, _ in cut[1:]] == [max(end - overlap, at + 1) for (at, _), end in zip(cut, ends[:-1])]
    breaks = [m.start() for m in re.finditer("(?=\n\n)", text)]
    for (at, _), end in zip(cut, ends[:-1]):  # the last paragraph break of the final part, or the full size
        tail = at + size - max(size // 4, overlap + 1)
        assert end == max((b for b in breaks if max(at + 1, tail) <= b <= at + size - 2), default=at + size)


def docs(spark, texts, case="c"):
    return spark.createDataFrame([(case, i, t) for i, t in enumerate(texts)], "case_id string, doc_id long, text string")


@pytest.mark.parametrize(("size", "overlap"), [(1200, 150), (500, 490), (10, 3)])
def test_chunks(spark, size, overlap):
    import random

    rng = random.Random(size)
    texts = ["甲" * 5000, "第一段内容。" * 50 + "\n\n" + "第二段内容。" * 50, "", "短", *("".join(rng.choice(["a", "b😀", "\n", "\n\n", "\n\n\n"]) for _ in range(rng.randint(0, 700))) for _ in range(30))]
    got = {}
    for r in chunk.chunks(docs(spark, texts), size, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.chunk))
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        check_chunks(t, got[i], size, overlap)


class Answers:
    def __init__(self, *given):
        self.given = list(given)

    def generate(self, _):
        x = self.given.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


GOOD = json.dumps({"entities": [{"text": "张三", "type": "PERSON"}, {"text": "张三", "type": "ORG"}, {"text": "不在", "type": "ORG"}, {"type": "ORG"}, 3]})


def test_model_answers():
    assert chunk.detect_chunk("张三与张三", Answers("not json", GOOD)) == [(0, 2, "PERSON"), (3, 5, "PERSON")]
    assert chunk.detect_chunk("张三", Answers("x", ValueError())) is None
    assert chunk.parse_response('{"entities": null}', "x") is None


class Echo:
    def generate(self, text):
        if "坏" in text.split("文本:")[-1]:
            raise ConnectionError
        return json.dumps({"entities": [{"text": n, "type": "PERSON"} for n in ("张三", "李四") if n in text]})


def test_one_failed_chunk_fails_the_document(spark):
    d = docs(spark, ["甲" * 90 + "张三" + "乙" * 30, "李四" + "甲" * 150 + "坏", "无"])
    answers = chunk.model_entities(d, Echo, max_chars=100, overlap=20)
    assert {(r.doc_id, r.ok, r.n_spans) for r in chunk.entity_results(answers).collect()} == {(0, True, 2), (1, False, 0), (2, True, 0)}
    assert {(r.doc_id, r.start, r.end, r.confidence) for r in chunk.entity_spans(answers).collect()} == {(0, 90, 92, "low")}


def test_gate_names_all_reasons(spark):
    rows = [(1, 0, "ocr", True, 0), (2, 0, "ocr", True, 3), (2, 1, "llm", False, 9), (3, 0, "llm", False, 0)]
    got = {r.doc_id: (r.auto_export, r.reasons) for r in gate.decisions(spark.createDataFrame([("c", *r) for r in rows], "case_id string, doc_id long, ord int, name string, ok boolean, low_n long")).collect()}
    assert got[1] == (True, []) and got[2] == (False, ["ocr 发现 3 处需人工核实的疑似内容", "llm 检测未能正常完成,需人工确认"]) and got[3][0] is False


def test_literals_against_search(spark, monkeypatch):
    import random

    from spanloom.operators import literals

    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("ab😀甲") for _ in range(n))
    entries = [(c, e) for c in "xy" for e in {text(rng.randint(0, 4)) for _ in range(40)}] + [("x", None)]
    rows = [("xyz"[i % 3], i, text(rng.randint(0, 60)) if i else None) for i in range(40)]
    d, e = spark.createDataFrame(rows, "case_id string, doc_id long, text string"), spark.createDataFrame(entries, "case_id string, entry string")
    for size in (8 << 20, 700):  # one block, several
        monkeypatch.setattr(literals, "BLOCK_BYTES", size)
        got = {r.doc_id: sorted((s.start, s.end, s.entry) for s in r.found) for r in literals.with_literals(d, e).collect()}
        assert got == {i: sorted((m.start(), m.end(), w) for k, w in entries if k == c and w for m in re.finditer(re.escape(w), t or "")) for c, i, t in rows}
    assert literals.with_literals(d, e.limit(0)).filter("size(found) > 0").count() == 0


def test_leaks_and_approval(spark):
    texts = docs(spark, ["干净的⟦人名001⟧", "还有张三", "新号码13812345678", "漏了李四公司", "邮箱a@b.cn"])
    mapping = spark.createDataFrame([("c", "人名", 1, "⟦人名001⟧", "张三"), ("d", "人名", 1, "⟦人名001⟧", "干净"), ("c", "人名", 2, "⟦人名002⟧", "")], "case_id string, label string, num int, token string, value string")
    lexicon = spark.createDataFrame([("c", 0, "李四公司")], "case_id string, ord long, entry string")
    found = gate.leaks(texts, mapping, lexicon)
    assert {(r.doc_id, r.check_no, r.value) for r in found.collect()} == {(1, 1, "张三"), (2, 2, "13812345678"), (3, 3, "李四公司"), (4, 2, "a@b.cn")}
    good, bad = gate.split_by_leaks(texts, found)
    assert [r.doc_id for r in good.collect()] == [0] and bad.count() == 4


def test_whole_case(spark):
    d = docs(spark, ["张三电话13812345678", "张三再来", "李四"])
    lexicon = spark.createDataFrame([("c", 0, "张三"), ("c", 1, "李四"), ("c", 2, "李四 ")], "case_id string, ord long, entry string")
    plan = CasePlan(d, lexicon, chunk.echo_entities(d, spark.createDataFrame([("无", "PERSON")], "name string, entity_type string")))
    assert {r.doc_id: r.masked_text for r in plan.masked.collect()} == {0: "⟦人名001⟧电话⟦电话001⟧", 1: "⟦人名001⟧再来", 2: "⟦人名002⟧"}
    assert [r.entry for r in plan.duplicates.collect()] == ["李四"]
    assert not plan.clean_cases.first().all_clean  # the name that is listed twice holds all of them back
    text = plan.reports.first().report
    assert text.startswith("# 脱敏处理报告\n\n⚠️ 有文档需要人工核实") and "- 李四\n" in text and "本文档共替换 3 处敏感信息。" in text
    pages = spark.createDataFrame([("c", 0, "failed", 0, False), ("c", 1, "ocr", 2, True), ("c", 1, "text_layer", 5, False), ("other", 2, "failed", 9, True)], "case_id string, doc_id long, source string, n_low int, possible_table boolean")
    stages = {(r.doc_id, r.ord): (r.ok, r.low_n) for r in CasePlan(d, lexicon, plan.answers, pages=pages).stages.collect()}
    assert stages[0, 1] == (False, 0) and stages[1, 0] == (True, 2) and stages[1, 2] == (True, 1) and stages[2, 3] == (True, 1)


def test_report_parts(spark):
    row = ("c", 1, "a.pdf", False, ["r1", "r2"], 3, ["l1"], [(2, "坏页")], [(1, "p.png", [("字", 0.3)]), (4, None, [("x", 0.456)]), (5, None, [])])
    schema = "case_id string, ord long, filename string, auto_export boolean, reasons array<string>, mapping_size long, leaks array<string>, failed_pages array<struct<page_number:int,reason:string>>, flagged_pages array<struct<page_number:int,image:string,lines:array<struct<text:string,confidence:double>>>>"
    text = report.reports(spark.createDataFrame([row], schema), spark.createDataFrame([], "case_id string, entry string, ord long")).first().report
    for part in ("## a.pdf\n### 🚨", "- l1\n\n状态: ⚠️ 需要人工核实\n- r1\n- r2\n本文档共替换 3 处敏感信息。\n\n### ⚠️ 处理失败", "- 第 2 页处理失败: 坏页", "- 第 1 页,原图: p.png\n  - 可疑文字(置信度 0.30): 「字」\n- 第 4 页,(未保存原图)\n  - 可疑文字(置信度 0.46): 「x」\n如发现"):
        assert part in text


def test_recall(spark):
    expected = spark.createDataFrame([("a", "identity", "张三"), ("a", "standard", "某地"), ("b", "identity", "李四")], "doc string, category string, gt_text string")
    found = spark.createDataFrame([("a", 1, "张三丰"), ("a", 2, "张三"), ("a", 1, "某地"), ("a", 2, "别处"), ("b", 1, None)], "doc string, run int, value string")
    hits = scoring.caught(expected, found)
    assert {(r.gt_text, r.hit) for r in hits.collect()} == {("张三", True), ("某地", False), ("李四", False)}
    assert {(r.category, r.recalled, r.total, r.passed) for r in scoring.recall(hits).collect()} == {("identity", 1, 2, False), ("standard", 0, 1, False)}
    assert {r.value for r in scoring.over_masked(expected, found).collect()} == {"别处"}
    assert {r.recall for r in scoring.recall(hits.limit(0)).collect()} == {1.0}


def test_layout(spark):
    tsv = "h\n" + "\n".join("\t".join(map(str, r)) for r in [(1, 0, 0, 0, 0, 0, 0, 0, 100, 200, -1), *((5, 0, 0, 0, 0, 0, x, 1, 5, 5, 90) for x in (10, 50) * 3), ("5", "short"), (5, 0, 0, 0, 0, 0, "x", 1, 5, 5, 90)])
    df = spark.createDataFrame([(tsv,)], "t string").select(layout.normalised_boxes(__import__("pyspark").sql.functions.col("t")).alias("b"))
    assert df.first().b == [0.1, 0.5] * 3


@pytest.mark.parametrize("name", ["", "  ", "a/b", "a\\b", ".."])
def test_case_names(name):
    with pytest.raises(ValueError):
        check_case_name(name)
