import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import detect
from spanloom.schema import PATTERNS

DIGITS = "0123456789０１２３４５６７８９"


def docs(spark, texts):
    return spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "case_id string, doc_id long, text string")


def found(spark, texts):
    out = {i: [] for i in range(len(texts))}
    for r in detect.structured_spans(docs(spark, texts)).orderBy("doc_id", "seq").collect():
        out[r.doc_id].append((r.entity_type, r.start, r.end, r.confidence))
    return out


def model(text):
    """The rules once more, one text at a time."""
    hits = {k: [m.span() for m in re.finditer(p.replace(r"\p{Nd}", r"\d").replace("[\\dXx]", r"[\dXx]"), text)] for k, p in PATTERNS.items()}

    def valid(s):
        total = sum(int(d) * w for d, w in zip(s, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]))
        last = s[17].upper()
        return "10X98765432"[total % 11] == (str(int(last)) if last.isdigit() else last)

    inside = lambda s: any(a <= s[0] and s[1] <= b for a, b in hits["ID_CARD"])
    out = [("ID_CARD", *s, "high" if valid(text[s[0] : s[1]]) else "low") for s in hits["ID_CARD"]]
    out += [(k, *s, "high") for k in ("PHONE", "BANK_CARD") for s in hits[k] if not inside(s)]
    return out + [(k, *s, "high") for k in ("EMAIL", "BIRTHDATE", "CASE_NUMBER") for s in hits[k]]


def test_examples(spark):
    got = found(spark, ["身份证号:110101199003072316,请核实。", "身份证号:110101199003072315", "拨打13812345678咨询", "1990年3月12日出生", "2024年5月10日立案", "本案已被(2023)最高法民申678号裁定", "", "汇款至6222021234567890123账户"])
    assert got[0] == [("ID_CARD", 5, 23, "high")] and got[1] == [("ID_CARD", 5, 23, "low")] and got[2] == [("PHONE", 2, 13, "high")]
    assert got[3] == [("BIRTHDATE", 0, 12, "high")] and got[4] == [] and got[5] == [("CASE_NUMBER", 4, 19, "high")] and got[6] == []
    assert [g[0] for g in got[7]] == ["ID_CARD", "BANK_CARD"]


def test_offsets_are_code_points(spark):
    assert found(spark, ["😀😀13812345678"])[0] == [("PHONE", 2, 13, "high")]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["1", "3", "138", "１", "8" * 9, "X", "x", "a@b.co", "年", "月", "日出生", "(2024)京", "民初12号", "0105", "1990", "😀", ",", "12345678901234567"]), max_size=14).map("".join), min_size=60, max_size=60))
def test_against_a_sequential_model(spark, texts):
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == model(t), t


def test_lexicon(spark):
    d = docs(spark, ["买方为李四贸易有限公司,卖方为王芳。", "该案由王律师与芳邻物业公司共同处理。", "王芳王芳,王芳", "aaaa"])
    lexicon = spark.createDataFrame([("c", 0, "王芳"), ("c", 1, "李四贸易有限公司"), ("c", 2, "aa"), ("c", 3, ""), ("d", 4, "买方")], "case_id string, ord long, entry string")
    rows = {(r.doc_id, r.start, r.end, r.entity_type) for r in detect.lexicon_spans(d, lexicon).collect()}
    assert rows == {(0, 3, 11, "ORG"), (0, 15, 17, "PERSON"), (2, 0, 2, "PERSON"), (2, 2, 4, "PERSON"), (2, 5, 7, "PERSON"), (3, 0, 2, "PERSON"), (3, 2, 4, "PERSON")}
