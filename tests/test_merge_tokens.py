import random
import re

from spanloom.operators import merge, tokens
from spanloom.schema import LABELS

SPANS = "case_id string, doc_id long, seq long, start int, end int, entity_type string, confidence string, source string"
MAPPING = "case_id string, label string, num int, token string, value string"


def sequential(spans):
    out, cluster, end = [], [], -1
    for s in sorted(spans, key=lambda s: (s[0], s[1])) + [(10**9, 10**9, "", "low")]:
        if cluster and s[0] >= end:
            out.append(min(cluster, key=lambda x: (x[3] != "high", x[1] - x[0])))
            cluster = []
        cluster.append(s)
        end = max(end, s[1]) if len(cluster) > 1 else s[1]
    return out


TOKEN = re.compile(r"⟦([^\d⟧]+)(\d+)⟧")


def test_merge_and_masking(spark, monkeypatch):
    """Merging against the rule said once more; of mapping and masking, the properties that they have to have."""
    monkeypatch.setattr(tokens, "BLOCK", 7)
    rng, docs, spans, prior, disjoint = random.Random(4), [], [], [], {}
    for case in "abcdef":
        if case in "ace":
            prior += [(case, "人名", n, f"⟦人名{n:03d}⟧", v) for n, v in ((2, "张三"), (999, "李"))]
        for i in range(100 * ord(case), 100 * ord(case) + 20):
            text, mine = "".join(rng.choice("张三李四王abc😀 ") for _ in range(rng.randint(0, 40))), []
            for _ in range(rng.randint(0, 8) if text else 0):
                a = rng.randrange(len(text))
                mine.append((a, min(len(text), a + rng.randint(1, 6)), rng.choice([*LABELS, "ODD"]), rng.choice(["high", "low"])))
            docs.append((case, i, text))
            spans += [(case, i, k, *s, "regex") for k, s in enumerate(mine)]
            disjoint[case, i] = [(a, b, kind) for a, b, kind, _ in sequential(mine)]
    d, p = spark.createDataFrame(docs, "case_id string, doc_id long, text string"), spark.createDataFrame(prior, MAPPING)
    values = tokens.valued(d, merge.merged(spark.createDataFrame(spans, SPANS)))
    texts = {(c, i): t for c, i, t in docs}
    uses = sorted((c, i, a, b, kind) for (c, i), s in disjoint.items() for a, b, kind in s)
    assert sorted((r.case_id, r.doc_id, r.start, r.end, r.entity_type) for r in values.collect()) == uses

    mapping = [tuple(r) for r in tokens.extended_mapping(values, p).collect()]
    assert set(prior) <= set(mapping) and len(set(mapping)) == len(mapping)
    by_value, new = {(c, v): t for c, _, _, t, v in mapping}, [m for m in mapping if m not in prior]
    assert len(by_value) == len({(c, t) for c, _, _, t, _ in mapping}) == len(mapping)  # a token stands for one value, a value has one token
    first = {}
    for c, i, a, b, kind in uses:
        first.setdefault((c, texts[c, i][a:b]), (i, a, LABELS.get(kind, "信息")))
    assert set(by_value) == set(first) | {(c, v) for c, _, _, _, v in prior}
    for c in "abcdef":
        for label in {m[1] for m in new if m[0] == c}:
            made = sorted((n, *first[c, v]) for k, la, n, t, v in new if (k, la) == (c, label))
            start = max((n for k, la, n, _, _ in prior if (k, la) == (c, label)), default=0)
            assert [n for n, *_ in made] == list(range(start + 1, start + 1 + len(made)))  # gapless, after what was there
            assert [x[1:3] for x in made] == sorted(x[1:3] for x in made) and {x[3] for x in made} == {label}  # by first use, which gives the label

    out = tokens.masked(d, values, tokens.extended_mapping(values, p))
    shown = {(r.case_id, r.doc_id): r.masked_text for r in out.collect()}
    for (c, i), text in texts.items():
        known = [by_value[c, text[a:b]] for a, b, _ in disjoint[c, i]]
        assert [m[0] for m in TOKEN.finditer(shown[c, i])] == known
        edges = [0, *(x for a, b, _ in disjoint[c, i] for x in (a, b)), len(text)]
        assert TOKEN.split(shown[c, i])[::3] == [text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]  # all else is untouched
    back = tokens.restored(out, tokens.extended_mapping(values, p))
    assert {(r.case_id, r.doc_id): r.restored_text for r in back.collect()} == texts


def test_numbers_grow_past_three_digits(spark):
    values = spark.createDataFrame([("c", 1, 0, 1, "PERSON", "x")], "case_id string, doc_id long, start int, end int, entity_type string, value string")
    prior = spark.createDataFrame([("c", "人名", 999, "⟦人名999⟧", "y")], MAPPING)
    assert {r.token for r in tokens.extended_mapping(values, prior).collect()} == {"⟦人名999⟧", "⟦人名1000⟧"}
