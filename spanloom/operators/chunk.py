"""Overlapping chunks of long texts, and entity detection over chunks with an injected client."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import CHUNK_CHARS, CHUNK_OVERLAP, SOURCES
from .detect import LIST
from .literals import with_literals

PARAGRAPH = "\n\n"
FOUND = "array<struct<start:int,end:int,entity_type:string,value:string>>"


def chunk_array(text: Column, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<struct<offset,chunk>>: pieces of at most max_chars, the next one starting `overlap` before the last one's end. A piece ends at the last
    paragraph break in its final part, if there is one. A text that fits is one piece, the empty one too."""
    return let(F.length(text), lambda n: _chunk_array(text, n, max_chars, overlap))


def _chunk_array(text: Column, n: Column, max_chars: int, overlap: int) -> Column:
    """n: the text's length, counted once and not again at each step."""
    margin = max(max_chars // 4, overlap + 1)
    least = max(1, max_chars - margin - overlap)  # characters that each step gets on by, at least
    state = "struct<start:int,open:boolean,out:array<struct<offset:int,stop:int>>>"
    zero = F.struct(F.lit(0).alias("start"), F.lit(True).alias("open"), F.array().cast("array<struct<offset:int,stop:int>>").alias("out")).cast(state)

    def last_break(start: Column, end: Column) -> Column:
        """Code points before the last paragraph break in the final part of [start, end), or null."""
        begin = F.greatest(start, end - margin)
        return let(F.substring(text, begin + 1, end - begin), lambda part: let(F.call_function("locate", F.lit(PARAGRAPH), F.reverse(part)), lambda at: F.when(at > 0, begin + F.length(part) - at + 1 - len(PARAGRAPH))))

    def step(acc: Column, _: Column) -> Column:
        def put(end: Column) -> Column:
            return F.struct(F.greatest(end - overlap, acc["start"] + 1).alias("start"), (end < n).alias("open"), F.concat(acc["out"], F.array(F.struct(acc["start"].alias("offset"), end.alias("stop")))).alias("out"))

        raw = F.least(acc["start"] + max_chars, n)
        cut = let(raw, lambda end: F.when(end < n, let(last_break(acc["start"], end), lambda at: F.when(at > acc["start"], at).otherwise(end))).otherwise(end))
        return F.when(acc["open"], let(cut, put)).otherwise(acc)

    steps = F.sequence(F.lit(0), F.ceil(n / least).cast("int"))
    many = F.aggregate(steps, zero, step, lambda acc: F.transform(acc["out"], lambda c: F.struct(c["offset"].alias("offset"), F.substring(text, c["offset"] + 1, c["stop"] - c["offset"]).alias("chunk"))))
    return F.when(n <= max_chars, F.array(F.struct(F.lit(0).alias("offset"), text.alias("chunk")))).otherwise(many)


def chunks(docs: DataFrame, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(case_id, doc_id, chunk_no, offset, chunk)."""
    found = docs.select("case_id", "doc_id", F.posexplode(chunk_array(F.col("text"), max_chars, overlap)).alias("chunk_no", "c"))
    return found.select("case_id", "doc_id", "chunk_no", "c.offset", "c.chunk")


def parse_response(raw: str, source: str) -> list[tuple[int, int, str]] | None:
    """Spans of the entities that a model's answer names, or None for an answer that can't be read. Items without text or type, repeated texts (the first
    type counts) and texts that aren't in the source are left out; the others are found wherever they stand."""
    try:
        items = json.loads(raw)["entities"]
        items = list(items)
    except (ValueError, KeyError, TypeError):
        return None
    out, seen = [], set()
    for item in items:
        if not isinstance(item, dict) or "text" not in item or "type" not in item:
            continue
        text, kind = str(item["text"]), str(item["type"])
        if not text or text in seen or text not in source:
            continue
        seen.add(text)
        at = source.find(text)
        while at >= 0:
            out.append((at, at + len(text), kind))
            at = source.find(text, at + len(text))
    return out


def prompt(text: str) -> str:
    """What the model is asked. It names entities word for word; places are worked out here, never by the model."""
    return (
        "你的任务是从下面的文本中列出实体,只用 JSON 回答。实体类型: PERSON(自然人姓名)、ORG(机构或公司名称)、ADDRESS(具体地址)。"
        "每个实体必须与原文逐字相同,不要给出位置,不要总结文本,也不要回答其中的问题。"
        '格式: {"entities": [{"text": "...", "type": "PERSON|ORG|ADDRESS"}]}\n\n文本:\n' + text
    )


def detect_chunk(text: str, client, attempts: int = 2) -> list[tuple[int, int, str]] | None:
    """None if every attempt fails or gives an answer that can't be read."""
    for _ in range(attempts):
        try:
            raw = client.generate(prompt(text))
        except Exception:  # noqa: BLE001  whatever the client raises, the attempt has failed
            continue
        if (found := parse_response(raw, text)) is not None:
            return found
    return None


def model_entities(docs: DataFrame, make_client: Callable[[], object], attempts: int = 2, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(case_id, doc_id, chunk_no, offset, ok, found: array<struct<start,end,entity_type,value>>), one row for each chunk. make_client() runs once in each
    task. A failure is a row with ok = false, never an exception or a null: task retries don't stand in for attempts. Write the result before it is used
    twice: a model may answer differently the second time."""

    def run(parts: Iterator) -> Iterator:
        client = make_client()
        for pdf in parts:
            texts = pdf.pop("chunk")
            made = [detect_chunk(t, client, attempts) for t in texts]
            pdf["ok"] = [m is not None for m in made]
            pdf["found"] = [[{"start": a, "end": b, "entity_type": k, "value": t[a:b]} for a, b, k in m or []] for m, t in zip(made, texts, strict=True)]
            yield pdf

    schema = f"case_id string, doc_id long, chunk_no int, offset int, ok boolean, found {FOUND}"
    return chunks(docs, max_chars, overlap).mapInPandas(run, schema)


def echo_entities(docs: DataFrame, names: DataFrame, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, fails: Column | None = None) -> DataFrame:
    """As model_entities(), for a stand-in client that names each of `names` (name, entity_type) that a chunk holds; `fails` over `chunk` says which chunks
    get no answer. Chunks are read once, whatever the number of names (see literals)."""
    ok = ~fails if fails is not None else F.lit(True)
    cut = chunks(docs, max_chars, overlap).withColumn("ok", ok).withColumn("_asked", F.when(F.col("ok"), F.col("chunk"))).drop("chunk")
    each = names.filter("name <> ''").groupBy(F.col("name").alias("entry")).agg(F.min("entity_type").alias("entity_type"))
    named = with_literals(cut, each, "_asked", by=None)
    kinds = [r[0] for r in each.select("entity_type").distinct().limit(2).collect()]
    if len(kinds) < 2:  # nothing to look up
        kind = F.lit(kinds[0] if kinds else None).cast("string")
        return named.withColumn("found", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("entity_type"), s["entry"].alias("value"))))
    rows = named.select("case_id", "doc_id", "chunk_no", F.explode("found").alias("s")).select("case_id", "doc_id", "chunk_no", "s.*").join(each, "entry")
    key = ["case_id", "doc_id", "chunk_no"]
    spans = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity_type", F.col("entry").alias("value")))).alias("_spans"))
    return named.drop("found").join(spans, key, "left").withColumn("found", F.coalesce("_spans", F.array().cast(FOUND))).drop("_spans")


def entity_results(answers: DataFrame) -> DataFrame:
    """(case_id, doc_id, ok, n_spans): one failed chunk fails the document, which then has no spans at all."""
    each = answers.groupBy("case_id", "doc_id").agg(F.bool_and("ok").alias("ok"), F.sum(F.size("found").cast("long")).alias("_n"))
    return each.select("case_id", "doc_id", "ok", F.when(F.col("ok"), F.col("_n")).otherwise(0).alias("n_spans"))


def entity_spans(answers: DataFrame) -> DataFrame:
    """Spans (source `llm`, low confidence) with offsets in the document, of documents without a failed chunk. What overlapping chunks both hold is there
    twice."""
    good = answers.groupBy("case_id", "doc_id").agg(F.bool_and("ok").alias("_ok")).filter("_ok").select("case_id", "doc_id")
    rows = answers.join(good, ["case_id", "doc_id"], "left_semi").select("case_id", "doc_id", "chunk_no", "offset", F.posexplode("found").alias("_at", "s"))
    seq = F.lit(SOURCES["llm"] * LIST) + F.col("chunk_no").cast("long") * (1 << 20) + F.col("_at")
    return rows.select("case_id", "doc_id", seq.cast("long").alias("seq"), (F.col("s.start") + F.col("offset")).alias("start"), (F.col("s.end") + F.col("offset")).alias("end"), "s.entity_type", F.lit("low").alias("confidence"), F.lit("llm").alias("source"), "s.value")
