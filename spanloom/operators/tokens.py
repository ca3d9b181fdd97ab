"""Stable tokens for the values of a case, masking, and its way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import label, token, token_label, token_number

#: Documents whose new values are numbered together in one task.
BLOCK = 10_000
#: Hashes of documents with spans, at most, that are sent to all executors; beyond it all texts are joined by a shuffle.
SENT = 1_000_000


def valued(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Disjoint spans with the text that they cover: what the detectors have put there, else cut from the texts."""
    if "value" in spans.columns:
        return spans
    return spans.join(docs.select("case_id", "doc_id", "text"), ["case_id", "doc_id"]).withColumn("value", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")


def extended_mapping(values: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """mapping: prior rows, and a token for each new value of a case. The first occurrence (by doc_id, then start) decides the label; numbers go on from
    the largest of the label in the case. Values are reduced to distinct ones before they are ordered, and a case's are numbered block by block of
    documents, so a large case isn't one task."""
    first = values.groupBy("case_id", "value").agg(F.min(F.struct("doc_id", "start", "entity_type")).alias("f")).select("case_id", "value", "f.*")
    if prior is not None:
        first = first.join(prior.select("case_id", "value"), ["case_id", "value"], "left_anti")
    new = first.withColumns({"label": label(F.col("entity_type")), "_block": F.floor(F.col("doc_id") / BLOCK)})
    by = ["case_id", "label"]
    sizes = new.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = new.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "_block").orderBy("doc_id", "start"))).join(before, [*by, "_block"])
    if prior is None:
        numbered = numbered.withColumn("_top", F.lit(0))
    else:
        top = prior.select("case_id", token_label(F.col("token")).alias("label"), token_number(F.col("token")).alias("_k")).groupBy(*by).agg(F.max("_k").alias("_top"))
        numbered = numbered.join(top, by, "left")
    num = (F.coalesce("_top", F.lit(0)) + F.col("_before") + F.col("_rank")).cast("int")
    out = numbered.select("case_id", "label", num.alias("num"), token(F.col("label"), num).alias("token"), "value")
    return out if prior is None else prior.select("case_id", "label", F.col("num").cast("int").alias("num"), "token", "value").unionByName(out)


def masked(docs: DataFrame, values: DataFrame, mapping: DataFrame) -> DataFrame:
    """(case_id, doc_id, masked_text, n_spans): texts with each span replaced by its value's token, all else untouched."""
    one = mapping.groupBy("case_id", "value").agg(F.max_by("token", F.struct("num", "token")).alias("token"))  # a prior mapping may hold a value twice
    parts = values.join(one, ["case_id", "value"]).groupBy("case_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "token"))).alias("_parts"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole, some = _with_spans(docs.select("case_id", "doc_id", "text"), values)
    joined = some.join(parts, ["case_id", "doc_id"], "left")
    text = F.col("text")
    fold = F.aggregate(
        F.coalesce("_parts", F.array().cast("array<struct<start:int,end:int,token:string>>")),
        zero,
        lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["token"])).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    out = joined.select("case_id", "doc_id", fold.alias("masked_text"), F.coalesce(F.size("_parts"), F.lit(0)).alias("n_spans"))
    return out if whole is None else out.unionByName(whole.select("case_id", "doc_id", F.col("text").alias("masked_text"), F.lit(0).alias("n_spans")))


def _with_spans(docs: DataFrame, values: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """docs without spans, and the others. Told apart by hashes of the keys that have spans, so that texts without any are not shuffled; one whose hash is
    that of another is merely among the others. None and all of them if there are too many hashes to send."""
    hashed = F.xxhash64("case_id", "doc_id").alias("_hash")
    sent = values.select(hashed).distinct()
    if sent.count() > SENT:
        return None, docs
    each, sent = docs.select("*", hashed), F.broadcast(sent)
    return each.join(sent, "_hash", "left_anti").drop("_hash"), each.join(sent, "_hash", "left_semi").drop("_hash")


def restored(texts: DataFrame, mapping: DataFrame, text: str = "masked_text") -> DataFrame:
    """texts with the tokens of the mapping put back. An extension; a text that held token-like strings before masking can't be told apart."""
    known = mapping.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_known"))
    pattern = r"⟦[^\p{Nd}⟧]+\p{Nd}+⟧"
    joined = texts.join(known, "case_id", "left")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    back = F.zip_with(between, F.concat(F.transform(found, lambda t: F.coalesce(F.try_element_at("_known", t), t)), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return joined.withColumn("restored_text", F.array_join(back, "")).drop("_known")
