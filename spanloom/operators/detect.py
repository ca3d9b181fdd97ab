"""Detectors: text to spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import id_checksum_ok, name_type, regex_offsets
from ..schema import PATTERNS, SOURCES
from .literals import with_literals

#: Order of spans: source, then place in the source's list.
LIST = 1 << 40
#: What a text has to hold for a pattern to match in it. Few texts do, and looking for it is far cheaper than matching.
DIGITS = r"\p{Nd}{11}"
SIGNS = {"EMAIL": "@", "BIRTHDATE": "日出生", "CASE_NUMBER": "号"}
OFFSETS = "array<struct<start:int,end:int>>"


def may_hold(text: Column, entity_type: str) -> Column:
    """Whether a text can hold a match of the pattern: ids, phones and cards are 11 digits in a row at least, the others have a sign of their own."""
    return F.contains(text, F.lit(SIGNS[entity_type])) if entity_type in SIGNS else F.regexp_like(text, F.lit(DIGITS))


def _offsets(text: Column, entity_type: str) -> Column:
    return F.when(may_hold(text, entity_type), regex_offsets(text, PATTERNS[entity_type])).otherwise(F.array().cast(OFFSETS))


def _typed(found: Column, entity_type: str, confidence) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(entity_type).alias("entity_type"), confidence(s).alias("confidence")))


def structured_array(text: Column, ids: Column, phones: Column) -> Column:
    """All structured spans of a text as one array, in reporting order. Phones within an id are left out, cards within an id too, and cards that are a
    phone. ids and phones are columns that hold the offsets of those patterns."""
    high = lambda s: F.lit("high")
    in_id = lambda s: F.exists(ids, lambda i: (i["start"] <= s["start"]) & (s["end"] <= i["end"]))
    own_phones = F.filter(phones, lambda s: ~in_id(s))
    cards = F.filter(_offsets(text, "BANK_CARD"), lambda s: ~in_id(s) & ~F.exists(phones, lambda p: (p["start"] == s["start"]) & (p["end"] == s["end"]) & ~in_id(p)))
    checked = lambda s: F.when(id_checksum_ok(F.substring(text, s["start"] + 1, s["end"] - s["start"])), "high").otherwise("low")
    rest = [_typed(_offsets(text, t), t, high) for t in SIGNS]
    return F.concat(_typed(ids, "ID_CARD", checked), _typed(own_phones, "PHONE", high), _typed(cards, "BANK_CARD", high), *rest)


def structured_spans(docs: DataFrame) -> DataFrame:
    """documents to spans of the structured detectors (source `regex`), with the value that each covers, so that no later step has to join the texts for it.
    Narrow: no shuffle, no Python. Texts that no pattern can match in are left out before any is tried."""
    some = reduce(Column.__or__, [may_hold(F.col("text"), t) for t in (*SIGNS, "PHONE")])
    held = docs.select("case_id", "doc_id", "text").filter(some).select("case_id", "doc_id", "text", _offsets(F.col("text"), "ID_CARD").alias("_ids"), _offsets(F.col("text"), "PHONE").alias("_phones"))
    found = held.select("case_id", "doc_id", "text", F.posexplode(structured_array(F.col("text"), F.col("_ids"), F.col("_phones"))).alias("_at", "s"))
    return found.select("case_id", "doc_id", F.col("_at").cast("long").alias("seq"), "s.start", "s.end", "s.entity_type", "s.confidence", F.lit("regex").alias("source"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def pattern_spans(docs: DataFrame, entity_type: str) -> DataFrame:
    """Raw matches of one pattern, before suppression."""
    held = docs.select("case_id", "doc_id", "text").filter(may_hold(F.col("text"), entity_type))
    return held.select("case_id", "doc_id", "text", F.explode(regex_offsets(F.col("text"), PATTERNS[entity_type])).alias("s")).select("case_id", "doc_id", "s.start", "s.end", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


def lexicon_spans(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every non-overlapping occurrence of every entry of the case's list, entry by entry; empty entries match nothing. One row for each list row: a
    repeated entry reports twice, as it stands in the list twice."""
    listed = lexicon.filter(F.length("entry") > 0).select("case_id", "ord", "entry")
    found = with_literals(docs.select("case_id", "doc_id", "text"), listed).filter(F.size("found") > 0).select("case_id", "doc_id", F.explode("found").alias("s"))
    order = W.partitionBy("case_id", "doc_id", "entry").orderBy("start")
    placed = found.select("case_id", "doc_id", "s.*").withColumn("_at", F.row_number().over(order) - 1).join(listed, ["case_id", "entry"])
    seq = F.lit(SOURCES["lexicon"] * LIST) + F.col("ord") * (1 << 20) + F.col("_at")
    return placed.select("case_id", "doc_id", seq.cast("long").alias("seq"), "start", "end", name_type(F.col("entry")).alias("entity_type"), F.lit("high").alias("confidence"), F.lit("lexicon").alias("source"), F.col("entry").alias("value"))


def all_spans(*parts: DataFrame) -> DataFrame:
    """UNION ALL of span tables."""
    return reduce(DataFrame.unionByName, parts)


def duplicate_entries(lexicon: DataFrame) -> DataFrame:
    """(case_id, entry, ord): entries that are in a case's list more than once after trimming, in order of their first place."""
    from ..functions.text import strip

    trimmed = lexicon.select("case_id", "ord", strip(F.col("entry")).alias("entry")).filter("entry <> ''")
    return trimmed.groupBy("case_id", "entry").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).filter("n > 1").select("case_id", "entry", "ord")
