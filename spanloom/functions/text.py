"""Scalar functions over texts, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLANK, ID_CODES, ID_WEIGHTS, LABELS, ORG_WORDS, OTHER_LABEL

#: Digits other than ASCII that the checksum reads: full-width ones.
WIDE = "０１２３４５６７８９"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def offsets(text: Column, found: Column) -> Column:
    """array<struct<start,end>> of the strings in `found`, searched from left to right, each from where the last one ended."""
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        return let(
            F.call_function("locate", m, text, acc["pos"] + 1),
            lambda at: F.struct((at - 1 + F.length(m)).alias("pos"), F.concat(acc["out"], F.array(F.struct((at - 1).alias("start"), (at - 1 + F.length(m)).alias("end")))).alias("out")),
        )

    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def regex_offsets(text: Column, pattern: str) -> Column:
    """Non-overlapping matches. Exact for patterns without look-around: a literal occurrence before the match would itself have matched."""
    return offsets(text, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def literal_offsets(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal, from left to right; none for an empty literal."""
    count = F.when(F.length(needle) > 0, F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)
    return offsets(text, F.array_repeat(needle, count))


def id_checksum_ok(value: Column) -> Column:
    """Whether the last of 18 characters is the check character of the first 17 (digits)."""
    plain = F.translate(value, WIDE, "0123456789")
    digits = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.call_function("substring", plain, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.zip_with(digits, F.array(*map(F.lit, ID_WEIGHTS)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    code = F.element_at(F.array(*(F.lit(c) for c in ID_CODES)), F.pmod(total, F.lit(11)) + 1)
    return F.coalesce((F.length(value) == 18) & (F.upper(F.call_function("substring", plain, F.lit(18), F.lit(1))) == code), F.lit(False))


def name_type(entry: Column) -> Column:
    """ORG if the entry holds one of the organisation words, else PERSON."""
    return F.when(F.exists(F.array(*map(F.lit, ORG_WORDS)), lambda w: F.contains(entry, w)), "ORG").otherwise("PERSON")


def label(entity_type: Column) -> Column:
    pairs = [x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), entity_type), F.lit(OTHER_LABEL))


def token(label_: Column, number: Column) -> Column:
    return F.format_string("⟦%s%03d⟧", label_, number)


def token_label(token_: Column) -> Column:
    return F.regexp_extract(token_, r"^⟦([^\p{Nd}⟧]+)(\p{Nd}+)⟧", 1)


def token_number(token_: Column) -> Column:
    return F.regexp_extract(token_, r"^⟦([^\p{Nd}⟧]+)(\p{Nd}+)⟧", 2).try_cast("int")
