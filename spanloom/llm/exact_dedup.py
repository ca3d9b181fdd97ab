"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of the whole, each step only within groups that the
step before left with more than one row. Texts are equal when they are identical without white space. DataFrame functions only.

What a step leaves open is told to the next by bitmaps, so no text is shuffled and no list of groups is sent: of lengths one bit each, exact; of (length,
hash) groups by a hash of both, where a chance agreement only costs a hash that stands alone afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters that the second step hashes.
PREFIX = 64
#: Largest table, in rows, that is sent to all executors; beyond it rows are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bits of the map of open groups: so many for each, at least 2**15, at most 2**30 (128 MB to each executor). Past 10**8 open groups chance agreements grow,
#: results stay.
BITS_EACH, MOST_BITS = 16, 1 << 30
#: log2 of the bits in one part of a map.
PART = 15
BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _bitmap(spots: DataFrame, what: str) -> DataFrame:
    """(part, map) of the numbers in the column spot."""
    return common.staged(spots.groupBy(F.shiftright("spot", PART).alias("part")).agg(F.bitmap_construct_agg(F.col("spot") % (1 << PART)).alias("map")), what)


def _marked(df: DataFrame, maps: DataFrame, spot: Column, name: str) -> DataFrame:
    """df with a boolean column: whether the number is in the bitmap."""
    parts = maps.select(F.col("part").alias("_part"), F.col("map").alias("_map"))
    placed = df.withColumn("_spot", spot).join(F.broadcast(parts), F.shiftright("_spot", PART) == F.col("_part"), "left")
    at = F.col("_spot") % (1 << PART)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    return placed.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_spot", "_part", "_map")


def refined(rows: DataFrame) -> DataFrame:
    """rows (with a column text, nulls allowed, and none that begins with _) with full: the digest of the whole text where the row is in a group that is
    open after length and prefix, else null."""
    norm = rows.withColumn("_norm", normalised(F.col("text")))
    lengths = norm.select(F.length("_norm").cast("long").alias("spot")).groupBy("spot").count()
    open_lengths = _bitmap(lengths.filter("count > 1").select("spot"), "dedup-lengths")  # a bit for each length there is, so the longest text bounds it

    def with_length(df: DataFrame) -> DataFrame:
        return _marked(df, open_lengths, F.length("_norm").cast("long"), "_same_length")

    head = F.xxhash64(F.substring("_norm", 1, PREFIX))
    heads = with_length(norm.select("_norm")).filter("_same_length").groupBy(F.length("_norm").alias("size"), head.alias("head")).count().filter("count > 1")
    heads = common.staged(heads.select("size", "head"), "dedup-heads")
    bits = 1 << max(PART, min(MOST_BITS, BITS_EACH * max(1, heads.count()) - 1).bit_length())
    open_heads = _bitmap(heads.select(F.pmod(F.xxhash64("size", "head"), F.lit(bits)).alias("spot")), "dedup-open")
    spot = F.when(F.col("_same_length"), F.pmod(F.xxhash64(F.length("_norm"), head), F.lit(bits)))
    return _marked(with_length(norm), open_heads, spot, "_open").withColumn("full", F.when(F.col("_open"), F.sha2("_norm", 256))).drop("_norm", "_same_length", "_open")


def _winners(slim: DataFrame) -> DataFrame:
    """For each digest with more than one row: win (the id that stays: most code points, then smallest id, null ids last), win_chars, group_size, and
    same, how often that row is there."""
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("n"), F.col("id").alias("i"))
    found = slim.filter("full is not null").groupBy("full", "chars", "id").count().groupBy("full").agg(F.min(order).alias("best"), F.sum("count").alias("group_size"), F.min_by("count", order).alias("same"))
    return found.filter("group_size > 1").select("full", F.col("best.i").alias("win"), (-F.col("best.c")).alias("win_chars"), "group_size", "same")


def _sendable(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _chars() -> Column:
    return F.length(F.coalesce(F.col("text"), F.lit(""))).alias("chars")


def _won() -> Column:
    return F.col("win").eqNullSafe(F.col("id")) & (F.col("win_chars") == F.col("chars"))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of df: key, keep_id, group_size, kept, and the `carry` expressions over df.

    A null text counts as empty, and empty texts are equal to each other. The row with the most code points stays, then the smallest key; null keys
    come last. Rows that are the same in key and text are told apart by nothing: all of them are marked kept if one is (deduplicated() leaves one).
    An empty table gives an empty result. Other columns are not looked at, so their names cannot clash.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in (carry or {}).items()]).alias("carried"))
    slim = common.staged(refined(rows).select("id", "full", _chars(), "carried"), "dedup-rows")
    names = [F.col("id").alias(key), "keep_id", "group_size", "kept", *(F.col(f"carried.{n}").alias(n) for n in carry or {})]
    alone = slim.filter("full is null").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    wins = common.staged(_winners(slim), "dedup-wins")
    shared = slim.filter("full is not null").join(_sendable(wins), "full", "left").withColumns(
        {"keep_id": F.when(F.col("group_size") > 1, F.col("win")).otherwise(F.col("id")), "kept": F.col("group_size").isNull() | _won(), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}
    )
    return alone.select(*names).unionByName(shared.select(*names))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all columns, whatever their names: rows are carried as one struct. Choice and edge cases as in
    exact_groups(); of rows that are the same in key and text, one stays."""
    rows = refined(df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*df.columns).alias("row")))
    wins = common.staged(_winners(rows.select("id", "full", _chars())), "dedup-wins")
    left = rows.withColumn("chars", _chars()).join(_sendable(wins), "full", "left").filter(F.col("win_chars").isNull() | _won())
    if wins.filter("same > 1").isEmpty():
        return left.select("row.*")
    once = left.filter("coalesce(same, 1) = 1").select("row.*")
    return once.unionByName(left.filter("same > 1").dropDuplicates(["full"]).select("row.*"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return exact_groups(docs, carry={"text_sha256": F.sha2(normalised(F.col("text")), 256)}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
w as (select doc_id, text_sha256,
             first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
             count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w
"""
