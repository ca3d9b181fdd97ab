"""Sharding by minimax contiguous partition: groups of equal texts are atoms in the order of their smallest keys; the smallest capacity with which the
atoms fit into the shards in that order is found by binary search, each step a greedy check; then the cuts are made.

The driver never holds the atoms. It holds sums of blocks of the key range, splits only the blocks in which a cut can fall, and so on down to single
atoms; BLOCKS bounds what a step brings in.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Blocks, at most about, that one step of the search brings to the driver.
BLOCKS = 1 << 16
#: Lots that the rows of a shard in one task are dealt into to be numbered.
SALT = 16


@dataclass
class Block:
    start: int  # smallest key (less the smallest of all)
    shift: int  # its keys share what is above that many bits
    weight: int
    largest: int
    atoms: int


def greedy(prefix: list[int], capacity: int, shards: int) -> bool:
    """Whether the blocks, whose running sums (from 0) these are, fit."""
    at = 0
    for _ in range(shards):
        at = bisect.bisect_right(prefix, prefix[at] + capacity, at) - 1
        if at == len(prefix) - 1:
            return True
    return False


def smallest_capacity(prefix: list[int], shards: int, low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        if greedy(prefix, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def uncertain(blocks: list[Block], prefix: list[int], shards: int) -> list[int]:
    """Indexes of the blocks that can be split and in which a cut of the final partition can fall."""
    total = prefix[-1]
    low = max(-(-total // shards), max(b.largest for b in blocks))
    high = smallest_capacity(prefix, shards, low, max(low, max(b.weight for b in blocks)) + total)
    found, left = set(), 0
    for i in range(1, shards):
        left = prefix[max(0, bisect.bisect_right(prefix, left + low) - 1)]
        right = min(total, i * high)
        if left >= total:
            break
        a, b = max(0, bisect.bisect_right(prefix, left) - 1), bisect.bisect_left(prefix, right)
        found.update(k for k in range(a, min(b + 1, len(blocks))) if blocks[k].shift and blocks[k].atoms > 1)
    return sorted(found)


def cuts(prefix: list[int], shards: int, capacity: int) -> list[int]:
    """Indexes at which shards 1.. begin: no shard above the capacity, each as near as can be to an equal part of what is left."""
    end = len(prefix) - 1
    least = [end]  # least[j]: the first index from which j shards are enough
    for _ in range(shards):
        least.append(bisect.bisect_left(prefix, prefix[least[-1]] - capacity))
    out, at = [], 0
    for i in range(shards - 1):
        most = bisect.bisect_right(prefix, prefix[at] + capacity) - 1
        target = prefix[at] + (prefix[end] - prefix[at]) / (shards - i)
        k = bisect.bisect_left(prefix, target)
        k = k - 1 if k > at and (k > end or target - prefix[k - 1] <= prefix[k] - target) else k
        at = min(max(k, least[shards - i - 1], at), most)
        out.append(at)
    return out


def plan(atoms: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """For atoms (o: key, w: weight): shards of the keys that get one alone, the keys at which the others' shards begin, and the first of those.

    An atom heavier than an equal part of what is left fills a shard by itself; there are fewer of them than shards.
    """
    total = atoms.agg(F.sum("w"), F.min("o"), F.max("o"), F.count("*")).first()
    if not total[3]:
        return {}, [], 0
    heavy = [(r["o"], r["w"]) for r in atoms.orderBy(F.desc("w"), "o").limit(shards - 1).collect()] if shards > 1 else []
    alone, left = [], int(total[0])
    for o, w in heavy:
        if w * (shards - len(alone)) <= left:
            break
        alone.append(o)
        left -= int(w)
    parts, lowest = shards - len(alone), int(total[1])
    rest = atoms.filter(~F.col("o").isin(alone)) if alone else atoms
    key = F.col("o") - F.lit(lowest)
    width = (int(total[2]) - lowest).bit_length()

    def split(of: list[int] | None, above: int, shift: int) -> list[Block]:
        rows = rest if of is None else rest.filter(F.shiftrightunsigned(key, above).isin(of))
        got = rows.groupBy(F.shiftrightunsigned(key, shift).alias("b")).agg(F.sum("w").alias("w"), F.max("w").alias("m"), F.count("*").alias("n")).collect()
        return [Block(int(r["b"]) << shift, shift, int(r["w"]), int(r["m"]), int(r["n"])) for r in got]

    blocks = sorted(split(None, 0, max(0, width - (BLOCKS.bit_length() - 1))), key=lambda b: b.start)
    while blocks:
        prefix = [0]
        for b in blocks:
            prefix.append(prefix[-1] + b.weight)
        if not (todo := uncertain(blocks, prefix, parts)):
            low = max(-(-prefix[-1] // parts), max(b.largest for b in blocks))
            capacity = smallest_capacity(prefix, parts, low, max(low, max(b.weight for b in blocks)) + prefix[-1])
            starts = [blocks[k].start + lowest if k < len(blocks) else None for k in cuts(prefix, parts, capacity)]
            return {o: i for i, o in enumerate(sorted(alone))}, starts, len(alone)
        new = []
        for shift in {blocks[k].shift for k in todo}:
            same = [blocks[k].start >> shift for k in todo if blocks[k].shift == shift]
            finer = max(0, shift - max(1, (BLOCKS // len(todo)).bit_length() - 1))
            new += split(same, shift, finer)
        gone = set(todo)
        blocks = sorted([b for k, b in enumerate(blocks) if k not in gone] + new, key=lambda b: b.start)
    return {o: i for i, o in enumerate(sorted(alone))}, [], len(alone)


def sharded(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: key, size (UTF-8 bytes of the text plus 8), text_crc32, law (`bytes`), shard, slot (gapless from 0 in its shard) and
    grown_shard (null under this law).

    Rows with equal texts share a shard; a null text is equal to an empty one. Groups come in the order of their smallest keys (for keys that are no
    integers: of their hashes); groups of null keys only come at 0; groups with one smallest key are one atom. No shard is heavier than the smallest
    possible capacity, and one group heavier than an equal part fills a shard alone. An empty table gives an empty result. Repeated rows each get a
    slot. Other columns are not looked at.
    """
    whole = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    body = common.text_of(text)
    own = df.select(F.col(key).alias("_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"))
    rows = common.staged(own, "shard-rows")
    order = F.coalesce(F.min(F.col("_id").cast("long") if whole else F.shiftright(F.xxhash64("_id"), 2)), F.lit(0).cast("long"))
    groups = common.staged(rows.groupBy("k1", "k2").agg(order.alias("o"), F.sum("size").alias("w")), "shard-groups")
    atoms = common.staged(groups.groupBy("o").agg(F.sum("w").alias("w")), "shard-atoms")
    alone, starts, first = plan(atoms, shards)
    shard: Column = F.lit(first)
    for start in starts:
        if start is not None:
            shard = shard + (F.col("o") >= F.lit(start)).cast("int")
    for o, i in alone.items():
        shard = F.when(F.col("o") == F.lit(o), F.lit(i)).otherwise(shard)
    placed = rows.join(groups.select("k1", "k2", "o"), ["k1", "k2"]).select("_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.spark_partition_id().alias("part"), F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(SALT)).alias("salt"))
    placed = common.staged(placed, "shard-placed")  # fixes the parts, whatever runs again
    lot = ["shard", "part", "salt"]
    sizes = placed.groupBy(*lot).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("part", "salt").rowsBetween(W.unboundedPreceding, -1))).select(*lot, F.coalesce("before", F.lit(0)).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy(*lot).orderBy("_id", "text_crc32", "size")))
    return ranked.join(before, lot).select(
        F.col("_id").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(common.table(spark, sf_dir, "documents"))
