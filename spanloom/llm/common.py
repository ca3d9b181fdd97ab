"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import released, staged

__all__ = ["BROADCAST_KEYS", "map_texts", "released", "remainder", "staged", "table", "text_of", "unused", "without"]

#: Characters of text that one step of a Python worker handles at a time.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, by: int) -> Column:
    """crc32 of the key as text modulo by; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[list]]], fields: str, types: list[pa.DataType], keep_text: bool = False) -> DataFrame:
    """df without `column` (unless keep_text), with the columns that the function from make() computes from lists of texts.

    make() runs once in each task. Nulls come as empty texts. Other columns go through untouched; their names must differ from the new ones.
    """
    names = [f.split()[0] for f in fields.split(",")]
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"column names taken: {sorted(clash)}")
    keep = [c for c in df.columns if keep_text or c != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep] + [fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(column))
            at = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= SLICE_CHARS):
                    size += sizes[end]
                    end += 1
                part = [x or "" for x in texts.slice(at, end - at).to_pylist()]
                made = [pa.array(v, t) for v, t in zip(work(part), types, strict=True)]
                rest = [batch.column(batch.schema.names.index(c)).slice(at, end - at) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*keep, *names])
                at = end

    import pyarrow.compute  # noqa: F401  pa.compute is there once it is imported

    return df.mapInArrow(run, schema)


#: Rows of keys, at most, that are sent to all executors.
BROADCAST_KEYS = 500_000


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key (null equals null) is in keys, a staged table of one column. No text is shuffled while the keys can be sent."""
    (gone,) = unused(df, "_gone")
    lost = keys.select(F.col(key).alias(gone))
    return df.join(F.broadcast(lost) if lost.count() <= BROADCAST_KEYS else lost, F.col(key).eqNullSafe(F.col(gone)), "left_anti")
