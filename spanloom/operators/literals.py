"""Many literals in many texts: one pass over the bytes of each Arrow batch.

Testing every text for every literal costs texts x literals. Here the first bytes of each literal are its anchor; anchors are looked for at every byte by
whole-array operations, and only where one stands is a literal compared. Literals are collected and sent in blocks of a bounded size and held as flat arrays,
all blocks by the one worker of the task, so that neither processes nor texts that are sent to Python grow in number with the literals. Texts are neither
shuffled nor sent back, unless they are to be kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of literals, about, that one block holds.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are looked at together: what is worked out for each byte stays within a cache.
SLICE_BYTES = 1 << 18
FOUND = "array<struct<start:int,end:int,entry:string>>"
#: Bytes of an anchor; a literal has the widest that fits into it.
WIDTHS = (8, 4, 2, 1)
#: Odd numbers that spread anchors, and anchors with cases, over 64 bits.
SPREAD, SPREAD_CASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
PAD = 8


def with_literals(df: DataFrame, entries: DataFrame, text: str = "text", into: str = "found", by: str | None = "case_id", keep_text: bool = False) -> DataFrame:
    """df (without its text, unless it is kept) with a column of FOUND: of each literal of the row's case, every occurrence that doesn't overlap the one
    before, from left to right. entries: (case_id, entry), or (entry) with by=None; empty and null ones match nothing, repeated ones count once. Null texts
    hold nothing. Order within the array: by end, then by start."""
    rows = entries.select(*([by] if by else []), "entry").filter("entry <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("entry") + 64)).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES)
    kept = [c for c in df.columns if c not in (text, into)]
    out = [*kept, text] if keep_text else kept
    if not blocks:
        return df.select(*out, F.array().cast(FOUND).alias(into))
    held = []
    for block in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)) == block)
        listed = part.toArrow()  # a block of bounded size
        held.append(df.sparkSession.sparkContext.broadcast(_block(listed.column("entry").to_pylist(), listed.column(by).to_pylist() if by else None)))
    return _pass(df.select(*kept, text), held, text, into, by, out)


def _block(entries: list[str], cases: list | None) -> dict:
    """Literals as flat arrays, in order of spot(anchor, case) for each width. `parts`: width, table of spread anchors, spots, case, place and length of each
    literal, its last bytes."""
    codes = {c: i for i, c in enumerate(dict.fromkeys(cases or [None]))}
    each: dict[int, list[tuple[int, bytes]]] = {}
    for entry, case in zip(entries, cases or [None] * len(entries), strict=True):
        raw = entry.encode()
        each.setdefault(next(w for w in WIDTHS if w <= len(raw)), []).append((codes[case], raw))
    parts = []
    for width, found in each.items():
        case = np.array([c for c, _ in found], np.int64)
        anchors = np.frombuffer(b"".join(r[:width].ljust(8, b"\0") for _, r in found), "<u8")
        tails = np.frombuffer(b"".join(r[-width:].ljust(8, b"\0") for _, r in found), "<u8")
        spots = _spot(anchors, case)
        order = np.argsort(spots, kind="stable")
        sizes = np.array([len(r) for _, r in found], np.int64)[order]
        shift = 64 - min(24, max(16, (16 * len(found)).bit_length()))
        table = np.zeros(1 << (64 - shift), bool)
        table[_spread(anchors, shift)] = True
        blob = b"".join(found[i][1] for i in order)
        parts.append((width, shift, table, spots[order], case[order], np.cumsum(sizes) - sizes, sizes, tails[order], blob))
    return {"codes": codes, "parts": parts}


def _spot(anchors: np.ndarray, case: np.ndarray) -> np.ndarray:
    return anchors * SPREAD + case.astype(np.uint64) * SPREAD_CASE


def _spread(anchors: np.ndarray, shift: int) -> np.ndarray:
    return ((anchors * SPREAD) >> np.uint64(shift)).view(np.int64)


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each byte of data as a number; data has PAD bytes more."""
    every = np.ndarray((len(data) - PAD,), "<u8", data, 0, (1,))
    return every if width == 8 else every & np.uint64((1 << (8 * width)) - 1)


def _hits(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, case: np.ndarray, parts: list) -> Iterator[tuple[int, int, int, str]]:
    """(row, first byte, byte after the last, literal) of every occurrence. begins, ends: of each row's text within data."""
    for width, shift, table, spots, cases, places, sizes, tails, blob in parts:
        every = _windows(data, width)
        at = np.flatnonzero(table[_spread(every, shift)])
        row = np.searchsorted(begins, at, "right") - 1  # of rows that begin alike all but the last are empty
        at, row = (x[(row >= 0) & (case[row] >= 0) & (at < ends[row])] for x in (at, row))
        spot = _spot(every[at], case[row])
        low = np.searchsorted(spots, spot, "left")
        many = np.searchsorted(spots, spot, "right") - low
        which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at, row = np.repeat(at, many), np.repeat(row, many)
        fits = (cases[which] == case[row]) & (at + sizes[which] <= ends[row])
        at, row, which = at[fits], row[fits], which[fits]
        ended = every[at + sizes[which] - width] == tails[which]
        at, row, which = at[ended], row[ended], which[ended]
        for i, a, k in zip(row.tolist(), at.tolist(), which.tolist(), strict=True):
            place, n = int(places[k]), int(sizes[k])
            if data[a : a + n].tobytes() == blob[place : place + n]:
                yield i, a, a + n, blob[place : place + n].decode()


def _bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts, and where each text begins and ends in them; a null one ends where it begins."""
    _, places, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(places, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    ends = bounds[1:].copy()
    if column.null_count:
        null = column.is_null().to_numpy(zero_copy_only=False)
        ends[null] = bounds[:-1][null]
    return np.frombuffer(data or b"", np.uint8), bounds[:-1], ends


def _pass(df: DataFrame, held: list, text: str, into: str, by: str | None, out: list[str]) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entry", pa.string())]))
    names = df.columns

    def search(column: pa.Array, cases: list | None) -> list[list[dict]]:
        data, begins, ends = _bounds(column)
        found: list[list] = [[] for _ in begins]
        coded = [np.array([h.value["codes"].get(c, -1) for c in cases], np.int64) if by else np.zeros(len(begins), np.int64) for h in held]
        low = 0
        while low < len(begins):  # rows of a slice; a long text is one by itself
            high = max(low + 1, int(np.searchsorted(ends, begins[low] + SLICE_BYTES, "right")))
            first, last = int(begins[low]), int(ends[low:high].max())
            if last > first:
                part = np.zeros(last - first + PAD, np.uint8)
                part[: last - first] = data[first:last]
                for h, case in zip(held, coded, strict=True):
                    for i, a, b, entry in _hits(part, begins[low:high] - first, ends[low:high] - first, case[low:high], h.value["parts"]):
                        found[low + i].append((b, a, entry))
                for i in range(low, high):
                    if found[i]:
                        found[i] = _placed(part[int(begins[i]) - first : int(ends[i]) - first], sorted(found[i]), int(begins[i]) - first)
            low = high
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = search(batch.column(names.index(text)), batch.column(names.index(by)).to_pylist() if by else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in out), pa.array(made, kind)], names=[*out, into])

    return df.mapInArrow(run, df.select(*out, F.array().cast(FOUND).alias(into)).schema)


def _placed(body: np.ndarray, hits: list[tuple[int, int, str]], first: int) -> list[dict]:
    """Occurrences (byte after the last, first byte, literal), in order, as code points of the text, without those that overlap the one before of theirs."""
    points = np.cumsum((body & 0xC0) != 0x80)
    out, until = [], {}
    for b, a, entry in hits:
        if a >= until.get(entry, 0):
            until[entry] = b
            start = int(points[a - first]) - 1
            out.append({"start": start, "end": start + len(entry), "entry": entry})
    return out
