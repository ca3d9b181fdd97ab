"""Repeated strings over all documents, with enhanced suffix arrays and their common-prefix interval trees.

Equal strings of `width` bytes have equal anchors (see anchors), so the suffixes of all texts fall into buckets by anchor that are searched on their own.
Segments that are the same byte by byte are one class with a count. Anchors with several classes get a suffix array over their classes' suffixes, sorted
within each distance to the anchor; a stack scan over its common-prefix lengths walks the interval tree, and every interval of sufficient depth whose
suffixes differ in the byte to their left is a maximal repeat. All its occurrences are told, not neighbours only, and still in linear space: each suffix
once, with its rank, and each repeat as a range of ranks (repeat_groups()). Anchors with more classes than a task should hold are taken apart string by
string: there a group is a string of the least length with all places where it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .anchors import Cutter

#: Bytes of a repeated string; classes of an anchor that one task sorts; suffixes that are sorted in one go.
WIDTH, CLASSES, SORTED = 400, 20_000, 40_000


MIXED = -1


def intervals(lcp: list[int], left: list[int], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, diverse) of the nodes of the interval tree that are at least `least` deep, children before their parents.

    lcp[i] is the common prefix of suffixes i and i + 1 of the sorted array; left[i] the byte before suffix i, or less than 0 if there is none in sight. A
    node is diverse unless all its suffixes have the same byte in sight: else they repeat together one byte further to the left. One scan with a stack of
    open nodes: [depth, first, byte that all have in common].
    """
    stack: list[list[int]] = []
    for i in range(len(left)):
        depth = lcp[i] if i < len(lcp) else 0
        first, byte = i, left[i] if left[i] >= 0 else MIXED
        while stack and stack[-1][0] > depth:
            length, first, other = stack.pop()
            byte = byte if byte == other else MIXED
            yield length, first, i, byte == MIXED
        if stack and stack[-1][0] == depth:
            top = stack[-1]
            top[2] = top[2] if top[2] == byte else MIXED
        elif depth >= least:
            stack.append([depth, first, byte])


def sorted_suffixes(data: np.ndarray, bucket: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by bucket and first `width` bytes, and for each but the last whether those are equal to the next one's."""
    table = np.empty((len(start), width + 8), np.uint8)
    table[:, :8] = bucket.astype(">u8").view(np.uint8).reshape(-1, 8)
    table[:, 8:] = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    order = np.argsort(table.view(f"S{width + 8}")[:, 0], kind="stable")
    table = table[order]
    return order, (table[1:] == table[:-1]).all(1)


def common_lengths(data: np.ndarray, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, known: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, of which `known` bytes are equal, up to the ends."""
    room = np.minimum(end_a - a, end_b - b)
    out, open_ = np.minimum(known, room), np.flatnonzero(room > known)
    while len(open_):
        at = out[open_]
        equal = data[a[open_] + at] == data[b[open_] + at]
        open_ = open_[equal]
        out[open_] += 1
        open_ = open_[out[open_] < room[open_]]
    return out


def repeats(segments: list[tuple[int, bytes, int, int, int]], width: int) -> tuple[list[tuple[int, int, bytes, int, int]], list[tuple[bytes, int, int, int, bytes]]]:
    """Maximal repeats among (bucket, bytes, suffixes, offset of the anchor, copies), within the bounds of the segments.

    Gives places: (segment, start in it, run, rank, length of the longest repeat there), and repeats: (run, first rank, last rank, length, digest of the
    string). A run is what has its first `width` bytes in common. A segment's first suffix, whose left is out of sight, makes a repeat diverse; a segment
    with copies repeats as a whole."""
    places: list[tuple[int, int, bytes, int, int]] = []
    groups: list[tuple[bytes, int, int, int, bytes]] = []
    data = np.frombuffer(b"".join(s[1] for s in segments), np.uint8)
    sizes = np.array([len(s[1]) for s in segments])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    count, offset = np.array([s[2] for s in segments]), np.array([s[3] for s in segments])
    buckets = np.unique([s[0] for s in segments], return_inverse=True)[1]
    owner = np.repeat(np.arange(len(segments)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    twins = np.flatnonzero(np.array([s[4] for s in segments]) > 1)  # the copies of a segment stand in the array as one more suffix
    twin = np.arange(len(owner) + len(twins)) >= len(owner)
    owner, inner = np.concatenate([owner, twins]), np.concatenate([inner, np.zeros(len(twins), inner.dtype)])
    bucket = buckets[owner].astype(np.int64) << 32 | (offset[owner] - inner)  # distance to the anchor: equal strings have equal ones
    ranked = np.argsort(bucket, kind="stable")
    cuts = [0]  # pieces of whole buckets
    edges = np.concatenate([np.flatnonzero(np.diff(bucket[ranked])) + 1, [len(ranked)]])
    for a, b in zip(np.concatenate([[0], edges[:-1]]), edges, strict=True):
        if b - cuts[-1] > SORTED and a > cuts[-1]:
            cuts.append(int(a))
    for lo, hi in zip(cuts, [*cuts[1:], len(ranked)], strict=True):
        pick = ranked[lo:hi]
        start = begin[owner[pick]] + inner[pick]
        order, equal = sorted_suffixes(data, bucket[pick], start, width)
        pick, start = pick[order], start[order]
        if not equal.any():
            continue
        left = np.where(inner[pick] > 0, data[np.maximum(start - 1, 0)].astype(np.int64), -1)  # -1: out of sight
        run = np.concatenate([[0], np.cumsum(~equal)])  # suffixes that share their first bytes with neighbours
        heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        low, high = np.minimum.reduceat(left, heads), np.maximum.reduceat(left, heads)
        length = np.diff(np.concatenate([heads, [len(run)]]))
        # where all bytes to the left are in sight and equal, the suffixes repeat from further left, and are found there
        for r in np.flatnonzero((length > 1) & ((low < 0) | (low != high))):
            x = np.arange(heads[r], heads[r] + length[r])
            ends = begin[owner[pick[x]]] + sizes[owner[pick[x]]]
            tails = [data[a:b].tobytes() for a, b in zip(start[x] + width, ends, strict=True)]
            full = sorted(range(len(x)), key=tails.__getitem__)  # so far they are in order by their first bytes only
            x, ends = x[full], ends[full]
            deep = common_lengths(data, start[x[:-1]], start[x[1:]], ends[:-1], ends[1:], width)
            name = hashlib.blake2b(data[start[x[0]] : start[x[0]] + width].tobytes(), digest_size=16).digest()  # the same in every task
            cover = np.zeros(len(x), np.int64)
            for size, a, b, diverse in intervals(deep.tolist(), left[x].tolist(), width):
                if diverse:
                    part = cover[a : b + 1]
                    np.copyto(part, size, where=part == 0)  # children come first, so the deepest stays
                    groups.append((name, a, b, size, hashlib.blake2b(data[start[x[a]] : start[x[a]] + size].tobytes(), digest_size=16).digest()))
            places += [(int(owner[pick[x[i]]]), int(inner[pick[x[i]]]), name, i, int(cover[i])) for i in np.flatnonzero((cover > 0) & ~twin[pick[x]]).tolist()]
    return places, groups


def _segments(df: DataFrame, width: int) -> DataFrame:
    """(digest, anchor, class, start, count, offset) of df's (digest, body: bytes of the text)."""

    def run(batches):
        import xxhash

        cut = Cutter(width)
        for batch in batches:
            for digest, body in zip(batch.column(0), batch.column(1), strict=True):
                data = body.as_buffer().to_pybytes() if body.is_valid else b""
                s = cut(data)
                for at in range(0, len(s.start), 100_000):
                    part = [x[at : at + 100_000] for x in s]
                    names = [xxhash.xxh3_128_digest(data[p : p + c + width - 1], o) for p, c, o in zip(part[1].tolist(), part[2].tolist(), part[3].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest.as_py()] * len(names), pa.binary()), pa.array(part[0].view(np.int64)), pa.array(names, pa.binary()), *(pa.array(x) for x in part[1:])],
                        names=["digest", "anchor", "class", "start", "count", "offset"],
                    )

    return df.mapInArrow(run, "digest binary, anchor long, class binary, start long, count long, offset long")


FOUND = "run binary, rank int, last int, length long, repeat binary, class binary, digest binary, start long"


def _search(rows: DataFrame, width: int) -> DataFrame:
    """Places and repeats, the latter with a null digest; rows of one anchor come one after the other: (anchor, class, n, digest, start, count, offset,
    body)."""

    def run(batches):
        held: list[tuple] = []
        suffixes, last = 0, None

        def flush():
            places, groups = repeats([(r[0], r[7], r[5], r[6], r[2]) for r in held], width) if len(held) > 1 else ([], [])
            for at in range(0, len(places), 50_000):
                part = places[at : at + 50_000]
                yield batch_of([p[2] for p in part], [p[3] for p in part], None, [p[4] for p in part], None, [held[p[0]][1] for p in part], [held[p[0]][3] for p in part], [held[p[0]][4] + p[1] for p in part])
            for at in range(0, len(groups), 50_000):
                yield batch_of(*zip(*groups[at : at + 50_000], strict=True), None, None, None)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and suffixes >= SORTED:
                    yield from flush()
                    suffixes = 0
                held.append(row)
                suffixes, last = suffixes + row[5], row[0]
        yield from flush()

    return rows.mapInArrow(run, FOUND)


def batch_of(*columns) -> pa.RecordBatch:
    """A batch of FOUND; None stands for a column of nulls."""
    n = len(next(c for c in columns if c is not None))
    types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def _strings(rows: DataFrame, width: int) -> DataFrame:
    """Every string of the segments on its own: (run, class, digest, start, n)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, name, n, digest, start, count, _, body = row
                names = [xxhash.xxh3_128_digest(body[q : q + width]) for q in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([name] * count, pa.binary()), pa.array([digest] * count, pa.binary()), pa.array(np.arange(start, start + count)), pa.array(np.full(count, n, np.int64))], names=["run", "class", "digest", "start", "n"])

    return rows.mapInArrow(run, "run binary, class binary, digest binary, start long, n long")


@dataclass
class Repeats:
    """Staged tables of a search. members: (class, digest, start), every segment of every text; classes: (class, n, length, digest, start) with one of their
    segments each; places: (run, rank, length, class, digest, start) in the array, of one member of the class; groups: (run, first, last, length, repeat)."""

    members: DataFrame
    classes: DataFrame
    places: DataFrame
    groups: DataFrame


def search(texts: DataFrame, width: int = WIDTH) -> Repeats:
    """Repeats of at least `width` bytes over (digest, body) rows. Rows with equal digests count as copies of one text, and are members once each."""
    cut = common.staged(_segments(texts, width), "segments")
    first = F.min(F.struct("digest", "start", "count", "offset")).alias("first")
    classes = common.staged(cut.groupBy("anchor", "class").agg(F.count("*").alias("n"), first), "classes")
    many = classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1")
    wanted = common.staged(classes.join(many, "anchor").select("anchor", "class", "n", "classes", "first.*"), "wanted")
    places = wanted.groupBy("digest").agg(F.collect_list(F.struct("anchor", "class", "n", "classes", "start", "count", "offset")).alias("places"))  # bounded by the text
    single = texts.groupBy("digest").agg(F.first("body").alias("body"))  # copies go before the shuffle
    bodies = single.join(places, "digest").select("digest", "body", F.explode("places").alias("p")).select("digest", "p.*", F.substring("body", (F.col("p.start") + 1).cast("int"), (F.col("p.count") + width - 1).cast("int")).alias("body"))
    bodies = common.staged(bodies, "bodies")
    columns = ["anchor", "class", "n", "digest", "start", "count", "offset", "body"]
    found = common.staged(_search(bodies.filter(F.col("classes") <= CLASSES).select(*columns).repartition("anchor").sortWithinPartitions("anchor"), width), "found")
    # no task gets an anchor with an unbounded number of classes: there each string is a row, counted before it is shuffled
    hot = common.staged(_strings(bodies.filter(F.col("classes") > CLASSES).select(*columns), width), "hot-strings")
    twice = common.staged(hot.groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1").select("run"), "hot-runs")
    of_hot = hot.join(twice, "run", "left_semi").select("run", F.lit(0).alias("rank"), F.lit(width).cast("long").alias("length"), "class", "digest", "start")
    # an anchor with one class: its segment is all that can repeat
    alone = classes.join(many, "anchor", "left_anti").filter("n > 1")
    whole = alone.select(F.col("class").alias("run"), F.lit(0).alias("first"), F.lit(0).alias("last"), (F.col("first.count") + width - 1).alias("length"), F.col("class").alias("repeat"))
    columns = ["run", "first", "last", "length", "repeat"]
    return Repeats(
        cut.select("class", "digest", "start"),
        classes.select("class", "n", (F.col("first.count") + width - 1).alias("length"), "first.digest", "first.start"),
        found.filter("digest is not null").select("run", "rank", "length", "class", "digest", "start").unionByName(of_hot).unionByName(whole.join(alone.select(F.col("class").alias("run"), "first.digest", "first.start"), "run").select("run", F.lit(0).alias("rank"), "length", F.col("run").alias("class"), "digest", "start")),
        found.filter("digest is null").select("run", F.col("rank").alias("first"), "last", "length", "repeat").unionByName(twice.select("run", F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(width).cast("long").alias("length"), F.col("run").alias("repeat"))).select(*columns).unionByName(whole),
    )


def occurrences(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(length, digest, start): for each place in the texts the longest repeat that starts there, of those within the bounds of segments. Strings that
    repeat, and only those, are covered by them taken together."""
    found = search(texts, width)
    copies = found.members.join(found.classes.filter("n > 1").select("class", "length"), "class").select("length", "digest", "start")
    return found.places.select("length", "digest", "start").unionByName(copies)


def repeat_groups(texts: DataFrame, width: int = WIDTH, expand: bool = False) -> DataFrame:
    """The maximal repeats over (digest, body) rows: (repeat, length, run, first, last), and with `expand` a row for every occurrence instead: (repeat,
    length, digest, start). The first form is linear in the input, as search() gives the places of a run once; the second can grow with the square of a
    group, since a repeat's prefixes can be repeats with more occurrences."""
    found = search(texts, width)
    if not expand:
        return found.groups
    here = found.groups.join(found.places.select("run", "rank", F.col("start").alias("_at"), F.col("digest").alias("_in"), "class"), "run").filter("rank between first and last")
    # a place stands for all members of its class, at the same distance from where each begins
    shift = found.classes.select("class", F.col("start").alias("_from"))
    members = found.members.withColumnsRenamed({"digest": "_digest", "start": "_start"})
    return here.join(shift, "class").join(members, "class").select("repeat", "length", F.col("_digest").alias("digest"), (F.col("_start") + F.col("_at") - F.col("_from")).alias("start"))


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """One row per row of df: key, n_bytes, n_removed, n_spans, kept_sha256, n_kept and (with keep_text) kept, the bytes that are left.

    A byte goes if a string of `width` bytes that covers it starts anywhere else too, in the same text or another row's; texts are UTF-8, null ones
    empty. Rows with equal texts of at least `width` bytes lose everything. Repeated rows count as documents of their own. An empty table gives an empty
    result. Other columns are not looked at.
    """
    body = common.text_of(text).cast("binary")
    rows = df.select(F.col(key).alias("_id"), body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    texts = rows.filter(F.length("body") >= width).select("digest", "body")
    spans = occurrences(texts, width).groupBy("digest").agg(F.collect_set(F.struct("start", "length")).alias("spans"))  # bounded by the text
    spans = common.staged(spans, "spans")
    once = rows.groupBy("digest").agg(F.first("body").alias("body"), F.count("*").alias("copies")).join(spans, "digest", "left")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for digest, data, copies, found in zip(*(batch.column(c).to_pylist() for c in ("digest", "body", "copies", "spans")), strict=True):
                size = len(data)
                cover = [(0, size)] if copies > 1 and size >= width else sorted((s["start"], s["start"] + s["length"]) for s in found or [])
                kept, removed, n, at = [], 0, 0, 0
                for a, b in cover:
                    if a > at or not n:
                        kept.append(data[at:a])
                        n, at, removed = n + 1, b, removed + b - a
                    elif b > at:
                        at, removed = b, removed + b - at
                kept.append(data[at:])
                left = b"".join(kept)
                for column, value in zip(out, (digest, size, removed, n, hashlib.sha256(left).hexdigest(), left if keep_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = common.staged(once.select("digest", "body", "copies", "spans").mapInArrow(run, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), "kept")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), *(["kept"] if keep_text else [])]
    return rows.select("_id", "digest").join(done, "digest").select(F.col("_id").alias(key), *columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.table(spark, sf_dir, "documents"), keep_text=False)
