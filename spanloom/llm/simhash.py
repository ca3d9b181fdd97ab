"""SimHash near-dedup with vantage-point trees.

A tree over a bounded sample of fingerprints routes every fingerprint: its leaf is the shard it lives in, and it visits the other shards that its ball
can reach by the triangle inequality. In a shard, fingerprints are compared with those that live there. The fingerprint may be cut into projections:
two fingerprints within r bits are within r // projections bits in at least one of them, so one tree for each projection, with that smaller ball,
still finds every pair. Shards that are too large are dealt into square tiles, so no task gets an unbounded one.

For near copies by shingle similarity, fingerprints only give candidates: within each component of candidates the similarity of the shingles themselves
decides which pairs are links.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

#: Fingerprints that the trees are fitted on; shard size aimed at; largest shard that stays whole: a tile of two such parts is some megabytes, and some
#: seconds of comparing.
SAMPLE, SHARD, TILE = 50_000, 2048, 32_768
#: Rows that a search task gets, about.
TASK = 20_000
#: Shingles, with EACH more for every text, that one part of a component of candidates has at most; a task holds two parts.
PART, EACH = 4_000_000, 256
#: A split is made if at most this share of the sample would have to go to both sides.
OVERLAP = 0.7


def fingerprint(text: str, size: int = 3, words: int = 1, counted: bool = False) -> tuple[bytes, int]:
    """The SimHash of the text's shingles, `words` times 64 bits, and the number of shingles.

    A-Z are lower-cased, words are what ASCII white space parts; fewer words than `size` make one shingle, none makes the zero fingerprint. A bit is set
    if it is in over half of the shingles' hashes, repeats included. With `counted`, repeats have hashes of their own: then the angle between two
    fingerprints follows from the counted similarity, however often a shingle comes again.
    """
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return bytes(8 * words), 0
    count = max(1, len(parts) - size + 1)
    ones = np.zeros(64 * words, np.int64)
    seen: dict[bytes, int] = {}
    for start in range(0, count, 1 << 16):
        end = min(count, start + (1 << 16))
        grams = shingles(parts, size, start, end)
        if counted:
            grams = numbered(grams, seen)
        hashes = np.empty((len(grams), words), ">u8")
        for k in range(words):
            hashes[:, k] = np.fromiter((xxhash.xxh64_intdigest(g, 42 + k) for g in grams), np.uint64, len(grams))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(len(grams), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes(), count


def shingles(parts: list[bytes], size: int, start: int, end: int) -> list[bytes]:
    return [b" ".join(g) for g in zip(*(parts[start + i : end + i] for i in range(size)), strict=True)] if len(parts) >= size else [b" ".join(parts)]


def numbered(grams: list[bytes], seen: dict[bytes, int]) -> list[bytes]:
    """The shingles, those that were seen before with how often (after a tab, which no shingle has): counts become members of a set."""
    out = []
    for g in grams:
        k = seen.get(g, 0)
        seen[g] = k + 1
        out.append(b"%b\t%d" % (g, k) if k else g)
    return out


def counted_shingles(text: str, size: int) -> bytes:
    """64-bit hashes of the text's counted shingles, each once."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return b""
    grams = numbered(shingles(parts, size, 0, max(1, len(parts) - size + 1)), {})
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)).tobytes()


def fingerprints(df: DataFrame, text: str = "text", size: int = 3, words: int = 1, counted: bool = False) -> DataFrame:
    """df without its text, with fp (binary) and n_shingles. Null texts count as empty. Repeated rows stay, other columns go through; ValueError if one
    is named like a result."""

    def make():
        return lambda texts: [list(x) for x in zip(*(fingerprint(t, size, words, counted) for t in texts), strict=True)] if texts else [[], []]

    return common.map_texts(df, text, make, "fp binary, n_shingles long", [pa.binary(), pa.int64()])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


@dataclass
class Tree:
    """Inside a node's ball: distance to the vantage point at most `limit`. Leaves are numbered from left to right."""

    mask: np.ndarray
    radius: int
    nodes: list = field(default_factory=list)  # (vantage, limit, inside, outside), or the number of a leaf
    leaves: int = 0

    def build(self, points: np.ndarray, least: int, random: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(points) > least:
            best = None
            for v in points[random.integers(0, len(points), 6)]:
                d = distance(points & self.mask, v & self.mask)
                limit = int(np.median(d))
                inside = d <= limit
                overlap = float(np.mean((d > limit - self.radius) & (d <= limit + self.radius)))
                if 0.2 <= inside.mean() <= 0.8 and (best is None or overlap < best[0]):
                    best = (overlap, v, limit, inside)
            if best and best[0] <= OVERLAP:
                _, v, limit, inside = best
                a = self.build(points[inside], least, random)
                b = self.build(points[~inside], least, random)
                self.nodes[at] = (v & self.mask, limit, a, b)
                return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def route(self, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
        """(leaf, indexes of the points whose ball of that radius reaches it)."""
        out, todo = [], [(0, np.arange(len(points)))]
        while todo:
            at, idx = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out.append((node, idx))
            elif len(idx):
                v, limit, a, b = node
                d = distance(points[idx] & self.mask, v)
                todo.append((a, idx[d <= limit + radius]))
                todo.append((b, idx[d > limit - radius]))
        return out


def unions(fps: np.ndarray, home: np.ndarray, counts: np.ndarray, chunk: np.ndarray, radius: int, ratio: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between home rows and all rows; where rows come in two chunks, only links across them are looked for."""
    label, pairs = np.arange(len(fps)), []
    two = len(set(chunk.tolist())) > 1
    order = np.flatnonzero(home)
    step = max(1, (1 << 20) // max(1, len(fps) * fps.shape[1]))
    for start in range(0, len(order), step):
        rows = order[start : start + step]
        near = np.bitwise_count(fps[rows, None, 0] ^ fps[None, :, 0]).astype(np.uint16)
        for k in range(1, fps.shape[1]):
            near += np.bitwise_count(fps[rows, None, k] ^ fps[None, :, k])
        close = near <= radius
        if two:
            close &= chunk[rows, None] != chunk[None, :]
        if ratio:
            low, high = np.minimum(counts[rows, None], counts[None, :]), np.maximum(counts[rows, None], counts[None, :])
            close &= low >= ratio * high
        for r in np.flatnonzero(close.sum(1) > (0 if two else 1)):
            i, met = rows[r], np.flatnonzero(close[r])
            others, first = np.unique(label[met], return_index=True)
            away = others != label[i]
            if away.any():
                pairs += [(int(i), int(met[j])) for j in first[away]]
                label[np.isin(label, others)] = label[i]
    return pairs


def links(points: DataFrame, words: int, radius: int, projections: int = 1, ratio: float = 0.0) -> DataFrame:
    """(u, v): links between fingerprints that are at most `radius` bits apart, enough of them to hold every component together.

    points: node (binary: the fingerprint, then four bytes with n), each once. With `ratio`, links are also held to n's whose smaller is at least that
    part of the larger; then points only meet points of their own and the next band of n. Rows are never dropped or capped.
    """
    ball = radius // projections
    total = points.count()
    share = min(1.0, SAMPLE / max(1, total))
    drawn = points.select("node").filter(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < int(share * (1 << 40)))  # about SAMPLE rows leave the executors
    sample = sorted(bytes(r[0]) for r in drawn.collect())
    table = np.array([np.frombuffer(x[: 8 * words], ">u8") for x in sample], np.uint64).reshape(-1, words)
    edges = np.linspace(0, 64 * words, projections + 1).astype(int)
    trees = []
    for p in range(projections):
        bits = np.zeros(64 * words, np.uint8)
        bits[edges[p] : edges[p + 1]] = 1
        tree = Tree(np.packbits(bits).view(">u8").astype(np.uint64), ball)
        tree.build(table, max(32, SHARD * len(sample) // max(1, total)), np.random.default_rng(p))
        trees.append(tree)
    held = points.sparkSession.sparkContext.broadcast(trees)  # at most SAMPLE / 32 leaves in each

    def parse(nodes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(nodes), np.uint8).reshape(len(nodes), 8 * words + 4)
        return np.ascontiguousarray(raw[:, : 8 * words]).view(">u8").astype(np.uint64), np.ascontiguousarray(raw[:, 8 * words :]).view(">u4").astype(np.int64)[:, 0]

    def route(batches):
        for batch in batches:
            nodes = batch.column(0)
            if not len(nodes):
                continue
            fps, counts = parse(nodes.to_pylist())
            band = np.floor(np.log(np.maximum(counts, 1)) / math.log(1 / ratio)).astype(np.int32) if ratio else np.zeros(len(fps), np.int32)
            for p, tree in enumerate(held.value):
                home = np.zeros(len(fps), np.int32)
                for leaf, idx in tree.route(fps, 0):
                    home[idx] = leaf
                for leaf, idx in tree.route(fps, ball):
                    for up in (0, 1) if ratio else (0,):
                        # of two shards the later one sees the pair
                        take = idx if up else idx[home[idx] <= leaf]
                        if len(take):
                            lives = (home[take] == leaf) & (not up)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), p, np.int32)), pa.array(band[take] + up), pa.array(np.full(len(take), leaf, np.int32)), pa.array(lives), nodes.take(pa.array(take))], names=["p", "band", "leaf", "home", "node"])

    routed = common.staged(points.select("node").mapInArrow(route, "p int, band int, leaf int, home boolean, node binary"), "simhash-routed")
    sizes = routed.groupBy("p", "band", "leaf").agg(F.count("*").alias("_n"), F.count_if("home").alias("_h")).filter("_n > 1 and _h > 0").withColumn("_m", F.ceil(F.col("_n") / TILE).cast("int"))
    # rows are few bytes and much work: a set number of partitions, as those that follow the bytes would be joined into a few
    work = sizes.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / TASK))
    chunk = F.pmod(F.xxhash64("node"), F.col("_m")).cast("int")
    dealt = (
        routed.join(F.broadcast(sizes.drop("_n", "_h")), ["p", "band", "leaf"])  # a row for each shard that the trees have
        .withColumn("c", chunk)
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .select("p", "band", "leaf", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "home", "node")
    )
    key = ["p", "band", "leaf", "a", "b"]

    def search(batches):
        held_rows: list = []
        current = None

        def flush():
            if len(held_rows) > 1:
                fps, counts = parse([r[2] for r in held_rows])
                found = unions(fps, np.array([r[1] for r in held_rows]), counts, np.array([r[0] for r in held_rows]), radius, ratio)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([held_rows[i][2] for i, _ in found], pa.binary()), pa.array([held_rows[j][2] for _, j in found], pa.binary())], names=["u", "v"])
            held_rows.clear()

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(5)], 1)
            rows = list(zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(rows)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y > x:
                    if current != (now := tuple(keys[x].tolist())):
                        yield from flush()
                        current = now
                    held_rows.extend(rows[x:y])
        yield from flush()

    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(search, "u binary, v binary")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, words: int = 1, radius: int = 3, projections: int = 2, ratio: float = 0.0) -> DataFrame:
    """One row per row of df: key, fp, n_shingles and component_id, the smallest key that is reached over links.

    Null texts count as empty; all texts without words share the zero fingerprint and so one component. Null keys are passed over in the minimum: a
    component of null keys only has a null id. Repeated rows and keys stay. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = common.staged(fingerprints(df.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text", size, words).withColumn("node", F.concat("fp", F.unhex(F.lpad(F.hex("n_shingles" if ratio else F.lit(0)), 8, "0")))), "simhash-rows")
    points = common.staged(rows.groupBy("node").agg(F.min("_id").alias("_first")), "simhash-points")
    roots = common.staged(components(links(points, words, radius, projections, ratio)), "simhash-roots")
    placed = points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.join(placed.groupBy("root").agg(F.min("_first").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node").select(F.col("_id").alias(key), "fp", "n_shingles", "component_id")


def similar_pairs(fps: np.ndarray, grams: list[np.ndarray], chunk: np.ndarray, radius: int, similar: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are within the radius and whose shingles (counted, as sets) have the similarity; where rows come in two
    chunks, only pairs across them are looked for."""
    label, pairs = np.arange(len(fps)), []
    two = len(set(chunk.tolist())) > 1
    sizes = np.array([len(g) for g in grams])
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    held = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(ids), bool)
    for i in range(1, len(fps)):
        low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
        can = (label[:i] != label[i]) & (low > 0) & (low >= similar * high)
        if two:
            can &= chunk[:i] != chunk[i]
        met = np.flatnonzero(can)
        apart = distance(fps[met], fps[i])
        # the nearest first: most rows of one component are then passed over
        met = met[apart <= radius][np.argsort(apart[apart <= radius], kind="stable")]
        if not len(met):
            continue
        mark[held[i]] = True
        at, step = 0, 16
        while at < len(met):
            part = met[at : at + step]
            part = part[label[part] != label[i]]
            at, step = at + step, min(4096, 4 * step)
            if not len(part):
                continue
            starts = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            shared = np.add.reduceat(mark[np.concatenate([held[j] for j in part])], starts, dtype=np.int64)
            for j in part[shared / (sizes[part] + sizes[i] - shared) >= similar]:
                if label[j] != label[i]:
                    pairs.append((int(i), int(j)))
                    label[label == label[j]] = label[i]
        mark[held[i]] = False
    return pairs


def similar_links(texts: DataFrame, size: int, words: int, radius: int, similar: float) -> DataFrame:
    """(u, v): links between texts of one component of candidates whose counted shingles have the similarity.

    texts: same (string), each once, node (as in links()), root, weight, _text. Components that are too large are dealt into square tiles.
    """
    parts = texts.groupBy("root").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n")).filter("_n > 1").select("root", "_w", F.ceil(F.col("_w") / PART).cast("int").alias("_m"))
    parts = common.staged(parts, "simhash-parts")
    work = parts.agg(F.sum(F.col("_w") * F.col("_m"))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(work / PART))
    held = common.map_texts(texts.select("same", "node", "root", "_text"), "_text", lambda: lambda ts: [[counted_shingles(t, size) for t in ts]], "grams binary", [pa.binary()])
    dealt = (
        held.join(F.broadcast(parts) if parts.count() <= common.BROADCAST_KEYS else parts, "root")
        .withColumn("c", F.pmod(F.xxhash64("same"), F.col("_m")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .select("root", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "same", F.substring("node", 1, 8 * words).alias("fp"), "grams")
    )

    def search(batches):
        rows: list = []
        current = None

        def flush():
            if len(rows) > 1:
                fps = np.frombuffer(b"".join(r[2] for r in rows), ">u8").astype(np.uint64).reshape(len(rows), words)
                found = similar_pairs(fps, [np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[0] for r in rows]), radius, similar)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i, _ in found]), pa.array([rows[j][1] for _, j in found])], names=["u", "v"])
            rows.clear()

        for batch in batches:
            for root, a, b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (root, a, b):
                    yield from flush()
                    current = (root, a, b)
                rows.append(row)
        yield from flush()

    return dealt.repartition(tasks, "root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(search, "u string, v string")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, words: int = 4, radius: int = 80, projections: int = 1, similar: float = 0.8) -> DataFrame:
    """One row per row of df: key and component_id, the smallest key that is reached over pairs whose counted shingles have the similarity (what both
    have as part of what one or the other has).

    The preset is for a similarity of 0.8 on five-word shingles: such texts' fingerprints of 256 bits differ in 39 bits, give or take 6 (of five
    shingles, one more than in the other text: in 48, give or take 6), unrelated ones in 128, give or take 8. Texts with the same words in the same
    order are one; edge cases as in near_groups().
    """
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    same = F.md5(F.trim(F.regexp_replace(F.translate(common.text_of("_text"), letters, letters.lower()), r"[\x20\x09-\x0D]+", " ")).cast("binary"))
    own = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).withColumn("same", same)
    rows = common.staged(fingerprints(own, "_text", size, words, True).withColumn("node", F.concat("fp", F.unhex(F.lpad(F.hex("n_shingles"), 8, "0")))), "simhash-rows")
    once = common.staged(rows.groupBy("same").agg(F.min("_id").alias("_first"), F.first("node").alias("node"), (F.first("n_shingles") + EACH).alias("weight")), "simhash-once")
    roots = common.staged(components(links(once.select("node").distinct(), words, radius, projections, similar)), "simhash-roots")
    placed = once.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("root").agg(F.count("*").alias("_n")).filter("_n > 1").select("root")
    open_rows = common.staged(placed.join(several, "root").select("same", "node", "root", "weight"), "simhash-open")
    small = open_rows.count() <= common.BROADCAST_KEYS // 5  # rows of some 130 bytes
    texts = own.select("same", "_text").join(F.broadcast(open_rows) if small else open_rows, "same").dropDuplicates(["same"])
    linked = common.staged(components(similar_links(common.staged(texts, "simhash-texts"), size, words, radius, similar)), "simhash-linked")
    ends = once.join(linked.withColumnRenamed("node", "same").withColumnRenamed("root", "end"), "same", "left").select("same", "_first", F.coalesce("end", "same").alias("end"))
    named = ends.join(ends.groupBy("end").agg(F.min("_first").alias("component_id")), "end").select("same", "component_id")
    return rows.join(named, "same").select(F.col("_id").alias(key), "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, words: int = 4, radius: int = 80, projections: int = 1, similar: float = 0.8) -> DataFrame:
    """df with one document of each component of near_copies(), all columns: the one with the smallest key. Rows with a null key stay unless a key stands
    for their component; rows that share the key that stays all stay."""
    groups = near_copies(df, key, text, size, words, radius, projections, similar)
    lost = common.staged(groups.filter(F.col("component_id").isNotNull() & ~F.col(key).eqNullSafe(F.col("component_id"))).select(key).distinct(), "simhash-lost")
    return common.without(df, lost, key)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
