import collections
import hashlib
import random

import numpy as np
import pytest
from oracle import check
from pyspark.sql import functions as F

from spanloom.llm import anchors, common, components, decontaminate, exact_dedup, sharding, simhash, suffix_dedup

DOCS = "doc_id long, text string, k1 int, best int, n int, body int, _id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], DOCS)


EDGE = [(1, "a b"), (1, "a b"), (2, "a  b"), (3, None), (4, " "), (None, ""), (5, "zz"), (None, "zz"), (6, "w " * 30000)]


def test_op7_sql(spark, sf_dir):
    assert check(spark, exact_dedup.op7_exact_dedup, exact_dedup.OP7_SQL, sf_dir) == 200


@pytest.mark.parametrize("rows", [100_000, 0])
def test_exact_dedup(spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", rows)
    got = sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, EDGE)).collect())
    assert got == [(0, 4, 3, False), (0, 5, 2, False), (1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 2, True), (6, 6, 1, True)]
    left = exact_dedup.deduplicated(docs(spark, [*EDGE, (2, "a  b")]))
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6] and left.columns == docs(spark, []).columns
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1 << 30, 1 << 15])
@pytest.mark.parametrize("scale", [1, 40])
def test_refinement_hashes_whole_texts_in_open_groups_only(spark, monkeypatch, most, scale):
    """At any number of groups: closed by length, closed by prefix, open with different ends, open with equal texts."""
    monkeypatch.setattr(exact_dedup, "MOST_BITS", most)
    alone = ["x" * (100 + i) for i in range(50)]
    closed = [f"{i:06d}" + "y" * 64 for i in range(50 * scale)]
    same = [f"{i:06d} " + "z" * 60 + e for i in range(20 * scale) for e in ("1", "2", "2")]
    texts = [*alone, *closed, *same, "p" * 64 + "1", "p" * 64 + "2"]
    done = exact_dedup.refined(docs(spark, enumerate(texts)).select(F.col("doc_id").alias("id"), "text")).collect()
    full = collections.Counter(r.text for r in done if r.full)
    extra = full - collections.Counter(texts[len(alone) + len(closed) :])  # chance agreements of two hashes in the bitmap
    assert not collections.Counter(texts[len(alone) + len(closed) :]) - full and len(done) == len(texts)
    assert extra.total() <= len(closed) / 8 and not set(extra) & set(alone)
    assert all(r.full == hashlib.sha256(r.text.replace(" ", "").encode()).hexdigest() for r in done if r.full)


NAMES = "group_size _size _head _open _full _chars _same _win full chars win id row keep_id kept _gone _norm _spot _part _map part map spot head size".split()


def test_columns_with_the_names_of_working_columns(spark):
    rows = spark.createDataFrame([(1, "a b", *range(len(NAMES))), (2, "ab", *range(len(NAMES))), (3, "c", *range(len(NAMES)))], ["doc_id", "text", *NAMES])
    left = exact_dedup.deduplicated(rows)
    assert left.columns == rows.columns and sorted(map(tuple, left.collect())) == [(1, "a b", *range(len(NAMES))), (3, "c", *range(len(NAMES)))]
    got = exact_dedup.exact_groups(rows, carry={"full": F.col("text")}).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.full) for r in got] == [(1, 1, "a b"), (2, 1, "ab"), (3, 3, "c")]
    gone = common.without(rows, rows.filter("doc_id = 1").select("doc_id"), "doc_id")
    assert gone.columns == rows.columns and gone.count() == 2


def brute_components(n, linked):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(0, i) for i in range(60, 90)] + [(i, i + 1) for i in range(100, 130)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long")).collect()}
    want = brute_components(131, lambda i, j: (i, j) in edges or (j, i) in edges)
    assert [found.get(i, i) for i in range(131)] == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


@pytest.mark.parametrize(("shard", "tile"), [(2048, 8192), (32, 40)])
def test_simhash_against_all_pairs(spark, monkeypatch, shard, tile):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    rows = [(None, ""), (7, None), (8, " \t"), (9, "One"), (9, "One"), (10, "É é"), (None, "one")]
    for g in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 300))]
        for k in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    got = simhash.near_groups(docs(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert collections.Counter(r.fp.hex() for r in got) == collections.Counter(f"{p:016x}" for p in prints)
    label = brute_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    low = {}
    for (i, _), x in zip(rows, label):
        low[x] = min(low.get(x, 10**9), i if i is not None else 10**9)
    want = collections.Counter((i, low[x] if low[x] < 10**9 else None) for (i, _), x in zip(rows, label))
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want


def test_near_dedup_stage(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near, half = list(base), base[:200] + [f"v{rng.randrange(5000)}" for _ in range(200)]
    near[50], near[300] = "x", "y"
    rows = [(3, " ".join(base)), (2, " ".join(near)), (1, " ".join(half)), (4, "short text"), (None, None)]
    left = simhash.deduplicated(docs(spark, rows))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 4] and left.columns == docs(spark, []).columns
    assert simhash.deduplicated(docs(spark, [])).count() == 0


def plain_similarity(a, b):
    a, b = (collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.split(), b.split()))
    return sum((a & b).values()) / sum((a | b).values())


@pytest.mark.parametrize("part", [4_000_000, 3000])
def test_near_copies_against_shingle_similarity(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng, rows = random.Random(11), []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([9, 60, 200, 400]))]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 20))):
                copy[at] = f"v{rng.randrange(5000)}"
            rows.append((10 * g + k, " ".join(copy)))
    # a shingle that is there again and again: similarity 0.8 and a fingerprint far away if repeats weigh as often as they come
    words = [f"r{i}" for i in range(204)]
    rows += [(9000, " ".join(words)), (9001, " ".join([*words, *["z"] * 50]))]
    sims = {(i, j): plain_similarity(rows[i][1], rows[j][1]) for i in range(len(rows)) for j in range(i) if rows[i][0] // 10 == rows[j][0] // 10}
    assert sum(0.65 <= s < 0.8 for s in sims.values()) > 30 and sum(0.8 <= s < 0.9 for s in sims.values()) > 30
    assert sims[len(rows) - 1, len(rows) - 2] >= 0.8
    label = brute_components(len(rows), lambda i, j: sims.get((i, j), 0) >= 0.8)
    left = {r.doc_id for r in simhash.deduplicated(docs(spark, rows)).collect()}
    assert left == {rows[x][0] for x in label}


def test_ratio_and_tiles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng, rows = random.Random(8), []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 80))]
        for k in range(6):
            cut = base[: len(base) - rng.randint(0, len(base) // 2)] + ["z"] * rng.randint(0, 2)
            rows.append((10 * g + k, " ".join(cut)))
    got = {r.doc_id: r for r in simhash.near_groups(docs(spark, rows), size=5, words=4, radius=48, projections=1, ratio=0.8).collect()}
    fps, ns = [int.from_bytes(got[i].fp) for i, _ in rows], [got[i].n_shingles for i, _ in rows]
    label = brute_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 48 and min(ns[i], ns[j]) >= 0.8 * max(ns[i], ns[j]))
    assert [got[i].component_id for i, _ in rows] == [rows[x][0] for x in label]


def brute_repeats(texts, width):
    count, out = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1)), []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if count[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        out.append((len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("classes", [20_000, 4])
def test_repeats_against_brute_force(spark, monkeypatch, classes):
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    monkeypatch.setattr(suffix_dedup, "SORTED", 500)
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab c") for _ in range(rng.randint(50, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 40) : rng.randint(60, 300)] if rng.random() < 0.7 else rng.choice(["a" * rng.randint(1, 300), "xyz" * 50, "é" * 30]) for _ in range(rng.randint(0, 8)))) for i in range(100)]
    rows += [(200, None), (201, None), (202, ""), (203, "q" * 99), (204, "q" * 99), (205, "r" * 100), (205, "r" * 100), (None, parts[0])]
    out = suffix_dedup.without_repeats(docs(spark, rows), width=100)
    want = brute_repeats([(t or "").encode() for _, t in rows], 100)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == collections.Counter((i, *w) for (i, _), w in zip(rows, want))
    assert suffix_dedup.without_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("classes", [20_000, 3])
def test_groups_have_all_their_occurrences(spark, monkeypatch, classes):
    """Of every group: the string is the same at all places, and there is no other place; what repeats is in a group; one string has one group."""
    monkeypatch.setattr(suffix_dedup, "CLASSES", classes)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(134)
    texts = [word(30) + shared + word(30), word(9) + shared + "x", shared, word(5) + shared[:110] + word(50), word(200)]
    texts += ["".join(rng.choice(texts)[rng.randint(0, 60) :][:150] for _ in range(4)) for _ in range(20)]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(bytes([i]), bytearray(t.encode())) for i, t in enumerate(texts)], "digest binary, body binary")
    ranges = suffix_dedup.repeat_groups(rows, 100).toPandas()
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeat_groups(rows, 100, expand=True).collect():
        got[bytes(r.repeat), r.length].add((r.digest[0], r.start))
    assert len(ranges) == len({(bytes(a), b) for a, b in zip(ranges["repeat"], ranges["length"])}) == len(got)
    strings = set()
    for (_, size), places in got.items():
        i, at = min(places)
        string = texts[i][at : at + size]
        assert places == {(k, p) for k, t in enumerate(texts) for p in range(len(t)) if t.startswith(string, p)} and len(places) > 1
        strings.add(string)
    assert len(strings) == len(got)
    if classes > 3:
        assert {(k, t.index(shared)) for k, t in enumerate(texts) if shared in t} <= set().union(*(p for (_, n), p in got.items() if n >= 100))


def test_long_texts_are_cut_as_one(spark):
    """Texts beyond one chunk, with a repeat across its border."""
    rng = random.Random(4)
    body = bytes(rng.randrange(97, 123) for _ in range((1 << 19) + 3000))
    cut = anchors.Cutter(400)(body)
    assert cut.count.sum() == len(body) - 399 and len(set((cut.start + cut.offset).tolist())) == len(cut.start)
    passage = body[(1 << 19) - 300 : (1 << 19) + 700].decode()
    rows = [(1, body.decode()), (2, "q" * 50 + passage + "q" * 50)]
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs(spark, rows), keep_text=False).collect()}
    assert got[1].n_removed == got[2].n_removed == 1000 and got[1].n_spans == 1


def test_op5(spark, sf_dir):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(texts, brute_repeats(list(texts.values()), 400)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op5_suffix_dedup(spark, sf_dir).collect()} == want


def test_interval_tree():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(2, 30)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        lcp = [next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), len(text)) for a, b in zip(order, order[1:])]
        left = [ord(text[i - 1]) if i else -1 for i in order]
        got = {(size, text[order[a] : order[a] + size]): diverse for size, a, b, diverse in suffix_dedup.intervals(lcp, left, 2)}
        want = {}
        for size in range(2, len(text)):
            for start in range(len(text) - size + 1):
                word = text[start : start + size]
                at = [i for i in range(len(text)) if text.startswith(word, i)]
                if len(at) > 1 and len({text[i + size : i + size + 1] or i for i in at}) > 1:
                    seen = [text[i - 1] for i in at if i]
                    want[size, word] = len(set(seen)) > 1 or len(seen) < len(at)
        assert got == want


def test_op10_sql(spark):
    assert check(spark, decontaminate.op10_decontamination, decontaminate.OP10_SQL, "/root/testdata/sf0.01") > 0


def test_op10_sql_with_short_items_and_long_texts(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [text(n) for n in (2, 2, 2, 2, 5, 6, 9, 20, 60, 60)] + ["w1 w2", "w1, W2!", "", "..."] + [text(30)] * 2
    rows = [text(rng.randint(0, 12)) + " " + rng.choice(items) + " " + text(rng.randint(0, 12)) for _ in range(60)] + [text(2000) + " " + items[8] + " " + text(300), "", "w1 w2 w1 w2"]
    for i in range(40):
        w = rng.choice(items[6:10] + items[-1:]).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append(text(5) + " " + " ".join(w) + " " + text(5))
    spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(900, None)], "doc_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None)], "item_id long, text string").coalesce(1).toPandas().to_parquet(tmp_path / "benchmark.parquet")
    assert check(spark, decontaminate.op10_decontamination, decontaminate.OP10_SQL, str(tmp_path)) > 80


def test_index_finds_all_within_the_radius_and_prunes(spark):
    rng = np.random.default_rng(3)
    items = rng.integers(-(1 << 63), (1 << 63) - 1, (40, 4))
    rows = []
    for i in range(400):
        bits = np.zeros(256, np.uint8)
        bits[rng.permutation(256)[: rng.integers(0, 90)]] = 1
        rows.append(items[i % 40] ^ np.packbits(bits).view(">i8").astype(np.int64))
    far = [*rows, *rng.integers(-(1 << 63), (1 << 63) - 1, (400, 4))]
    names = [f"fp{k}" for k in range(4)]
    prints = spark.createDataFrame([(i, 7, *map(int, r)) for i, r in enumerate(far)], ["w", "m", *names])
    of_items = spark.createDataFrame([(str(i), 7, *map(int, r)) for i, r in enumerate(items)], ["item", "m", *names])
    got = {(r.w, int(r.item)) for r in decontaminate.candidates(prints, of_items, ["w", "m"]).collect()}
    apart = lambda a, b: sum(int(x).bit_count() for x in (np.array(a) ^ np.array(b)).astype(np.uint64))
    assert got == {(i, j) for i, a in enumerate(far) for j, b in enumerate(items) if apart(a, b) <= decontaminate.RADIUS}
    index = of_items.select("item", F.explode(decontaminate.block_values([x for x in range(1 << 16) if x.bit_count() <= 3])).alias("b"))
    unrelated = prints.filter("w >= 400").select("w", F.explode(decontaminate.block_values([0])).alias("b"))
    met = unrelated.join(index, "b").select("w", "item").distinct().count()
    assert met < 0.25 * 400 * 40


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_decontamination_edge_cases(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    long = [f"w{i}" for i in range(80)]
    edited = [*long[:20], "zz", *long[20:]]
    d = docs(spark, [(1, "Alpha, beta GAMMA"), (2, None), (2, "alpha beta"), (3, "x " * 9 + " ".join(edited) + " y" * 9), (None, " ".join(long)), (4, " ".join(long[:74])), (5, " ".join(long[:20])), (6, "")])
    items = spark.createDataFrame([(7, "alpha beta gamma", 0), (8, None, 0), (9, "", 0), (10, " ".join(long), 0), (11, " ".join(long).upper(), 0), (None, "nothing of the kind here at all", 0)], "item_id long, text string, k1 int")
    found = decontaminate.contaminated(d, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (3, 10), (3, 11), (None, 10), (None, 11), (4, 10), (4, 11)}
    left = decontaminate.decontaminated(d, items)
    assert sorted(r.doc_id for r in left.collect()) == [2, 2, 5, 6] and left.columns == d.columns
    assert decontaminate.contaminated(d, items.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), items).count() == 0


def least_capacity(weights, shards):
    def fits(c):
        used, now = 1, 0
        for w in weights:
            if now + w > c:
                used, now = used + 1, 0
            now += w
        return used <= shards

    return next(c for c in range(max(weights), sum(weights) + 1) if fits(c))


@pytest.mark.parametrize(("blocks", "shards", "top"), [(64, 3, 10**4), (16, 9, 10**15), (16, 5, 70)])
def test_sharding(spark, monkeypatch, blocks, shards, top):
    monkeypatch.setattr(sharding, "BLOCKS", blocks)
    rng = random.Random(blocks + shards)
    rows = [(i, "x" * rng.randint(0, 300) + str(k)) for k, i in enumerate(rng.sample(range(-1000, top), 60))]
    got = sharding.sharded(docs(spark, rows), shards).toPandas()
    assert got.groupby("shard")["size"].sum().max() == least_capacity([len(t) + 8 for _, t in sorted(rows)], shards)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_sharding_keeps_groups_together(spark):
    rows = [(1 + i, "hot" * 50) for i in range(40)] + [(100 + i, f"text {i}") for i in range(40)] + [(None, None), (None, ""), (7, "dup"), (7, "dup")]
    got = sharding.sharded(docs(spark, rows), 6).toPandas()
    assert got[got["size"] == 158].shard.nunique() == 1 and got.shard.between(0, 5).all() and len(got) == len(rows)
    rest = got[got["size"] != 158].groupby("shard")["size"].sum()
    assert len(rest) == 5 and rest.max() < 1.5 * rest.mean() and got.grown_shard.isna().all()
    assert sharding.sharded(docs(spark, []), 6).count() == 0 and sharding.sharded(docs(spark, [(1, "a")]), 1).count() == 1


def test_routing_reaches_all_near_points():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 63, (3000, 1)).astype(np.uint64)
    points = np.concatenate([points, points[:500] ^ (np.uint64(1) << rng.integers(0, 64, (500, 1)).astype(np.uint64))])
    tree = simhash.Tree(np.array([0xFFFFFFFF], np.uint64), 1)
    tree.build(points[:1000], 40, np.random.default_rng(0))
    assert tree.leaves > 4
    home, reach = {}, collections.defaultdict(set)
    for leaf, idx in tree.route(points, 0):
        home |= dict.fromkeys(idx.tolist(), leaf)
    for leaf, idx in tree.route(points, 1):
        for i in idx.tolist():
            reach[i].add(leaf)
    low = points & np.uint64(0xFFFFFFFF)
    for i in range(3000, 3500):
        near = np.flatnonzero(np.bitwise_count(low[:, 0] ^ low[i, 0]) <= 1)
        assert {home[j] for j in near.tolist()} <= reach[i]
