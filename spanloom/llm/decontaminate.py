"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index of fingerprint blocks that finds every item within a Hamming
radius, and the exact similarity of weighted (counted) word shingles as the last word. DataFrame functions only.

A fingerprint has 256 bits in 16 blocks of 16. Two that differ in at most 63 bits differ in at most 3 within one block, so each item stands in the index
under all values that are within 3 bits of its blocks (697 each), and a window is looked up by its 16 values alone. Of unrelated fingerprints one in
six meets so; hardly any is within the radius, as they differ in 128 bits, give or take 8.

Windows that cannot reach the similarity are left out before they are fingerprinted, by an exact bound: a window and an item whose shared counts make up
the part s of all must share at least s / (1 + s) of their shingles taken together, so only windows with so many shingles of some item's are made. Which
items a window is then held against is for the index to say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a shingle; least similarity; words of 64 bits in a fingerprint; bits of a block of the index and in how many it may differ. The radius follows:
#: one less than (NEAR + 1) times the blocks. At the least similarity fingerprints differ in 39 bits give or take 6.
SHINGLE, SIMILAR, WORDS, BLOCK, NEAR = 5, 0.8, 4, 16, 3
BLOCKS = 64 * WORDS // BLOCK
RADIUS = (NEAR + 1) * BLOCKS - 1
#: Rows, at most, of an index over the benchmark that is sent to all executors.
BROADCAST_ROWS = 1_000_000
KEY = ("k1", "k2")


def words_of(text: str) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.filter(F.split(F.lower(common.text_of(text)), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def text_key(text: str) -> list[Column]:
    """128 bits that stand for the text."""
    return [F.xxhash64(common.text_of(text)).alias("k1"), F.xxhash64(F.lit(1), common.text_of(text)).alias("k2")]


def shingled(df: DataFrame, text: str, n: int) -> DataFrame:
    """df with n_words and grams, the hashes of all runs of n words in order."""
    hashed = df.withColumn("_w", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(n))))
    return hashed.withColumns({"n_words": F.size("_w"), "grams": F.when(F.size("_w") >= n, grams).otherwise(F.array().cast("array<bigint>"))}).drop("_w")


def simhash(df: DataFrame, by: list[str]) -> DataFrame:
    """df (by and a gram a row) to one row for each `by`, with fp0, fp1 and so on: the bits that are set in over half of its grams. Two counters share a
    sum."""
    pair, low = 0x0000000100000001, 0xFFFFFFFF
    hashed = df.select(*by, *(F.expr(f"xxhash64({k}, gram) as _g{k}") for k in range(WORDS)))
    # as texts: thousands of calls into the JVM less
    sums = [F.expr(f"sum(shiftrightunsigned(_g{k}, {b}) & {pair}L) as _s{k}_{b}") for k in range(WORDS) for b in range(32)]
    bits = [[f"shiftleft(cast(2 * ({f'_s{k}_{b} & {low}L' if b < 32 else f'shiftrightunsigned(_s{k}_{b - 32}, 32)'}) > _n as bigint), {b})" for b in range(64)] for k in range(WORDS)]
    return hashed.groupBy(*by).agg(F.count("*").alias("_n"), *sums).select(*by, *(F.expr(f"{' | '.join(x)} as fp{k}") for k, x in enumerate(bits)))


def block_values(masks: list[int]) -> Column:
    """(block, value) for each block of the fingerprint and each mask over it, to be exploded."""
    each = [F.shiftrightunsigned(f"fp{k}", at).bitwiseAND(F.lit((1 << BLOCK) - 1)).cast("int") for k in range(WORDS) for at in range(0, 64, BLOCK)]
    held = F.array(*(F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(each)))
    if masks == [0]:
        return held
    return F.flatten(F.transform(held, lambda h: F.transform(F.expr(f"array({', '.join(map(str, masks))})"), lambda m: F.struct(h["block"].alias("block"), h["value"].bitwiseXOR(m).alias("value")))))


def apart() -> Column:
    """Bits in which fp0... and other0... differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"fp{k}").bitwiseXOR(F.col(f"other{k}"))) for k in range(WORDS)])


def candidates(prints: DataFrame, of_items: DataFrame, window: list[str], what: str = "") -> DataFrame:
    """(window, item) for all windows (with m and fp0...) and items (item, m, fp0...) of one m whose fingerprints are within the radius: found by the
    index, then held to the radius."""
    masks = [x for x in range(1 << BLOCK) if x.bit_count() <= NEAR]
    code = F.xxhash64("item")  # items with one code are both candidates
    index = of_items.select("m", code.alias("code"), F.explode(block_values(masks)).alias("b")).select("m", "code", "b.block", "b.value")
    index = sendable(common.staged(index, f"index{what}"))
    met = prints.select(*window, *(f"fp{k}" for k in range(WORDS)), F.explode(block_values([0])).alias("b")).select(*window, *(f"fp{k}" for k in range(WORDS)), "b.block", "b.value")
    near = met.join(index, ["m", "block", "value"]).drop("block", "value").distinct()
    others = of_items.select(code.alias("code"), "item", *(F.col(f"fp{k}").alias(f"other{k}") for k in range(WORDS)))
    return near.join(sendable(others), "code").filter(apart() <= RADIUS).select(*window, "item")


def sendable(df: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if its rows are few enough; else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_table(items: DataFrame, text: str, n: int, least: int) -> DataFrame:
    """(item, m, gram, count) for the distinct texts of at least `least` words (and, for n < SHINGLE, exactly n)."""
    rows = items.select(F.col(text).alias("_text")).withColumn("_words", words_of("_text")).select("_text", F.md5(F.array_join("_words", " ").cast("binary")).alias("item"))
    grams = shingled(rows, "_text", n).filter(F.col("n_words") >= least if least == n == SHINGLE else F.col("n_words") == n)
    once = grams.groupBy("item").agg(F.first("grams").alias("grams"))
    return once.select("item", F.size("grams").alias("m"), F.explode_outer("grams").alias("gram")).groupBy("item", "m", "gram").count()


def matches(docs: DataFrame, items: DataFrame, n: int, text: str, similar: float) -> DataFrame:
    """(k1, k2, item, similarity, start_word, n_windows) for shingles of n words."""
    table = common.staged(item_table(items, text, n, n), f"items-{n}")
    if table.isEmpty():
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, item string, similarity double, start_word long, n_windows long")
    own = docs.select(*text_key(text), F.col(text).alias("_text"))
    lookup = sendable(table.select("gram", "item", "m"))
    # outer: else the optimiser derives a filter on the array and works it out a second time, word by word; the join drops the nulls
    seen = shingled(own, "_text", n).select(*KEY, (F.col("n_words") - (n - 1)).alias("all"), F.posexplode_outer("grams").alias("at", "gram")).join(lookup, "gram")
    size = F.least("m", "all")
    need = F.ceil(similar / (1 + similar) * (F.col("m") + size) - 1e-9).cast("int")
    hits = seen.groupBy(*KEY, "all", "item", "m").agg(F.sort_array(F.collect_set("at")).alias("ats")).withColumns({"size": size, "need": need}).filter("size(ats) >= need")
    first, final = (lambda i: F.get("ats", i)), (lambda i: F.get("ats", i + F.col("need") - 1))
    starts = F.transform(
        F.sequence(F.lit(0), F.size("ats") - F.col("need")),
        lambda i: F.when(final(i) - first(i) < F.col("size"), F.sequence(F.greatest(F.lit(0), final(i) - F.col("size") + 1), F.least(first(i), F.col("all") - F.col("size")))).otherwise(F.array().cast("array<int>")),
    )
    fits = lambda a: F.filter(a, lambda s: (s >= 0) & (s <= F.col("all") - F.col("size")))
    windows = common.staged(hits.select(*KEY, "m", "size", F.explode(F.array_distinct(F.flatten(F.transform(starts, fits)))).alias("start")).distinct(), f"windows-{n}")
    wanted = common.staged(windows.select(*KEY).distinct(), f"wanted-{n}")
    texts = own.join(sendable(wanted), list(KEY), "left_semi").groupBy(*KEY).agg(F.first("_text").alias("_text"))
    grams = common.staged(shingled(texts, "_text", n).select(*KEY, "grams"), f"grams-{n}").join(windows, list(KEY)).select(*KEY, "m", "size", "start", F.explode(F.slice("grams", F.col("start") + 1, F.col("size"))).alias("gram"))
    window = [*KEY, "m", "size", "start"]
    of_items = common.staged(simhash(table.select("item", "m", F.explode(F.array_repeat("gram", F.col("count").cast("int"))).alias("gram")), ["item", "m"]), f"prints-{n}")
    found = candidates(common.staged(simhash(grams, window), f"window-prints-{n}"), of_items, window, f"-{n}")
    counted = grams.groupBy(*window, "gram").agg(F.count("*").alias("here"))
    shared = counted.join(found, window).join(sendable(table.select("item", "gram", "count")), ["item", "gram"]).groupBy(*window, "item").agg(F.sum(F.least("here", "count")).alias("x"))
    verified = shared.withColumn("similarity", F.col("x") / (F.col("m") + F.col("size") - F.col("x"))).filter(F.col("similarity") >= similar)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s")))
    return verified.groupBy(*KEY, "item").agg(best.alias("b"), F.count("*").alias("n_windows")).select(*KEY, "item", "b.similarity", (-F.col("b.s")).cast("long").alias("start_word"), "n_windows")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for each pair of a row of docs and an item that a window of the document is similar to: key, item_key, similarity of the best window
    (the first such), start_word of it, and n_windows, the number of windows that are similar enough.

    Texts are lower-cased runs of letters, marks and digits. An item of fewer than five words is one shingle of all its words; documents shorter than
    an item are one window. Null texts and texts without words match nothing. Equal items, and rows that repeat, each get their own result rows; null
    keys stay null. Empty tables give an empty result. Other columns are not looked at.
    """
    items = items.select(F.col(item_key).alias("item_key"), F.col(text).alias("text"))
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
    sizes = {r[0] for r in items.select(F.least(F.size(words_of("text")), F.lit(SHINGLE))).distinct().collect()}  # six at most
    found = common.staged(reduce(DataFrame.unionByName, [matches(rows, items, n, "text", similar) for n in sorted(sizes - {0}) or [SHINGLE]]), "contaminated")
    named = items.select("item_key", F.md5(F.array_join(words_of("text"), " ").cast("binary")).alias("item"))
    pairs = found.join(sendable(common.staged(named, "names")), "item")
    keyed = rows.select("_id", *text_key("text"))
    return keyed.join(sendable(common.staged(pairs, "pairs")), list(KEY)).select(F.col("_id").alias(key), F.col("item_key").alias(item_key), "similarity", "start_word", "n_windows")


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item, all columns; edge cases as in contaminated(), and rows are told apart by their key alone."""
    found = contaminated(docs, items, key, items.columns[0], text)
    return common.without(docs, common.staged(found.select(key).distinct(), "lost"), key)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') as w from benchmark),
ds as (select doc_id, i - 1 as pos, array_to_string(w[i:i + 4], ' ') as g, len(w) - 4 as total from (select *, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
bs as (select item_id, g, count(*) as c, any_value(m) as m from (select item_id, array_to_string(w[i:i + 4], ' ') as g, len(w) - 4 as m from (select *, unnest(range(1, len(w) - 3)) as i from b where len(w) >= 5)) group by 1, 2),
starts as (select distinct doc_id, item_id, m, total, least(m, total) as size, unnest(range(greatest(0, pos - least(m, total) + 1), least(pos, total - least(m, total)) + 1)) as s from ds join bs using (g)),
windows as (select doc_id, item_id, m, size, s, g, count(*) as here from starts join ds using (doc_id) where pos between s and s + size - 1 group by all),
sim as (select doc_id, item_id, s, any_value(m) as m, any_value(size) as size, sum(least(here, c)) as x from windows join (select item_id, g, c from bs) using (item_id, g) group by 1, 2, 3),
ok as (select *, cast(x as double) / (m + size - x) as similarity from sim where cast(x as double) / (m + size - x) >= 0.8),
k as (select item_id, len(w) as n, array_to_string(w, ' ') as g from b where len(w) between 1 and 4),
shorts as (select doc_id, n, i - 1 as s, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d cross join (select distinct n from k) where len(w) >= n))
select doc_id, item_id, max(similarity) as similarity, cast(arg_min(s, struct_pack(a := -similarity, b := s)) as bigint) as start_word, count(*) as n_windows from ok group by 1, 2
union all
select doc_id, item_id, 1.0::double as similarity, cast(min(s) as bigint) as start_word, count(*) as n_windows from shorts join k using (n, g) group by 1, 2
"""
