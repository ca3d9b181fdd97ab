"""Language identification with a bit-sliced Bloom filter over character n-grams: every slot holds one bit for each language, so one probe of an n-gram
gives all languages that have it. Per-language counts, less the false positives to be expected, decide."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Slots and probes of the filter; sample texts of a language; languages at most (bits of a slot).
SLOTS, PROBES, PER_LANGUAGE, LANGUAGES = 1 << 20, 4, 1500, 64
#: An n-gram belongs to a language if it is in this share of its sample texts, and in this part of the share that it has where it is most common.
SHARE, PART = 0.01, 0.4
#: Rows that are drawn for the sample, as a multiple of it.
DRAWN = 4
SIZES = (1, 2, 3, 4)
REMEMBERED, LONGEST = 300_000, 48
RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters (categories L*). What counts as a word character besides, like ², ½ or Ⅷ, are numbers, and part runs."""
    found = RUNS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def word_grams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1) if marked[i : i + n] not in ("^", "$")]


def slots_of(gram: str) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(gram)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % (1 << 64) % SLOTS for i in range(PROBES)]


@dataclass
class Model:
    languages: list[str]  # bit i of a slot stands for the i-th
    slots: np.ndarray
    default: int  # the language with most sample texts

    def __post_init__(self) -> None:
        # chance that an n-gram which a language doesn't have finds all its probed bits set
        self.false = [float(np.mean(self.slots >> np.uint64(i) & np.uint64(1))) ** PROBES for i in range(len(self.languages))]

    def holders(self, gram: str) -> int:
        """Bits of the languages that have the n-gram (or seem to)."""
        a, *rest = (int(self.slots[s]) for s in slots_of(gram))
        for x in rest:
            a &= x
        return a


class Holders(dict):
    """For n-grams: 1, and 1 in the field of each language that has it; worked out when first asked for."""

    def __init__(self, model: Model, field: int) -> None:
        self.model, self.field = model, field

    def __missing__(self, gram: str) -> int:
        bits = self.model.holders(gram)
        value = 1 + sum(1 << self.field * (i + 1) for i in range(len(self.model.languages)) if bits >> i & 1)
        if len(self) < REMEMBERED:
            self[gram] = value
        return value


class Judge:
    """Predicts for texts; counts of words are remembered, each language's count in its own field of one integer."""

    FIELD = 40

    def __init__(self, model: Model) -> None:
        self.model, self.known, self.holders = model, {}, Holders(model, self.FIELD)

    def counts(self, word: str) -> int:
        return sum(map(self.holders.__getitem__, word_grams(word)))

    def __call__(self, text: str) -> tuple[str, float]:
        words = letter_runs(text.lower())
        if not words:
            return "und", 0.0
        known, extra = self.known, 0
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.counts(w)
        total = sum(map(known.__getitem__, words))
        for w in {w for w in words if len(w) > LONGEST}:
            del known[w]
        if not self.model.languages:
            return "und", 0.0
        mask = (1 << self.FIELD) - 1
        n = total & mask
        true = [max(0.0, ((total >> self.FIELD * (i + 1) & mask) - n * f) / (1 - f)) if f < 1 else 0.0 for i, f in enumerate(self.model.false)]
        best = max(range(len(true)), key=lambda i: (true[i], i == self.model.default, -i))
        return self.model.languages[best], true[best] / sum(true) if sum(true) else 1 / len(true)


def fit(shares: list[tuple[str, list[float]]], languages: list[str], default: int) -> Model:
    """shares: for each n-gram, the share of each language's sample texts that have it."""
    slots = np.zeros(SLOTS, np.uint64)
    for gram, share in shares:
        top = max(share)
        bits = sum(1 << i for i, s in enumerate(share) if s >= SHARE and s >= PART * top)
        if bits:
            slots[slots_of(gram)] |= np.uint64(bits)
    return Model(languages, slots, default)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most per_language rows of each language, those with the smallest hashes of their keys; rows with a null language or key, and chosen ones
    with a null text, are left out. More than LANGUAGES languages raise ValueError. N-gram statistics are gathered by the executors."""
    keyed = docs.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_text")).filter("_k is not null and _l is not null")
    counts = {r[0]: r[1] for r in keyed.groupBy("_l").count().limit(LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros(SLOTS, np.uint64), 0)
    # hashes below a bound that leaves several times per_language rows of each language, then the smallest of those: one scan whatever the languages, and no
    # task orders more than that
    bound = F.create_map(*(x for code, n in counts.items() for x in (F.lit(code), F.lit(int(min(1.0, DRAWN * per_language / n) * (1 << 62))))))
    drawn = keyed.select("_k", "_l").withColumn("_h", F.shiftrightunsigned(F.xxhash64("_k"), 2)).filter(F.col("_h") <= F.try_element_at(bound, F.col("_l")))
    first = drawn.withColumn("_rank", F.row_number().over(W.partitionBy("_l").orderBy("_h", "_k"))).filter(F.col("_rank") <= per_language)
    rows = keyed.filter("_text is not null").join(F.broadcast(first.select("_k", "_l")), ["_k", "_l"]).dropDuplicates(["_k", "_l"]).select("_l", "_text")

    def make():
        known: dict[str, list[str]] = {}

        def work(texts: list[str]) -> list[list]:
            out = []
            for t in texts:
                words = set(letter_runs(t.lower()))
                for w in words.difference(known):
                    known[w] = word_grams(w)
                out.append(list(set().union(*(known[w] for w in words))))
                if len(known) > REMEMBERED:
                    known.clear()
            return [out]

        return work

    grams = common.map_texts(rows, "_text", make, "_grams array<string>", [pa.list_(pa.string())])
    sizes = {r[0]: r[1] for r in grams.groupBy("_l").count().collect()}
    each = [F.sum((F.col("_l") == code).cast("long")).alias(f"n{i}") for i, code in enumerate(languages)]
    common_enough = " or ".join(f"n{i} >= {SHARE * sizes.get(code, 0)} and n{i} > 0" for i, code in enumerate(languages))
    # at most (n-grams of a text) / SHARE n-grams of a language are left
    found = grams.select("_l", F.explode("_grams").alias("g")).groupBy("g").agg(*each).filter(common_enough).collect()
    shares = [(r["g"], [r[f"n{i}"] / max(1, sizes.get(code, 0)) for i, code in enumerate(languages)]) for r in found]
    return fit(shares, languages, max(range(len(languages)), key=lambda i: (sizes.get(languages[i], 0), -i)))


def identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without its text, with lang_pred and score (the language's part of all corrected counts). `und` and 0 for texts that are null or have no
    letter. Equal counts: the commonest language of the sample, then the first by name. Repeated rows stay, other columns go through; ValueError if
    one is named like a result."""
    held = df.sparkSession.sparkContext.broadcast(model)  # SLOTS integers, whatever the input

    def make():
        judge = Judge(held.value)
        return lambda texts: [list(x) for x in zip(*map(judge, texts), strict=True)] if texts else [[], []]

    return common.map_texts(df, text, make, "lang_pred string, score double", [pa.string(), pa.float64()])


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(common.remainder("doc_id", 3) != 1))
    return identified(docs.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
