"""Quality classifier: n-gram indicators scaled by the classes' log-count ratios, a linear hinge-loss model fitted by dual coordinate descent, and a
logistic curve from margins to scores that is fitted on held-back parts of the sample."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Hashed features; words that a worker remembers; labelled rows of each class, at most, that the model is fitted on.
BUCKETS, REMEMBERED, PER_CLASS = 1 << 20, 300_000, 3000
RUNS = re.compile(r"(.)\1\1+")


def shape(word: str) -> str:
    """The word with its letters and digits replaced by their kind, runs shortened; other signs stay, in runs of three at most."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1\1\1", re.sub(r"([aA0])\1+", r"\1", kinds))


class Grams:
    """Indicators of a text: words, pairs of words, one to three shapes of words in a row, and how words repeat those before them."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}  # two hashes of 32 bits each: of the word, of its shape

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint32)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.lower().encode()) << 32 | zlib.crc32(b"\0" + shape(w).encode())
        pairs = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        word, kind = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        again = np.concatenate([[0], (word[1:] == word[:-1]).astype(np.uint64)]).astype(np.uint64)
        flags = again + np.uint64(2) * np.roll(again, 1) + np.uint64(4) * np.roll(again, 2)
        out = [word, kind, np.uint64(977) + flags]
        for seq, sizes in ((word, (2,)), (kind, (2, 3))):
            for n in sizes:
                mixed = np.zeros(max(0, len(seq) - n + 1), np.uint64)
                for i in range(n):
                    mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (seq[i : len(seq) - n + 1 + i] * np.uint64(0xC2B2AE3D27D4EB4F))
                out.append((mixed >> np.uint64(29)) + np.uint64(n))
        return np.unique((np.concatenate(out) % np.uint64(BUCKETS)).astype(np.uint32))


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each feature
    weight: np.ndarray  # of the scaled, normalised features
    bias: float
    slope: float
    offset: float

    def margin(self, grams: np.ndarray) -> float:
        r = self.ratio[grams]
        size = float(np.sqrt(r @ r))
        return self.bias + (float(self.weight[grams] @ r) / size if size else 0.0)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.offset, -40, 40))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, least: int = 3) -> np.ndarray:
    """Of smoothed counts in class 1 and class 0; features in fewer than `least` rows count nothing."""
    counts = [np.ones(BUCKETS), np.ones(BUCKETS)]
    for grams, y in zip(rows, labels, strict=True):
        counts[int(y)][grams] += 1
    ratio = np.log(counts[1] / (labels.sum() + 2)) - np.log(counts[0] / ((1 - labels).sum() + 2))
    ratio[counts[0] + counts[1] - 2 < least] = 0
    return ratio


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over scaled indicators of length 1; the two classes weigh the same."""
    w, bias = np.zeros(BUCKETS), 0.0
    x = []
    for grams in rows:
        r = ratio[grams]
        used = grams[r != 0]
        r = r[r != 0]
        size = np.sqrt(r @ r)
        x.append((used, r / size if size else r))
    sign, alpha = 2.0 * labels - 1, np.zeros(len(rows))
    ceiling = np.where(labels == 1, cost * len(rows) / (2 * max(1, labels.sum())), cost * len(rows) / (2 * max(1, (1 - labels).sum())))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            used, r = x[i]
            gradient = sign[i] * (float(w[used] @ r) + bias) - 1
            new = min(max(alpha[i] - gradient / (1 + bool(len(r))), 0.0), ceiling[i])
            if step := new - alpha[i]:
                w[used] += step * sign[i] * r
                bias += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the labels best; targets are drawn in a little, so that separable labels give finite values."""
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-6 * theta)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """With no rows, or rows of one class only, every score is that class's smoothed share."""
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_ratios(rows, labels)
    weight, bias = dual_descent(rows, ratio, labels)
    margins = np.zeros(len(rows))
    for k in range(folds):
        out = np.arange(len(rows)) % folds == k
        kept = [x for x, o in zip(rows, out, strict=True) if not o]
        if len(set(labels[~out].tolist())) < 2:
            part = Model(ratio, weight, bias, 1, 0)
        else:
            r = log_ratios(kept, labels[~out])
            part = Model(r, *dual_descent(kept, r, labels[~out]), 1, 0)
        for i in np.flatnonzero(out):
            margins[i] = part.margin(rows[i])
    return Model(ratio.astype(np.float32), weight.astype(np.float32), bias, *logistic(margins, labels))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on at most per_class labelled rows of each class, those with the smallest hashes of their keys.

    labels: key and label (0 or 1); other values, null keys and keys with both labels are left out. Of rows with one key, one is used.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).filter("_y = _z")
    chosen = [clean.filter(F.col("_y") == y).select(key, "_y").orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), key).dropDuplicates([key])

    def make():
        grams = Grams()
        return lambda texts: [[grams(t).tobytes() for t in texts]]

    found = common.map_texts(rows.select(key, "_y", "_text"), "_text", make, "_grams binary", [pa.binary()]).select(key, "_y", "_grams").collect()
    found.sort(key=lambda r: r[0])
    return fit([np.frombuffer(r["_grams"], np.uint32) for r in found], np.array([r["_y"] for r in found], float))


def scored(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, keep_text: bool = False) -> DataFrame:
    """df without its text (unless keep_text), with score (0 to 1) and predicted (1 from the threshold on). Null and empty texts get the score that belongs to no
    evidence. Repeated rows stay, other columns go through; ValueError if one is named like a result."""
    held = df.sparkSession.sparkContext.broadcast(model)  # two floats for each of BUCKETS features, whatever the input

    def make():
        grams, m = Grams(), held.value

        def work(texts: list[str]) -> list[list]:
            scores = [m.score(grams(t)) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return common.map_texts(df, text, make, "score double, predicted int", [pa.float64(), pa.int32()], keep_text)


def accepted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df that the model doesn't reject, all columns. Columns named score or predicted are set aside meanwhile."""
    own = df.select([F.col(c).alias(f"_own{i}") for i, c in enumerate(df.columns)])
    kept = scored(own, model, f"_own{df.columns.index(text)}", keep_text=True).filter("predicted = 1")
    return kept.select([F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(common.remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", "predicted")
