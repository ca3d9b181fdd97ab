"""BPE encoding by dynamic programming over prefixes, and decoding.

The tokens of a piece are fixed by one fact for each of its prefixes: the last token of the prefix's own encoding. A token that ends the prefix is
that last token if it and the last token of what stands before it could stand side by side, that is, no merge would have joined them across their
border. Exactly one token passes. The tokens that end a prefix come from an automaton with suffix links over the vocabulary.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Pieces that a worker remembers in each of two generations, the longest one that is remembered, and remembered pairs of tokens.
REMEMBERED, LONGEST, PAIRS = 150_000, 48, 500_000
#: Texts with characters from here on are cut into pieces by the library itself: what counts as a letter there depends on its Unicode version.
NEWER = 0x558


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


def piece_pattern() -> re.Pattern:
    """Contractions, letters, digits, other signs (each with a space before) and white space, for characters below NEWER."""

    def ranges(kind) -> str:
        return "".join(f"\\u{c:04x}" for c in range(NEWER) if kind(chr(c)))

    letters, digits = (ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    blank = ranges(lambda c: c in "\t\n\v\f\r\x85" or unicodedata.category(c)[0] == "Z")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{blank}{letters}{digits}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


class Pieces(dict):
    """The ids of pieces, worked out when first asked for; long pieces aren't kept."""

    def __init__(self, encode) -> None:
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.encode(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def age(self) -> None:
        """Forgets the pieces that weren't asked for since the last time."""
        self.older = dict(self)
        self.clear()


class ByteBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = byte_letters()
        back = {c: b for b, c in enumerate(self.letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            self.merged.setdefault((vocab[a], vocab[b]), rank)
            if token not in self.rank:
                self.rank[token], self.halves[token] = rank, (vocab[a], vocab[b])
        self.ends = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(t) == 1 or i in self.rank:
                self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of.update({i: t.encode() for t, i in self.special.items()})
        bare = {"added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None, "model": {**spec["model"], "vocab": {}, "merges": []}}
        self.cut = Tokenizer.from_str(json.dumps(spec | bare)).pre_tokenizer.pre_tokenize_str  # without a second copy of the vocabulary
        self.pieces, self.new = piece_pattern().findall, re.compile(f"[^\0-{chr(NEWER - 1)}]").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.table = {b: self.letters[b] for b in range(256)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = Pieces(self.encode_piece)
        self.texts = {i: str(i) for i in self.bytes_of}

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay apart. Goes back in time: undoes the latest merge at the border until a pair could have merged
        while both parts were there, or both are single bytes. Of equal merges the left one comes first."""
        until_a = until_b = len(self.merged) + 1
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                until_a, a = rank_a, self.halves[a][1]
            else:
                until_b, b = rank_b, self.halves[b][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        shown = piece.encode().decode("latin-1").translate(self.table)
        last: list[tuple[int, int]] = [(-1, 0)] * (len(shown) + 1)
        done, pairs = 0, self.pairs
        if len(pairs) > PAIRS:
            pairs.clear()
        for end, (token, size) in self.ends.iter(shown):
            if end < done:
                continue  # the last token of this prefix is known
            at = end + 1 - size
            if at:
                pair = (last[at][0], token)
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.compatible(*pair)
                if not fits:
                    continue
            last[end + 1] = (token, at)
            done = end + 1
        out, at = [], len(shown)
        while at:
            token, at = last[at]
            out.append(token)
        return tuple(reversed(out))

    def split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.cut(text)] if self.new(text) else self.pieces(text)

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for i, part in enumerate(self.specials(text) if self.specials else [text]):
            out += [(self.special[part],)] if i % 2 else map(known.__getitem__, self.split(part))
        if len(known) > REMEMBERED:
            known.age()
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        """Special tokens are written out; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without its text, with token_ids (array of int), n_tokens and decoded_sha256 (of the text that the ids decode to). Null and empty texts give no
    tokens. Repeated rows stay; other columns go through, and ValueError if one is named like a result."""

    def make():
        gc.disable()  # the remembered pieces hold no cycles
        bpe = ByteBpe(path)

        def work(texts: list[str]) -> list[list]:
            ids = [bpe.encode(t) for t in texts]
            return [ids, [len(i) for i in ids], [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids]]

        return work

    return common.map_texts(df, text, make, "token_ids array<int>, n_tokens long, decoded_sha256 string", [pa.list_(pa.int32()), pa.int64(), pa.string()])


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df without its token ids, with text. Null ids give the empty text; ids outside the vocabulary raise KeyError."""
    keep = [c for c in df.columns if c != ids]
    if "text" in keep:
        raise ValueError("column names taken: text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids] + ["text string"])

    def run(batches):
        bpe = ByteBpe(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x or []) for x in batch.column(batch.schema.names.index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), texts], names=[*keep, "text"])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens and digests of the ids and of the text decoded from them: encode and decode in one pass, so that ids need
    not leave the worker. Nulls, repeats and other columns as in encode()."""

    def make():
        gc.disable()  # the remembered pieces hold no cycles
        bpe = ByteBpe(path)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], []]
            for t in texts:
                ids = bpe.encode(t)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return work

    return common.map_texts(df, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path("byte_bpe_50k.json"))
