"""Token counts: batches of about equal bytes, long texts cut where no token can cross, only lengths returned."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Segments whose counts a worker remembers, and the longest one that is remembered.
REMEMBERED, LONGEST = 400_000, 40
#: Bytes that the encoder gets at once.
BATCH_BYTES = 1 << 20
SPACE = "▁"


def counter(path: str):
    """A function from a list of texts to their token counts, for a vocabulary file of tokenizers (.json) or sentencepiece (.model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        return lambda texts: [len(x.ids) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    whole = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
    return SegmentCounter(whole) if cuts_at_spaces(model) else whole


def cuts_at_spaces(model) -> bool:
    """Whether a single space between other characters is a safe boundary: no piece holds a space after another character, the text is not
    normalised, and the space that is taken away comes back as the prefix of the next segment."""
    spec = model.normalizer_spec
    plain = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    return plain and model.trainer_spec.model_type == 2 and not any(SPACE in p.piece.lstrip(SPACE) or " " in p.piece for p in model.pieces)


class SegmentCounter:
    """Counts by segments between safe boundaries; each distinct segment of a batch is encoded once."""

    def __init__(self, whole) -> None:
        self.whole, self.known = whole, {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.segments(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set().union(*split)
        batch, size = [], 0
        for x in new:
            batch.append(x)
            size += 4 * len(x)
            if size >= BATCH_BYTES:
                self.learn(batch)
                batch, size = [], 0
        self.learn(batch)
        counts = [sum(map(self.known.__getitem__, s)) for s in split]
        if any(len(x) > LONGEST for x in new):
            for x in [x for x in new if len(x) > LONGEST]:
                del self.known[x]
        return counts

    def learn(self, batch: list[str]) -> None:
        if batch:
            self.known.update(zip(batch, self.whole(batch), strict=True))

    @staticmethod
    def segments(text: str) -> list[str]:
        """Pieces of the text whose counts add up. A space next to another space (or to the character that stands for one) is no boundary."""
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts and SPACE not in text:
            return parts
        out, held = [], parts[0]
        for part in parts[1:]:
            if held and part and held[-1] not in (" ", SPACE) and part[0] not in (" ", SPACE):
                out.append(held)
                held = part
            else:
                held = f"{held} {part}"
        return [*out, held]


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """df without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay, each with its own count; an empty table gives an empty result. Other columns
    go through; if one of them is named like a result, ValueError.
    """

    def make():
        count = counter(path)

        def work(texts: list[str]) -> list[list]:
            tokens = count(texts)
            return [[len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return work

    return common.map_texts(df, text, make, "n_bytes long, n_tokens long, over_limit boolean", [pa.int64(), pa.int64(), pa.bool_()])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_counts(common.table(spark, sf_dir, "documents").select("doc_id", F.col("text")), path("piece_bpe_32k.model"))
