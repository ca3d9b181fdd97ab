import hashlib
import random

import pytest
import sentencepiece
import tokenizers
from public_tokenizers import path

from spanloom.llm import bpe, token_count

RNG = random.Random(1)
LETTERS = list("aeT \n\t\r,.-'0²éß漢☃") + ["́", "\x85", "\x1c", "　", "<|endoftext|>", "'s", "'ll", "😀", "\U00010940", "▁", "  ", "the", "ing"]
TEXTS = ["", " ", "  a", "a" * 4000, "\n" * 300 + "x", "<|endoftext|>" * 3, "x" * 70 + " " + "x" * 70, *("".join(RNG.choice(LETTERS) for _ in range(RNG.randint(0, 60))) for _ in range(3000))]
ROWS = "doc_id long, text string, extra int"


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(path("byte_bpe_50k.json"))


def test_ids_and_texts_are_the_library_s(own):
    lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = [x.ids for x in lib.encode_batch(TEXTS, add_special_tokens=False)]
    assert [own.encode(t) for t in TEXTS] == want
    assert [own.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]
    assert own.decode([want[8][0]]) == lib.decode([want[8][0]]) if want[8] else True


def test_broken_bytes_decode_as_the_library_s(own):
    lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    for _ in range(300):
        ids = [RNG.randrange(50257) for _ in range(RNG.randint(0, 12))]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_cache_limits_change_nothing(own, monkeypatch):
    want = [own.encode(t) for t in TEXTS[:200]]
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    assert [own.encode(t) for t in TEXTS[:200]] == want


def test_encode_decode_frames(spark):
    rows = [(1, "hello world", 7), (1, "hello world", 7), (2, None, 8), (None, "", 9)]
    ids = bpe.encode(spark.createDataFrame(rows, ROWS), path("byte_bpe_50k.json"))
    assert sorted((r.doc_id or 0, r.n_tokens, r.extra) for r in ids.collect()) == [(0, 0, 9), (1, 2, 7), (1, 2, 7), (2, 0, 8)]
    back = bpe.decode(ids.select("doc_id", "token_ids"), path("byte_bpe_50k.json"))
    assert sorted(r.text for r in back.collect()) == ["", "", "hello world", "hello world"]
    assert bpe.encode(spark.createDataFrame([], ROWS), path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), path("byte_bpe_50k.json"))


def test_op1(spark, sf_dir):
    lib = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op1_bpe(spark, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_are_the_library_s(monkeypatch):
    for name, texts in (("piece_bpe_32k.model", [*TEXTS, *("".join(RNG.choice("a  ▁\nb<s>") for _ in range(RNG.randint(0, 30))) for _ in range(3000))]), ("word_bpe_49k.json", TEXTS)):
        count = token_count.counter(path(name))
        lib = sentencepiece.SentencePieceProcessor(model_file=path(name)) if name.endswith("model") else tokenizers.Tokenizer.from_file(path(name))
        want = [len(x) for x in lib.encode(texts)] if name.endswith("model") else [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
        assert count(texts) == want
        monkeypatch.setattr(token_count, "REMEMBERED", 3)
        monkeypatch.setattr(token_count, "BATCH_BYTES", 10)
        assert count(texts) == want


def test_count_frames(spark, sf_dir):
    out = token_count.token_counts(spark.createDataFrame([(1, None, 2), (2, "é" * 10, 3), (2, "é" * 10, 3), (None, "a " * 5000, 4)], ROWS), path("piece_bpe_32k.model"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens > 0, r.over_limit, r.extra) for r in out.collect())
    assert got == [(0, 10000, True, True, 4), (1, 0, False, False, 2), (2, 20, True, False, 3), (2, 20, True, False, 3)]
    assert token_count.op3_token_counts(spark, sf_dir).count() == 200
