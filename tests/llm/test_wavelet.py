"""Wavelet shards against the plain ids of the tokenizers library."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from framelake.llm import wavelet
from framelake.runtime import Scratch

BPE, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "most"), [(0, 1), (1, 1), (5, 2), (3000, 7), (140_000, 49_408), (70_000, 1 << 31)])
def test_rank_select_access(n, most):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, most, n) if n < 100_000 else np.minimum(rng.zipf(1.3, n), most - 1)).astype(np.uint32)
    shard = wavelet.Shard(wavelet.build(ids, ["a", None], [n, 0], 3) + b"\n")
    assert shard.documents()[0] == ["a", None] and shard.number == 3 and (shard.tokens() == ids).all()
    for at in rng.integers(0, n, 25 if n else 0).tolist():
        assert shard.token(at) == ids[at]
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        token = int(ids[at])
        assert shard.count(token, lo, hi) == (ids[lo:hi] == token).sum()
        assert (shard.places(token, lo, hi) == lo + np.flatnonzero(ids[lo:hi] == token)).all()
    assert shard.count(1 << 40) == 0 and len(shard.places(1 << 40)) == 0


def test_broken_files():
    data = wavelet.build(np.arange(5000, dtype=np.uint32), ["a"], [5000], 0)
    for bad in (b"x" + data[1:], data[:-10]):
        with pytest.raises(ValueError):
            wavelet.Shard(bad)


@pytest.mark.parametrize("path", [BPE, BYTES])
def test_ids_are_those_of_the_library(odd_texts, path):
    rng = np.random.default_rng(1)
    signs = list("abcdehilnorst'slrvmd 1!é\n\t\r<|Σİßǆÿ\x1c\x85\xa0\u2003") + ["<|endoftext|>", "\u0301", "\u1ac0", "'ll", "don't "]
    texts = [t or "" for t in odd_texts] + ["".join(rng.choice(signs, rng.integers(0, 60))) for _ in range(2500)]
    texts += ["".join(chr(c) for c in np.where(rng.random(50) < 0.6, rng.integers(32, 127, 50), rng.integers(32, 0x3000, 50))) for _ in range(2500)]
    encoder, tokenizer = wavelet.WordIds(path, memo=500), Tokenizer.from_file(path)
    assert encoder.apart == (path == BPE)
    texts += ["A <|ENDOFTEXT|> b", "Ab, ab, AB. H\u0331 h\u0331 A\u0301b", "ÀB,ÿ× ÷a à" * 30, "x" * 90 + " " + "x" * 90 + "!"]
    for t, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_words_met_again_are_not_learnt_again():
    class Learning(wavelet.WordIds):
        def learn(self, words):
            learnt.extend(words)
            super().learn(words)

    learnt, tokenizer = [], Tokenizer.from_file(BPE)
    encoder = Learning(BPE, memo=20)
    for i in range(12):
        text = " ".join(["the same words  come again", *(f"new{chr(97 + i)}{chr(97 + j)}" for j in range(6))])
        (ids,) = encoder([text])
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert learnt.count(b"again") == 1 and len(learnt) == 5 + 12 * 6
    assert len(encoder.words) <= 20 + 11 and len(encoder.older) <= 20 + 11


def test_documents_of_shards(spark, docs, odd_texts, tmp_path):
    extra = docs.limit(0).sparkSession.createDataFrame([(4, "a tie", None), (4, "a tie", None), (None, "no key", "s"), (10**17 + 1, "far", "s")], "doc_id long, text string, source string")
    table = docs.select("doc_id", "text", "source").unionByName(extra)
    path = wavelet.write_shards(table, BPE, f"{tmp_path}/shards", shard_tokens=3000)
    tokenizer = Tokenizer.from_file(BPE)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(odd_texts)}
    with Scratch(spark) as scratch:
        rows = wavelet.read_documents(spark, path, scratch).orderBy("start").collect()
    assert [r.key for r in rows] == [None, 0, 1, 2, 3, 4, 4, 4, *range(5, len(odd_texts)), 10**17 + 1]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.key in ids and r.key != 4:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.key]), zlib.crc32(np.array(ids[r.key], "<u4").tobytes()))
    ties = [r.ids_crc32 for r in rows if r.key == 4]
    assert ties[0] == ties[1] != ties[2] or ties[1] == ties[2] != ties[0]
    whole = [x for v in ids.values() for x in v]
    token = max(set(whole), key=whole.count)
    shards = wavelet.count_tokens(spark, path, [token, 49_999]).collect()
    assert len(shards) > 12 and {r.n for r in shards if r.token == 49_999} == {0}
    got = {(r.key, r.at) for r in wavelet.occurrences(spark, path, token).collect() if r.key not in (None, "4", str(10**17 + 1))}
    assert got == {(str(i), k) for i, v in ids.items() if i != 4 for k, x in enumerate(v) if x == token}


def test_no_documents(spark, docs, tmp_path):
    path = wavelet.write_shards(docs.limit(0), BPE, f"{tmp_path}/none")
    with Scratch(spark) as scratch:
        assert wavelet.read_documents(spark, path, scratch).count() == 0
