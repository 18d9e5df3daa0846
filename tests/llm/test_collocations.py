"""Collocations against plain counting, with few shards and many, and with a table so small that all slots are shared."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import collocations
from framelake.runtime import Scratch

SCHEMA = "doc_id long, lang string, text string, phrase string, n int, w1 int, shard int, `len` int"


def expected(rows, support, cover, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = {}
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        dropped = {q for p, a in cand.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) for q in [p[i : i + s]] if 100 * a >= cover * counts[q]}
        best = []
        for p, a in cand.items():
            if p not in dropped:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out[lang, rank] = (p.decode(), -a, l, r, n[lang], -score)
    return out


def texts():
    rng, rows = random.Random(3), []
    words = ["Ab", "cd", "ef", "gh", "É", "ij\x1c", "klm", "n'o"]
    for i in range(900):
        w = [rng.choice(words) if rng.random() < 0.9 else f"x{rng.randrange(400)}" for _ in range(rng.randrange(0, 30))]
        if i % 3 == 0:
            w[2:2] = ["strictly", "fixed", "phrase", "here"]
        if i > 700:
            w += ["late", "comer", "late", "late", "comer"]
        rows.append((rng.choice(["en", "en", "de", None, ""]), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for x in w)))
    rows += [("en", None), ("en", ""), ("fr", "a a a a a " * 60), ("en", "same words Again. " * 3)] + [("en", "same words again")] * 40
    return rows


@pytest.mark.parametrize("shards,slots,chunk", [(1, 1 << 16, 500), (3, 2, 1 << 20)])
def test_collocations(spark, monkeypatch, shards, slots, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = texts()
    df = spark.createDataFrame([(i, lang, t, "x", 1, 2, 3, 4) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    with Scratch(spark) as scratch:
        got = collocations.collocations(df, scratch, support=20, top=50, shards=shards, slots=slots).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == expected(rows, 20, 80, 50)
    assert len(got) == len({(r.lang, r["rank"]) for r in got}) > 50


def test_no_texts(spark):
    df = spark.createDataFrame([(1, "en", None, "x", 1, 2, 3, 4)], SCHEMA)
    for rows in (df, df.limit(0)):
        with Scratch(spark) as scratch:
            assert collocations.collocations(rows, scratch).collect() == []


def test_rows_of_a_chunk():
    chunk = collocations.Chunk()
    chunk.take("en", b"A b. , a\tB c;;")
    chunk.take("de", b"a")
    first, words = chunk.rows(1, 0)
    ids = np.frombuffer(first["ids"][0], np.int32).tolist()
    assert ids == [0, 1, -1, 0, 1, 2, -1, 3, -1]
    assert list(zip(words["lang"], words["word"], words["n"])) == [("en", "a", 2), ("en", "b", 2), ("en", "c", 1), ("de", "a", 1)]
    assert len(set(words["w1"])) == 4


def test_rare_pairs_of_frequent_words_are_not_listed(spark):
    rng, made = random.Random(7), []
    rows = [("en", " ".join([*(f"w{rng.randrange(200)}" for _ in range(40)), "two words"])) for _ in range(600)]

    class Counting(Scratch):
        def staged(self, df, slot=None, **options):
            out = super().staged(df, slot, **options)
            made.extend([out.count()] if slot == "state" else [])
            return out

    with Counting(spark) as scratch:
        got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(3), scratch, support=20).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == expected(rows, 20, 80, 2000) and got
    assert made and max(made) < 600  # of 18,000 different pairs


def test_hashes_of_spark_are_those_of_chunks(spark):
    chunk = collocations.Chunk()
    for lang, word in (("", "a"), ("und", "\u00c9\u65e5" * 40), ("de", "x\x1cy")):
        chunk.take(lang, word.encode())
    _, words = chunk.rows(0, 3)
    got = spark.createDataFrame(list(zip(words["lang"], words["word"])), "lang string, word string").select(collocations.hash_of(F.col("lang"), F.col("word"), 3).alias("h")).collect()
    assert [r.h for r in got] == words["w1"].tolist()
