"""Results of the text operators against plain Python on odd rows, and on empty tables."""

import base64
import gzip
import hashlib
import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from framelake.llm import mixing, near_dedup, packing, quality_rules, sharding, token_counts, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, odd_texts):
    tokenizer = Tokenizer.from_file(BPE)
    out = {r.doc_id: r for r in token_counts.count_tokens(docs, BPE, limit=100).collect()}
    for i, t in enumerate(odd_texts):
        want = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (out[i].n_tokens, out[i].n_bytes, out[i].over_limit) == (want, len((t or "").encode()), want > 100)


def test_token_counts_of_random_characters():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab'sterlvmd 1!é\n<|Σ"), rng.integers(0, 1600))) for _ in range(150)]
    tokenizer, machine = Tokenizer.from_file(BPE), token_counts.CountingTransducer(BPE)
    signs = list("abcdehilnorst'slrvmd 1!é\n<|Σİßǆÿ") + ["<|endoftext|>", "́", "\u1ac0", "'l\u1ac0\u0301"]
    texts += ["".join(rng.choice(signs, rng.integers(0, 80))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in np.where(rng.random(60) < 0.5, rng.integers(97, 123, 60), rng.integers(32, 0x3000, 60))) for _ in range(3000)]
    vocabulary = [t.removesuffix("</w>") for t in machine.machine.vocabulary if t.isascii()]
    texts += [" ".join(rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(8000))]
    assert machine.counts(texts).tolist() == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, odd_texts):
    rows = packing.pack(docs, BYTES, block_tokens=20_000).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(odd_texts)}
    found = {i: {} for i in whole}
    filled = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == whole[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(whole[r.doc_id])
        found[r.doc_id][r.start] = r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in found.items():
        assert sum(pieces.values()) == len(whole[i])
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_of_very_long_blanks(spark):
    from tokenizers import Tokenizer

    texts = ["a b", "x" + " " * 2_000_000 + "y", "\n" * 1_100_000]
    slow = Tokenizer.from_file(BYTES)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES).orderBy("doc_id", "start").collect()
    for i, t in enumerate(texts):
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows if r.doc_id == i])
        assert np.array_equal(got, [*slow.encode(t, add_special_tokens=False).ids, 0])


def test_tightest_window():
    rng = np.random.default_rng(1)
    tree, rooms = packing.RoomTree(100), []
    for step in range(3000):
        if rng.random() < 0.6:
            room = int(rng.integers(1, 101))
            tree.put(room, step)
            rooms.append((room, step))
        else:
            need = int(rng.integers(1, 101))
            fit = [r for r, _ in rooms if r >= need]
            got = tree.take(need)
            assert (got is None) == (not fit)
            if got:
                assert got[0] == min(fit) and got in rooms
                rooms.remove(got)


def measures(text):
    words = WORD.findall(text or "")
    triples, marked, seen, repeats = Counter(zip(words, words[1:], words[2:])), set(), set(), 0
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeats, len(marked)


def test_quality_measures(docs, odd_texts):
    out = {r.doc_id: r for r in quality_rules.judge(docs, keep=["doc_id"]).collect()}
    for i, t in enumerate(odd_texts):
        m = measures(t)
        assert tuple(out[i].q[k] for k in quality_rules.MEASURES) == m
        assert out[i].q.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])


def test_hosts_are_shrunk(spark):
    rows = [("good", i % 10 == 0) for i in range(500)] + [("bad", i % 10 != 0) for i in range(500)] + [("one", True)] + [(None, False)] * 300
    rates = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean"), "host", ["failed"]).collect()}
    assert rates["bad"].host_failed and not rates["good"].host_failed and not rates[None].host_failed
    assert 0.1 < rates["one"].rate_failed < 1 and abs(rates["bad"].rate_failed - 0.9) < 0.02


def test_mixing(docs, odd_texts):
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(odd_texts)))
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(odd_texts)}
    source = {i: ["src0", "src1", None][i % 3] for i in size}
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    weights, total = {"src0": 5, "src1": 2, None: 1}, sum(totals.values())
    want, active, left = {}, set(weights), total
    while active:
        share = {s: left * weights[s] / sum(weights[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 3 * totals[s]}
        for s in over or active:
            want[s] = min(share[s], 3 * totals[s])
        left -= sum(want[s] for s in over)
        active = active - over if over else set()
    taken = Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(size.values())
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}


def test_tilt_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(x), int(n)) for s in ("a", "b", "c") for x, n in zip(range(1, 400), rng.integers(1, 30, 400), strict=False)]
    histogram = spark.createDataFrame(rows, "source string, size long, n long")
    sizes = Counter()
    for s, x, n in rows:
        sizes[s] += x * n
    wanted = spark.createDataFrame([(s, sizes[s], sizes[s] * f) for s, f in (("a", 0.3), ("b", 1.7), ("c", 3.0))], "source string, source_size long, target double")
    for r in mixing.solve(histogram, wanted).collect():
        rate = [3.0 if r.source == "c" else min(3.0, np.exp(r.tilt * x / r.scale)) for s, x, n in rows if s == r.source]
        have = sum(v * x * n for v, (s, x, n) in zip(rate, [t for t in rows if t[0] == r.source], strict=True))
        assert have == pytest.approx(r.target, rel=1e-3)


def test_sharding(docs):
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    docs = docs.withColumnsRenamed({"n_tokens": "cut", "kept": "cuts", "q": "rank"})
    rows = sharding.shard(docs.drop("component"), [sharding.range_quantised(F.col("source"), sharding.name_bounds(docs, "source")), sharding.log_quantised(size)], "doc_id", shards=7).select("doc_id", "shard", "slot", "curve").collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(rows) == docs.count() and len(by) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_names_are_cut_into_ranges(spark):
    df = spark.createDataFrame([(n,) for n in ("b", "é", "a", None, "b", "z", "😀", "")], "name string")
    bounds = sharding.name_bounds(df, "name")
    got = {r.name: r.at for r in df.select("name", sharding.range_quantised(F.col("name"), bounds).alias("at")).collect()}
    assert got == {None: 0, "": 0, "a": 1, "b": 2, "z": 3, "é": 4, "😀": 5}
    many = spark.range(1000).select(F.format_string("n%04d", "id").alias("name"))
    ranges = many.groupBy(sharding.range_quantised(F.col("name"), sharding.name_bounds(many, "name")).alias("at")).agg(F.count("*").alias("n"), F.min("name"), F.max("name")).orderBy("at").collect()
    assert len(ranges) == 16 and max(r.n for r in ranges) < 150
    assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sharding.name_bounds(df.where("name is null"), "name") == []


def test_written_shards_prune_in_every_dimension(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.format_string("host%02d", F.pmod(F.xxhash64("id"), F.lit(64))).alias("source"), F.pow(2.0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(15))).cast("long").alias("size"))
    axes = [sharding.range_quantised(F.col("source"), sharding.name_bounds(df, "source")), sharding.log_quantised(F.col("size"))]
    path, stats = sharding.write_shards(sharding.shard(df, axes, "doc_id"))
    stats = stats.collect()
    assert spark.read.parquet(path).count() == 8000 == sum(r.rows for r in stats)
    for source in ("host00", "host31", "host63"):
        assert sum(r.min_source <= source <= r.max_source for r in stats) <= 14
    for size in (1, 256, 16384):
        assert sum(r.min_size <= size <= r.max_size for r in stats) <= 14


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3)])
def test_curve_is_a_path(spark, dimensions, bits):
    """Every cell has a place of its own, and neighbours on the curve are neighbours in space."""
    df = spark.range(1 << dimensions * bits)
    axes = [F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(dimensions)]
    rows = df.select(sharding.hilbert_index(axes, bits).alias("h"), *[a.alias(f"x{k}") for k, a in enumerate(axes)]).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << dimensions * bits))
    for a, b in zip(rows, rows[1:], strict=False):
        assert sum(abs(a[k + 1] - b[k + 1]) for k in range(dimensions)) == 1


def test_counting_machine_looks_at_the_file(tmp_path):
    """A file that normalises, splits or finds added tokens otherwise is an error; special tokens of any names are counted."""
    told = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    path = str(tmp_path / "t.json")

    def counts(change, texts):
        other = json.loads(json.dumps(told))
        change(other)
        (tmp_path / "t.json").write_text(json.dumps(other), encoding="utf-8")
        library = Tokenizer.from_file(path)
        return token_counts.CountingTransducer(path).counts(texts).tolist(), [len(library.encode(t, add_special_tokens=False).ids) for t in texts]

    def renamed(t):
        for token, name in zip(t["added_tokens"], ("[BEGIN]", "~end~"), strict=True):
            token["content"] = name
        t["post_processor"] = None

    got, want = counts(renamed, ["a [BEGIN] b~end~c", "plain words", "<|endoftext|>"])
    assert got == want
    for change in (
        lambda t: t.update(normalizer=None),
        lambda t: t["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated", invert=False),
        lambda t: t["pre_tokenizer"]["pretokenizers"].pop(),
        lambda t: t["added_tokens"][0].update(lstrip=True),
    ):
        with pytest.raises(ValueError):
            counts(change, ["a"])
    with pytest.raises(ValueError):
        token_counts.CountingTransducer(public_tokenizers.path("byte_bpe_50k.json"))


def test_warc(spark):
    html = ["<p>a</p>", None, "", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "<p>a</p>", "é" * 70_000, "<p>a</p>", "y\r\n"]
    rows = [(i + 10, f"http://h/{i}\r\nX: 1" if i else None, h, i) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key long")
    path = warc.write_archive(pages)
    raw = [(h or "").encode() for h in html]
    first = {h: i for i, h in reversed(list(enumerate(raw)))}
    got = {int(r.key): r for r in warc.read_records(spark, path).collect()}
    records = {int(r.key): bytes(r.record) for r in warc.read_archive(spark, path).collect()}
    assert sorted(got) == sorted(records) == [r[0] for r in rows]
    for i, h in enumerate(raw):
        r = got[i + 10]
        assert (r.payload_bytes, r.payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == i else ("revisit", str(first[h] + 10)))
        fields, _, content = next(warc.parse_records([records[i + 10] + b"\r\n\r\n"]))
        assert content == (h if first[h] == i else b"") and fields["warc-payload-digest"] == f"sha1:{r.payload_digest}"
    assert warc.read_payloads(spark, path).count() == len(set(raw))
    # repeated rows, rows that share a key only and rows without a key have records of their own
    more = [rows[0], (10, "http://g", "<p>a</p>", 0), (None, "http://n", "<p>a</p>", 0), (None, None, "only here", 0), (None, None, "only here", 0)]
    path = warc.write_archive(spark.createDataFrame(rows + more, pages.schema))
    again = warc.read_records(spark, path).collect()
    assert len(again) == len(rows) + len(more) and warc.read_archive(spark, path).count() == len(again)
    assert sum(r.record_type == "response" for r in again) == len(set(raw)) + 1 == warc.read_payloads(spark, path).count()
    assert sorted(str(r.refers_to) for r in again if r.key is None) == ["10", "None", "None"]


def test_warc_files_and_hot_payloads(spark):
    """Files end by bytes whatever the pages' lengths; a payload of many copies is joined apart, with the same records."""
    rows = [(i, f"http://h/{i}", "x" * 5_000 + str(i) if i % 5 == 0 else "" if i % 2 else "same") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc.write_archive(pages, file_bytes=20_000, hot_rows=30)
    files = spark.read.format("binaryFile").load(f"{path}/payloads").select("content").collect()
    sizes = [len(gzip.decompress(bytes(f.content))) for f in files if len(f.content)]
    assert max(sizes) < 20_000 + 6_000 and len(sizes) >= 200 // 5 * 5_000 // 26_000
    plain = warc.write_archive(pages)
    key = lambda r: int(r.key)
    assert sorted(warc.read_records(spark, path).collect(), key=key) == sorted(warc.read_records(spark, plain).collect(), key=key)
    got = {int(r.key): r for r in warc.read_records(spark, path).collect()}
    assert len(got) == 200 and sum(r.record_type == "response" for r in got.values()) == 42 and got[3].refers_to == "1" and got[4].refers_to == "2"


def links_of(texts, shingle):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sets, [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, odd_texts, shingle):
    import random

    rng, texts = random.Random(9), list(odd_texts)
    base = texts[40:50]
    for t in base:  # chains of copies, each a little farther from the first
        words = t.split()
        for _ in range(6):
            words = [w if rng.random() > 0.015 else w + "x" for w in words]
            texts.append(" ".join(words))
    crowd = texts[20].split() + texts[21].split()  # more copies of one text than a prefix may have undivided
    texts += [" ".join(w if rng.random() > 0.03 else "zz" + str(rng.randrange(99)) for w in crowd) for _ in range(60)]
    sets, components = links_of(texts, shingle)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("component_id", F.lit(1)).repartition(4)
    out = {r.doc_id: r for r in near_dedup.near_duplicates(df, shingle=shingle).collect()}
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(texts))] == components
    assert [out[i].kept for i in range(len(texts))] == [c == i for i, c in enumerate(components)]
    kept = near_dedup.drop_near_duplicates(df, shingle=shingle).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, c in enumerate(components) if c == i]


def test_toxic_words_are_learned(spark):
    import random

    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 7 == 0
        if bad:
            words[rng.randrange(len(words))] = f"vile{rng.randrange(1000)}"
            words.insert(0, "scum")
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("old"))
    chain = toxicity.train(docs, spark.createDataFrame(labels + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"), toxicity.label_columns())
    out = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert all(out[i].toxic == (i % 7 == 0) for i in range(400, 600))
    assert not out[1000].toxic and not out[1001].toxic
    blank = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.label_columns())
    assert {round(r.toxicity.p_toxic, 3) for r in toxicity.score(docs, blank).collect()} == {0.5}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BPE).count() == 0
    assert packing.pack(none, BYTES).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert sharding.shard(none, [F.lit(0), F.lit(0)], "doc_id").count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(spark, warc.write_archive(pages)).count() == 0


def test_digests_without_python(spark):
    texts = ["", "a", "é", "x" * 999]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.sha1_base32(F.col("t"))).collect()]
    assert got == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]


def test_padding_does_not_depend_on_partitions(spark):
    import random

    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 500))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts in (1, 200):
        rows = packing.pack(docs.repartition(parts), BYTES).select("doc_id", "start", "length", "sequence_id", "offset").toPandas()
        total, sequences = rows["length"].sum(), rows["sequence_id"].nunique()
        assert sequences <= 1.02 * total / 1024 + 2
        ordered = rows.sort_values(["sequence_id", "offset"])
        ends = ordered.groupby("sequence_id")["length"].cumsum()
        assert (ends - ordered["length"] == ordered["offset"]).all() and ends.max() <= 1024


def test_ids_are_the_librarys():
    import random

    rng, encode, tokenizer = random.Random(1), packing.WordEncoder(BYTES), Tokenizer.from_file(BYTES)
    signs = [*"ab'sl 1!é\n\t<|\x1c\x85  ½Ⅷ²ก็日A,.", "  ", " ", " ", "<|endoftext|>", " \n", "\r\n", "'re", "́"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), 32, 32, rng.randrange(0x10000, 0x1FBFF)])) for _ in range(rng.randrange(60))) for _ in range(4000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(encode(texts)) == want == list(encode(texts))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Repeated ids do not pass the bounds of the sample, in rows or in features."""
    docs = spark.range(3000).selectExpr("id % 30 as doc_id", "concat('word', id, ' vile', id % 2, ' more of it') as text").unionByName(spark.range(2000).selectExpr("7L as doc_id", "'the same text of one id' as text"))
    labels = spark.range(30).selectExpr("id as doc_id", "1 as quality", "cast(id % 2 as int) as toxic")
    fitted, plain = [], toxicity.fit_category

    def watched(rows, number, bits):
        fitted.append(rows.selectExpr("count(*) as n", "sum(length(features)) div 4 as size").first())
        return plain(rows, number, bits)

    monkeypatch.setattr(toxicity, "fit_category", watched)
    toxicity.train(docs, labels, toxicity.label_columns(), sample=100)
    toxicity.train(docs, labels, toxicity.label_columns(), sample=100, entries=500)
    assert [f.n for f in fitted[:2]] == [100, 100] and all(400 < f["size"] <= 500 for f in fitted[2:])


def test_packing_encoder_minds_the_file(odd_texts):
    texts = [t or "" for t in odd_texts[:12]] + ["Mixed CASE  don't ½ x1y2", "tab\tand\nline"]
    for path, apart in ((BYTES, True), (BPE, False)):
        encoder, tokenizer = packing.WordEncoder(path), Tokenizer.from_file(path)
        assert encoder.apart is apart
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
