"""The pipeline on a small corpus, stage by stage against what each stage must do."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.runtime import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    rng, rows, labels = random.Random(1), [], []
    for i in range(420):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        toxic, poor = i % 9 == 0, i % 10 == 3
        if toxic:
            words[5:5] = ["scum", f"vile{i}"]
        if poor:
            words = words[:20]
        rows.append((i, " ".join(words), "en", f"src{i % 4}", 0))
        labels.append((i, int(not poor), int(toxic)))
    near = {j: 400 + j for j in range(1, 9) if j % 9 and j % 10 != 3}
    rows = [r if r[0] not in near.values() else (r[0], rows[r[0] - 400][1] + " end", *r[2:]) for r in rows]
    labels = [l for l in labels if l[0] < 400]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, str(tmp_path)))
        if i < 4:
            assert docs.columns == columns
            kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    text = {r[0]: r[1] for r in rows}
    clean = {i for i in text if i not in [k for k in range(420) if k % 9 == 0] or i in near.values()}
    assert set(kept[0]) == clean and len(kept[0]) == len(clean)
    assert set(kept[1]) == {i for i in kept[0] if len(WORD.findall(text[i])) >= 50}
    assert set(kept[2]) == set(kept[1]) - set(near.values())
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].count(i) for i in set(kept[3])) <= 3
    tokens = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
    assert tokens.max() <= 1024 and np.sum(tokens) == docs.agg(F.sum("length")).first()[0]
    starts = docs.where("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in starts} == {i: kept[3].count(i) for i in set(kept[3])}


def test_null_and_repeated_ids(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    again, changed = prose(80), prose(90)
    rows = [(i, prose(rng.randrange(60, 120)), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100, again, "en", "src0", 0)] * 30 + [(101, "", "en", "src1", 0)] * 4 + [(102, changed, "en", "src1", 0), (102, prose(70), "en", "src2", 0), (103, changed, "en", "src1", 0)]
    rows += [(None, prose(100), "en", f"src{i % 3}", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = staged(corpus_pipeline.near_dedup_stage(spark, docs, ""))
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, {r for r in docs.collect() if r.doc_id != 103}))
    # m equal rows are m documents, of at most three copies each; rows without an id are mixed as well
    docs, mixed = staged(docs), corpus_pipeline.mixing_stage(spark, docs, "")
    out = mixed.collect()
    assert mixed.columns == docs.columns and set(out) <= set(map(tuple, rows))
    assert all(out.count(r) <= 3 * rows.count(tuple(r)) for r in set(out))
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert abs(words(out) - words(rows)) <= 0.05 * words(rows)
    assert sum(r.doc_id == 101 for r in out) == 4
    # sources whose documents are taken at the full rate give every row back
    one = spark.createDataFrame([r for r in rows if r[3] == "src0"], docs.schema)
    assert sorted(map(repr, corpus_pipeline.mixing_stage(spark, one, "").collect())) == sorted(map(repr, one.collect()))


def test_columns_of_any_names_and_empty_tables(spark, tmp_path):
    """No stage replaces a column of the documents or fails on its name, and all take an empty table."""
    rng = random.Random(4)
    names = ["q", "kept", "toxic", "toxicity", "host", "host_failed", "copies", "row", "key", "component_id", "size"]
    rows = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(80)), "en", f"src{i % 3}", 0, *[f"{n}{i}" for n in names]) for i in range(60)] + [(60, None, None, None, None, *[None] * len(names))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema).repartition(2)
        by_id = {r[0]: tuple(r) for r in given}
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = staged(stage(spark, docs, str(tmp_path)))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
            assert all(tuple(r) == by_id[r.doc_id] for r in docs.collect())
        assert corpus_pipeline.packing_stage(spark, docs, str(tmp_path)).where("start = 0").count() == docs.count()
        assert not given or docs.count()


def test_run_leaves_its_result_only(spark, tmp_path):
    """The shared folder holds the packed pieces at the end, and nothing that stages wrote on their way."""
    import os

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(70)), "en", f"src{i % 3}", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    (left,) = set(os.listdir(shared)) - before
    assert out.count() > 0 and all(left in f for f in out.inputFiles())
