import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import oracles, topk_search, url_filters
from framelake.runtime import Scratch


@pytest.mark.parametrize("spread", [4, 3000])
def test_top_k(spark, spread):
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread + 1, (400, 9))
    v[50:150] = v[50]  # a crowd of equal rows: ties go to smaller ids
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, v array<long>")
    got = {}
    for r in topk_search.top_k(rows, rows.where("id % 20 = 0"), k=7, block_rows=64, block_queries=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    score = v @ v.T
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        order = [i for i in np.lexsort((np.arange(400), -score[q])) if i != q][:7]
        assert [found[k + 1] for k in range(7)] == [(i, score[q, i]) for i in order]


def test_regions_and_stripes(spark, monkeypatch):
    """Far apart crowds, more queries than rows of a region, ids that repeat, mixed lengths."""
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (600, 6)) + 100 * np.eye(6, dtype=int)[np.arange(600) % 6]
    v[::7] = v[0]
    rows = [(i // 2 if i > 500 else i, x.tolist()) for i, x in enumerate(v)] + [(1000, [5]), (1001, [-5]), (1002, []), (1003, [])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    monkeypatch.setattr(topk_search, "ROW_STRIPE", 2)
    with Scratch(spark) as scratch:
        index = topk_search.build_index(df, scratch, 32)
        blocks = index.blocks.collect()
        assert sum(len(b.ids) // 8 for b in blocks) == len(rows) and len(blocks) > 15
        got = {}
        for r in topk_search.search(index, df.where("id < 200 or id >= 1000").distinct(), scratch, 5, 16).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids = np.array([r[0] for r in rows[:600]])
    score = v @ v.T
    for q in range(200):
        order = [i for i in np.lexsort((ids, -score[q])) if ids[i] != q][:5]
        assert [got[q][n + 1] for n in range(5)] == [(ids[i], score[q, i]) for i in order]
    assert got[1000] == {1: (1001, -25)} and got[1001] == {1: (1000, -25)} and got[1002] == {1: (1003, 0)}


def test_slices_give_scores():
    rng = np.random.default_rng(5)
    for low, high in ((0, 1), (-64, 64), (7, 7), (-(1 << 40), 1 << 40)):
        v, w = rng.integers(low, high + 1, (130, 5)), rng.integers(-9, 10, 5)
        slices = topk_search.BitSlices.of(np.arange(130)[::-1].copy(), v)
        at, score = slices.best(w, 9, None)
        assert len(at) == 9 and score.tolist() == (v[129 - slices.ids[at]] @ w).tolist()
        assert sorted(score.tolist()) == sorted((v @ w).tolist())[-9:]


def test_few_rows_and_odd_vectors(spark):
    rows = [(0, [0.5, -0.26]), (1, [0.01, 0.02]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", topk_search.quantised(F.col("e")).alias("v"))
    assert {r.id: r.v for r in df.collect()} == {0: [32, -17], 1: [0, 1], 2: None, 3: None, 4: None, 5: None, 20: [64, 64]}
    got = topk_search.top_k(df, df.where("id % 20 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert topk_search.top_k(df.limit(0), df).count() == 0


def expected(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def test_urls(spark):
    link = '<link rel="canonical" href="%s">'
    pages = [
        (0, "http://Www.Example.ORG/es/a?q#f", None, "block", "example.org/es/"),
        (1, "https://a.com/de/1", "", "block", "com/de/"),
        (2, "https://x.net/p", link % "https://a.com/de/1", "allow", None),
        (3, "https://y.net/p", link % "https://x.net/p#part", "allow", None),
        (4, "https://z.net/p", link % "https://a.com/de/9", "block", None),
        (5, "https://z.net/q", '<meta http-equiv="refresh" content="0; url=/r">', "allow", None),
        (6, "https://z.net/r", link % "https://a.com/fr/9", "allow", None),
        (7, "https://z.net/r?utm_source=f", link % "https://a.com/de/8", "allow", None),
        (8, None, None, "allow", None),
        (9, "nohost/de/", None, "allow", None),
        (10, "https://a.com/fr/1", link % "https://a.com/de/1", "allow", "com/fr/"),
        (11, "https://example.org", None, "allow", None),
        (12, "https://org/x\ny", None, "allow", "org/"),
        (13, "https://notexample.org/es/", None, "allow", "org/"),
        (14, "HTTP://ÀB.com/es/", None, "allow", None),
    ]
    df = spark.createDataFrame([p[:3] for p in pages] + [pages[4][:3]], "page_id long, url string, html string").withColumn("verdict", F.lit(0))
    out = {r.page_id: r for r in url_filters.filter_urls(df).collect()}
    assert len(out) == len(pages) and url_filters.filter_urls(df).count() == len(pages) + 1
    # page 10 is allowed by its own rule and so allows every alias of a.com/de/1 that no rule decides
    for key, url, _, verdict, rule in pages:
        r = out[key]
        assert (r.host, r.path) == expected(url) and r.rule == rule
        assert r.verdict == verdict
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_aliases_as_in_sql(spark, tmp_path):
    """Verdicts that only an alias brings: over canonical links, the last slash, www and a tracking query."""
    import duckdb

    link = '<link rel="canonical" href="%s">'
    urls = [("https://a.com/de", None), ("http://www.a.com/de/", None), ("https://m.b.net/x?utm_source=1#p", None), ("http://b.net/x/", link % "http://q.com/de/7")]
    urls += [("https://c.net/y", link % "/z"), ("https://c.net/z/", link % "https://www.d.com/de/1"), ("https://c.net/z?ref=2", link % "https://k.com/fr/1"), ("https://e.net/", None), (None, None), ("nohost/de", link % "https://d.com/de/1")]
    urls += [(f"https://chain.net/{i}", link % (f"https://chain.net/{i + 1}" if i < 40 else "https://end.com/de/")) for i in range(41)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(urls)] * 2, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    out = url_filters.filter_urls(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    got = [tuple(r) for r in out.select("page_id", "host", "path", "rule", "verdict", "by_alias").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"SELECT page_id, host, path, rule, verdict, by_alias FROM ({oracles.oracle_sql()['op2_url_filters']})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    told = {r[0] for r in got if r[5]}
    assert told == {0, 2, 3, *range(10, 51)}


def test_long_rule_lists_by_join(spark):
    rules = [(v, h, p) for v, h, p in url_filters.RULES]
    table = spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")
    urls = [f"http://{s}{h}{p}x" for s in ("", "m.") for h in ("example.org", "org", "a.com", "com", "b.net") for p in ("/", "/es/", "/en/1", "/fr/", "/de/")]
    df = spark.createDataFrame(list(enumerate(urls)), "id long, url string").select("id", url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path"))
    rule, verdict = url_filters.rule_columns(F.col("host"), F.col("path"))
    want = {r.id: (r.r, r.v) for r in df.select("id", rule.alias("r"), verdict.alias("v")).where("r is not null").collect()}
    assert {r.id: (r.rule, r.verdict) for r in url_filters.match_rules(df, table, "id").collect()} == want


def test_vectors_of_several_lengths_and_sizes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-50, 50, 3 if i % 7 else 5).tolist()) for i in range(400)] + [(501, [1 << 41, 0, 0]), (502, None)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(3)
    asked = [r for r in rows if r[0] % 20 == 0 and r[1]]
    got = topk_search.top_k(df, df.where("id % 20 = 0"), k=9, block_rows=64, block_queries=8).collect()
    for q, v in asked:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if w and i != q and len(w) == len(v)))[:9]
        assert [(r.rank, -r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(k + 1, s, i) for k, (s, i) in enumerate(best)]
    doubles = spark.createDataFrame([([2.0**45, -0.01],), ([float("nan"), 1.0],), (None,), ([None, 1.0],), ([float("inf"), 1.0],)], "x array<double>")
    assert [r[0] for r in doubles.select(topk_search.quantised(F.col("x"))).collect()] == [[1 << 51, -1], None, None, None, None]
    with pytest.raises(OverflowError):
        topk_search.top_k(spark.createDataFrame([(1, [1 << 40]), (2, [1 << 40])], df.schema), df)
