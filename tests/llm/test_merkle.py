"""The Merkle manifest against a plain tree, its log against a plain postorder walk."""

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from framelake.llm import merkle, oracles
from framelake.runtime import Scratch


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 16 * 16
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 16])))
        i //= 16
    return out


def postorder(levels):
    """(level, index) of all nodes, children before their parent."""
    def walk(level, index):
        if level:
            for child in range(16 * index, min(16 * index + 16, len(levels[level - 1]))):
                yield from walk(level - 1, child)
        yield level, index

    return list(walk(len(levels) - 1, 0)) if levels[0] else []


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4095, 4096, 4097, 4353, 9000])
def test_positions_are_those_of_a_postorder_walk(n):
    levels = tree([str(i) for i in range(n)])
    for at, (level, index) in enumerate(postorder(levels)):
        assert merkle.position(level, index, n) == at


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def expected(rows):
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    keys = sorted(leaves, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(leaves[k], key=lambda x: x[:3])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for i, (_, _, leaf, r) in enumerate(sorted(leaves[k], key=lambda x: x[:3])):
            steps = proof(trees[k], i) + proof(top, g)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = h("".join(map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))))
            for left, right in steps:
                node = h(left + node + right)
            out.append((r[0], leaf, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as n", "3 as `index`", "4 as digest", "5 as root", "6 as `left`")
    with Scratch(spark) as scratch:
        return [tuple(r) for r in merkle.verified(df.repartition(5), scratch).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def odd_rows():
    rows = [(i * 7 % 5000, "hot", "en", i, f"Text {i} Öé") for i in range(5000)]
    rows += [(10**17 + i, f"s{i % 40}", None, None, None if i % 3 else f"É{i}") for i in range(300)]
    rows += [(i, None, "fr", 5, "aB") for i in range(20)] + [(None, None, "fr", 5, "aB"), (None, "hot", "fr", 5, "aB"), (10**17 + 1, None, "x", 1, "A")]
    return rows + [(3, "hot", "en", 1, "Twice")] * 40 + [(77, "alone", "", 0, ""), (78, "Zone", "", 0, "lower"), (5, "", "", 0, "é")]


def test_manifest(spark):
    got, want = made(spark, odd_rows()), expected(odd_rows())
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(not g[-1] for g in got) and sum(g[-1] for g in got) > 4000


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, "T")], [(1, "a", None, None, "T"), (2, "a", None, None, None)], [(1, "a", None, None, "T"), (2, None, "e", 1, "t")]])
def test_small_tables(spark, rows):
    assert sorted(made(spark, rows)) == sorted(expected(rows))


def test_log_is_whole_and_appends(spark):
    """The log has every node once, at its place; a longer dataset's log begins with the closed part of it."""
    def log_of(n):
        leaves = spark.range(n).selectExpr("0L as tree", f"{n}L as n", "id as `index`", "sha2(cast(id as string), 256) as digest")
        with Scratch(spark) as scratch:
            blocks = scratch.staged(merkle._blocks(leaves))
            return [r.digest for r in merkle.append_log(blocks, scratch).entries().orderBy("position").collect()]

    for n in (300, 4400):
        levels = tree([h(str(i)) for i in range(n)])
        assert log_of(n) == [levels[a][b] for a, b in postorder(levels)]
    closed = 4096 + 256 + 16 + 1
    assert log_of(4400)[:closed] == log_of(5000)[:closed]


def test_manifest_as_in_sql(spark, tmp_path):
    rows = odd_rows()[4700:]
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())])
    pq.write_table(pa.table({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema=schema), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({oracles.oracle_sql()['op11_merkle_manifest']})").fetchall()
    assert sorted(made(spark, rows), key=repr) == sorted(map(tuple, want), key=repr)
