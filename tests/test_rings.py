"""Shortest rings, components by topology epoch, and numbering by ranges against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from framelake.operators import topology
from framelake.operators.components import numbered
from framelake.plans.session import Session


def shortest(bonds, longest):
    near = {}
    for i, j in bonds:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    out = {}
    for i, j in {(min(b), max(b)) for b in bonds if b[0] != b[1]}:
        far, queue = {i: 0}, deque([i])
        while queue:
            at = queue.popleft()
            for x in near[at]:
                if x not in far and {at, x} != {i, j}:
                    far[x] = far[at] + 1
                    queue.append(x)
        if j in far and far[j] + 1 <= longest:
            out[i, j] = far[j] + 1
    return out


def graphs():
    rng = random.Random(4)
    lattice = [((x * 6 + y) * 6 + z, ((x + a) % 6 * 6 + (y + b) % 6) * 6 + (z + c) % 6) for x in range(6) for y in range(6) for z in range(6) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    ladder = [(i, i + 1) for i in range(30)] + [(i, i + 7) for i in range(0, 20, 3)] + [(40, 41), (41, 41), (50, 3)]
    loose = [tuple(rng.sample(range(60), 2)) for _ in range(70)]
    return [lattice, ladder + ladder[:4], loose, [(0, 1), (1, 2)], [(i, (i + 1) % 9) for i in range(9)] + [(i + 20, (i + 1) % 8 + 20) for i in range(8)]]


@pytest.mark.parametrize("longest", [8, 5, 3])
def test_shortest_rings(spark, longest):
    rows = [(f, *b) for f, g in enumerate(graphs()) for b in g]
    got = {(r.frame, r.i, r.j): r["size"] for r in topology.ring_sizes(spark.createDataFrame(rows, "frame long, i long, j long"), longest).collect()}
    assert got == {(f, *b): s for f, g in enumerate(graphs()) for b, s in shortest(g, longest).items()}


def test_no_bonds_no_rings(spark):
    assert topology.ring_sizes(spark.createDataFrame([], "frame long, i long, j long")).count() == 0
    with pytest.raises(ValueError):
        topology.ring_sizes(spark.createDataFrame([], "frame long, i long, j long"), 2)


def test_places_by_ranges(spark):
    rows = [(k, n * 37 % 1009 - 400) for k in range(2) for n in range(500)]
    got = numbered(spark.createDataFrame(rows, "k long, n long"), ["k"], "n", "at", span=64).collect()
    for k in range(2):
        assert [r.at for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)] == list(range(500))


def test_molecules_of_later_epochs(spark):
    """Atoms 0 and 1 part on frame 3; with a topology renewed every fourth frame, frames from then on have one more molecule."""
    atoms = spark.range(8).select(F.col("id").alias("frame")).crossJoin(spark.range(4).select(F.col("id").alias("atom_index")))
    x = F.when((F.col("frame") >= 3) & (F.col("atom_index") == 0), -9.0).otherwise(F.col("atom_index") * 0.9 + F.when(F.col("atom_index") == 3, 50.0).otherwise(0.0))
    atoms = atoms.withColumns({"x": x, "y": F.lit(0.0), "z": F.lit(0.0), "type": F.lit("C"), "element": F.lit("C"), "radius": F.lit(0.4), "mass": F.lit(12.0)})
    for frequency, parted in ((4, {3, 4, 5, 6, 7}), (0, set())):
        s = Session(spark, atoms).topology(compute=True, tolerance=0.2, update_frequency=frequency)
        members, kinds = s.molecules()
        groups = {}
        for r in members.collect():
            groups.setdefault(r.frame, {}).setdefault(r.mol_index, set()).add(r.atom_index)
        assert groups == {f: ({0: {0}, 1: {1, 2}, 2: {3}} if f in parted else {0: {0, 1, 2}, 1: {3}}) for f in range(8)}
        assert {r.frame for r in s.bonds().groupBy("frame").count().where("count = 1").collect()} == parted
        assert {(r.mol_type, r.subindex, r.fingerprint) for r in kinds.where("frame = 4").collect()} == ({("M1", 1, "C"), ("M2", 1, "C,C"), ("M1", 2, "C")} if parted else {("M1", 1, "C,C,C"), ("M2", 1, "C")})


@pytest.mark.parametrize("longest", [8, 3])
def test_shortest_rings_of_many_neighbours(spark, monkeypatch, longest):
    """Rings of three by sets of bits in stripes, longer ones from what they leave."""
    monkeypatch.setattr(topology, "STRIPE_ATOMS", 6)
    n = 24
    graph = [(i, j) for i in range(n) for j in range(i + 1, n) if (i * j + i + j) % 4] + [(n - 1, n), (n, n + 1), (n + 1, n + 2), (n + 2, 0), (n + 3, n + 4), (3, n + 5), (2, n + 6), (n + 5, n + 6)]
    rows = [(f, *b) for f in (2, 5) for b in graph]
    bonds = spark.createDataFrame(rows, "frame long, i long, j long")
    assert topology._dense_stripes(bonds)
    got = {(r.frame, r.i, r.j): r["size"] for r in topology.ring_sizes(bonds, longest).collect()}
    assert got == {(f, *b): s for f in (2, 5) for b, s in shortest(graph, longest).items()}


@pytest.mark.parametrize("longest", [7, 6, 3])
def test_cycles_from_halves(spark, monkeypatch, longest):
    """All cycles of graphs with many, none of them stored as a path of its own length."""
    rng = random.Random(2)
    graph = sorted({tuple(sorted(rng.sample(range(11), 2))) for _ in range(34)})
    rows = [(f, *b) for f in (1, 4) for b in [*graph, graph[0][::-1], (3, 3)]]
    near = {}
    for i, j in graph:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    want, paths = [], [(a,) for a in near]
    for _ in range(longest):
        want += [p for p in paths if len(p) > 2 and p[0] in near[p[-1]] and p[1] < p[-1]]
        paths = [(*p, x) for p in paths for x in near[p[-1]] if x > p[0] and x not in p]
    stored, staged = [], topology.staged
    monkeypatch.setattr(topology, "staged", lambda df: stored.append(df.columns) or staged(df))
    got = [(r.frame, *r.atoms) for r in topology.cycles(spark.createDataFrame(rows, "frame long, i long, j long"), longest).collect()]
    assert sorted(got) == sorted((f, *p) for f in (1, 4) for p in want) and len(want) > 5
    texts = [tuple(map(int, (r.frame, *r.ring.split("-")))) for r in topology.cycles(spark.createDataFrame(rows, "frame long, i long, j long"), longest, text=True).collect()]
    assert sorted(texts) == sorted(got)
    assert max(map(len, stored)) <= 2 + (longest + 1) // 2
