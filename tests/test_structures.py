import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from framelake import catalogue
from framelake.functions.geometry import Cell
from framelake.operators import generate, orientation

WATER = [("O", 0.0, 0.0, 0.0), ("H", 0.96, 0.0, 0.0), ("H", -0.24, 0.927, 0.0)]


def test_filled_box(spark):
    frames = spark.range(2).withColumnRenamed("id", "frame")
    rows = generate.solvate(frames, WATER, [14.0], number=20).collect()
    for f in (0, 1):
        xyz = np.array([[r.x, r.y, r.z] for r in rows if r.frame == f]).reshape(-1, 3, 3)
        assert len(xyz) == 20
        assert np.linalg.norm(xyz[:, 0] - xyz[:, 1], axis=1) == pytest.approx([0.96] * 20)
        d = xyz[:, None, :, None] - xyz[None, :, None, :]
        d -= 14 * np.floor(d / 14 + 0.5)
        r = np.sqrt((d**2).sum(-1)).min((2, 3)) + 10 * np.eye(20)
        assert r.min() >= 2.5
    with pytest.raises(ValueError):
        generate.solvate(frames, WATER, [14.0])


def test_box_filled_by_domains(spark):
    """A skewed box of many domains around own atoms: no clash, the number asked for, and the same rows for any partitions."""
    box = (30.0, 26.0, 24.0, 80, 95, 100)
    edges, inverse = generate.box_of(box), np.linalg.inv(generate.box_of(box))
    rng = np.random.default_rng(1)
    atoms = [(0, *map(float, p)) for p in rng.random((60, 3)) * 60 - 20] + [(1, 1.0, 1.0, 1.0), (1, None, None, None)]
    frames = spark.createDataFrame(atoms, "frame long, x double, y double, z double")
    fill = lambda df: sorted(map(tuple, generate.solvate(df, WATER, box, number=90, min_distance=2.0, around_existing=True, origin=(3, 2, 1), domain_copies=2).collect()))
    got = fill(frames)
    assert generate.Domains(np.zeros(3), edges, 3.5, 45).n == [2, 2, 2]
    assert got == fill(frames.repartition(7, "x"))
    for f in (0, 1):
        xyz = np.array([r[4:] for r in got if r[0] == f])
        assert [r[1:3] for r in got if r[0] == f] == [(c, s) for c in range(90) for s in range(3)]
        there = np.array([a[1:] for a in atoms if a[0] == f and a[1] is not None])
        points, owner = np.concatenate([xyz, there]), np.concatenate([np.arange(270) // 3, np.full(len(there), -1)])
        d = (points[:, None] - points[None]) @ inverse
        r = np.linalg.norm((d - np.floor(d + 0.5)) @ edges, axis=-1)
        r[owner[:, None] == owner[None]] = 9
        assert r.min() >= 2.0 - 1e-9


def test_boxes_with_little_or_no_room(spark):
    grid = [(1, float(x), float(y), float(z)) for x, y, z in itertools.product(range(12), repeat=3)]
    half = [(2, float(x), float(y), float(z)) for x, y, z in itertools.product(range(12), range(12), range(7))]
    frames = spark.createDataFrame(grid + half, "frame long, x double, y double, z double")
    rows = generate.solvate(frames, WATER[:1], [12.0], number=16, min_distance=1.5, max_attempts=40, around_existing=True, domain_copies=2).collect()
    # what the full half has no room for goes to the other half
    assert {r.frame for r in rows} == {2} and sorted(r.copy for r in rows) == list(range(16)) and min(r.z for r in rows) >= 7
    assert generate.solvate(frames.limit(0), WATER, [12.0], number=3).count() == 0 == generate.solvate(frames, WATER, [12.0], number=0).count()


@pytest.mark.parametrize("hkl", [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 0)])
def test_slab_has_whole_layers(spark, hkl):
    cell = Cell.of_lengths(4, 5, 6, 80, 95, 100)
    atoms = spark.createDataFrame([(0, 0, "A", 0.1, 0.2, 0.3), (0, 1, "B", 2.0, 2.5, 3.1)], "frame long, atom_index long, type string, x double, y double, z double")
    basis, spacing = generate.surface_basis(cell, hkl)
    assert abs(np.linalg.det(basis)) == pytest.approx(cell.volume)
    assert spacing == pytest.approx(cell.volume / np.linalg.norm(np.cross(basis[0], basis[1])))
    for depth in (1.0, 3.0):
        n = {r.type: r["count"] for r in generate.slab(atoms, cell, hkl, depth).groupBy("type").count().collect()}
        assert n == {"A": depth, "B": depth}
    assert len(generate.possible_cuts(atoms, cell, hkl)) in (1, 2)


def test_cuts_between_many_layers(spark):
    """40 000 depths of their own from 0 to 8.5 of 10: the one gap is above them, and none is lost."""
    cell = Cell.of_lengths(10, 10, 10)
    atoms = spark.range(40_000).select(F.lit(0).cast("long").alias("frame"), F.col("id").alias("atom_index"), F.lit("A").alias("type"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), (F.col("id") * 8.5 / 39_999).alias("z"))
    assert generate.possible_cuts(atoms, cell, (0, 0, 1), 0.002) == pytest.approx([0.925], abs=1e-6)
    for z, cut in ((2.0, 0.7), (9.5, 0.45)):
        one = atoms.limit(1).withColumn("z", F.lit(z))
        assert generate.possible_cuts(one, cell, (0, 0, 1)) == pytest.approx([cut])


def test_assignment():
    cost = np.random.default_rng(0).random((5, 5))

    assert orientation.least_assignments(cost[None])[0][0] == pytest.approx(min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))


def test_carbonate_frame(spark):
    o = [(math.cos(a), math.sin(a)) for a in (math.radians(x) for x in (10, 130, 250))]
    rows = [(0, 0, "C", 5.0, 5.0, 5.0)] + [(0, 0, "O", 5 + 1.3 * x, 5 + 1.3 * y, 5.0) for x, y in o]
    atoms = spark.createDataFrame(rows, "frame long, mol_index long, element string, x double, y double, z double")
    q = orientation.carbonate_orientations(atoms).first()
    assert (q.w, q.x, q.y) == pytest.approx((math.cos(math.radians(250 - 360) / 2), 0, 0), abs=1e-9) or abs(2 * math.degrees(math.atan2(q.z, q.w)) % 120) == pytest.approx(10, abs=1e-6)
    with pytest.raises(ValueError):
        orientation.carbonate_orientations(atoms.limit(3)).collect()


def test_k_means_finds_two_groups(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in range(20):
        q = np.array([1, 0, 0, 0]) if f < 10 else np.array([0, 1.0, 0, 0])
        q = q + rng.normal(0, 0.02, 4)
        q /= np.linalg.norm(q) * (1 if f % 2 else -1)
        rows.append((f, 0, *map(float, q)))
    states = spark.createDataFrame(rows, "frame long, slot int, w double, x double, y double, z double")
    _, assigned = orientation.k_means(states, 2)
    groups = {r.frame: r.state for r in assigned.collect()}
    assert len({groups[f] for f in range(10)}) == len({groups[f] for f in range(10, 20)}) == 1 and groups[0] != groups[19]
    far = orientation.nearest_state(states, states.where("frame = 0").select(F.lit(0).alias("ref"), "slot", "w", "x", "y", "z"), 0.3)
    assert {r.state for r in far.where("frame >= 10").collect()} == {0}


def test_k_means_query_is_stable(spark, monkeypatch):
    """One more step of the registered parameters changes nothing, where 20 steps are too few."""
    made, k_means = [], orientation.k_means
    monkeypatch.setattr(orientation, "k_means", lambda states, *a: made.append((states, *k_means(states, *a))) or made[0][1:])
    catalogue.queries()["quat_kmeans"](spark, "/root/testdata/sf0.1")
    states, centroids, assigned = made[0]
    again = orientation.nearest_state(states, orientation.update_centroids(states, assigned, centroids))
    assert assigned.count() > 600 and assigned.join(again, ["frame", "state"], "left_anti").count() == 0
    with pytest.raises(RuntimeError):
        k_means(states, 3, 2)


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_assignments_equal_the_best_order(n):
    rng = np.random.default_rng(n)
    costs = np.concatenate([rng.normal(size=(30, n, n)), rng.integers(0, 3, (30, n, n))])
    got, column = orientation.least_assignments(costs)
    orders = list(itertools.permutations(range(n)))
    for cost, value, c in zip(costs, got, column):
        assert sorted(c) == list(range(n)) and value == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in orders))


def test_many_slots():
    """At forty slots a hidden order is found, and no exchange of two or three columns betters a random matrix."""
    rng = np.random.default_rng(1)
    hidden = rng.permutation(40)
    easy, hard = rng.uniform(1, 2, (40, 40)), rng.uniform(0, 1, (40, 40))
    easy[np.arange(40), hidden] = 0.5
    value, column = orientation.least_assignments(np.stack([easy, hard]))
    assert column[0].tolist() == hidden.tolist() and value[0] == pytest.approx(20.0)
    c = column[1]
    for i, j, k in itertools.combinations(range(40), 3):
        for p in itertools.permutations((i, j, k)):
            assert hard[[i, j, k], c[[i, j, k]]].sum() <= hard[[i, j, k], c[list(p)]].sum() + 1e-12


def test_k_means_takes_as_many_steps_as_it_needs(spark, monkeypatch):
    """Centroids that settle in the 120th step only; once 100 steps were the most."""
    states = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 0.0)], "frame long, slot int, w double, x double, y double, z double")
    turns = iter(range(1, 121))

    class Moving:
        def __init__(self, rows):
            self.rows = rows

        def collect(self):
            n = next(turns, None)
            return self.rows if n is None else [Row(ref=r.ref, slot=r.slot, w=math.cos(n / 1000), x=math.sin(n / 1000), y=0.0, z=0.0) for r in self.rows]

    monkeypatch.setattr(orientation, "nearest_state", lambda states, centroids: centroids)
    monkeypatch.setattr(orientation, "update_centroids", lambda states, assigned, centroids: Moving(centroids.collect()))
    centroids, _ = orientation.k_means(states, 1)
    assert centroids.first().x == pytest.approx(math.sin(0.12)) and next(turns, None) is None


def test_k_means_steps_over_packed_states(spark, monkeypatch):
    """Most steps pass over packed states: as many as before, to the same centroids, and one or two by joins; once each was a shuffle of all states."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=(400, 3, 4))
    q /= np.linalg.norm(q, axis=2, keepdims=True)
    rows = [(f, s, *map(float, q[f, s])) for f in range(400) for s in range(3) if (f, s) != (7, 1)]
    states = spark.createDataFrame(rows, "frame long, slot int, w double, x double, y double, z double").cache()
    monkeypatch.setattr(orientation, "PACKED_ROWS", 200)
    calls, update = [], orientation.update_centroids
    monkeypatch.setattr(orientation, "update_centroids", lambda *a: calls.append(1) or update(*a))
    centroids, assigned = orientation.k_means(states, 3)
    assert 0 < len(calls) <= 2 and assigned.count() == 400
    start = orientation.initial_centroids(states, 3).collect()
    rows, taken = orientation._settled(states, start, 2)
    want = orientation.initial_centroids(states, 3)
    for _ in range(2):
        want = spark.createDataFrame(update(states, orientation.nearest_state(states, want), want).collect(), want.schema)
    want = {(r.ref, r.slot): r[2:] for r in want.collect()}
    assert taken == 2 and len(rows) == len(want) == 9 and all(r[2:] == pytest.approx(want[r.ref, r.slot]) for r in rows)
