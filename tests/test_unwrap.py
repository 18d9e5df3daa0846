"""Whole molecules against a walk over their bonds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.operators import unwrap

CELL = Cell.of_lengths(10, 11, 12, 80, 95, 100)


def polymers():
    """Random walks of many cell lengths, numbered in a mixed order, wrapped into a tilted cell; (wrapped, whole, bonds)."""
    rng, h, at = np.random.default_rng(3), np.array(CELL.h).reshape(3, 3), 0
    whole, bonds = [], []
    for n in (1, 2, 40, 150):
        steps = rng.normal(size=(n, 3))
        steps *= 1.2 / np.linalg.norm(steps, axis=1)[:, None]
        places = np.cumsum(steps, 0) + rng.uniform(0, 10, 3)
        order = rng.permutation(n)
        whole += list(zip(order + at, places))
        bonds += [(int(order[i] + at), int(order[i + 1] + at)) for i in range(n - 1)] + [(int(order[i] + at), int(order[i + 1] + at)) for i in range(0, n - 1, 9)]
        at += n
    whole = np.array([p for _, p in sorted(whole, key=lambda x: x[0])])
    f = whole @ np.linalg.inv(h)
    return (f - np.floor(f)) @ h, whole, bonds


def frame_of(spark, points, bonds, cell=CELL, frame=0):
    a = spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(points)], "frame long, atom_index long, x double, y double, z double").withColumn("cell", cell.column())
    return a, spark.createDataFrame([(frame, min(b), max(b)) for b in bonds], "frame long, i long, j long")


def test_polymers_longer_than_the_cell(spark):
    wrapped, whole, bonds = polymers()
    a, b = frame_of(spark, wrapped, bonds)
    rows = {r.atom_index: r for r in unwrap.whole_molecules(a, b).collect()}
    starts = [0, 1, 3, 43, 193]
    for lo, hi in zip(starts, starts[1:]):
        got = np.array([[rows[i].x, rows[i].y, rows[i].z] for i in range(lo, hi)])
        assert np.abs(got - got[0] - (whole[lo:hi] - whole[lo])).max() < 1e-9  # as before it was wrapped
        assert np.abs(got[0] - wrapped[lo]).max() < 1e-12  # and beside its least atom
    assert not any(r.infinite for r in rows.values()) and len(rows) == 193


def test_molecules_bonded_to_their_image(spark):
    """A chain through the whole cell is endless; a ring that crosses the boundary twice is not."""
    cell = Cell.of_lengths(10, 10, 10)
    chain = [(x, 1.0, 1.0) for x in range(10)]
    ring = [(5 + 1.5 * np.cos(t), 9.5, 1.5 * np.sin(t)) for t in np.arange(6) * np.pi / 3]
    a, b = frame_of(spark, [*chain, *np.array(ring) % 10, (3.0, 3.0, 3.0)], [*[(i, (i + 1) % 10) for i in range(10)], *[(10 + i, 10 + (i + 1) % 6) for i in range(6)]], cell)
    rows = {r.atom_index: r for r in unwrap.whole_molecules(a.withColumn("infinite", F.lit("old")), b).collect()}
    assert [rows[i].infinite for i in range(17)] == [True] * 10 + [False] * 7
    assert [(rows[i].x, rows[i].y, rows[i].z) for i in range(10)] == [tuple(map(float, p)) for p in chain]
    got = np.array([[rows[i].x, rows[i].y, rows[i].z] for i in range(10, 16)])
    assert np.abs(got - got[0] - (np.array(ring) - ring[0])).max() < 1e-9


def test_without_cells_or_bonds(spark):
    a, b = frame_of(spark, [(0, 0, 0), (9.5, 0, 0)], [(0, 1)])
    for atoms, bonds in ((a.withColumn("cell", F.lit(None).cast(a.schema["cell"].dataType)), b), (a, b.limit(0))):
        assert sorted((r.atom_index, r.x, r.infinite) for r in unwrap.whole_molecules(atoms, bonds).collect()) == [(0, 0.0, False), (1, 9.5, False)]
    assert unwrap.whole_molecules(a.limit(0), b).count() == 0
