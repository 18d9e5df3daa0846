"""Principal moments against a solver, and free energies of single atoms, linear and bent molecules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import aggregates


def test_eigenvalues(spark):
    rng = np.random.default_rng(2)
    tensors = [a @ a.T for a in rng.normal(size=(60, 3, 3))] + [np.diag(v).astype(float) for v in ((0, 0, 0), (5, 5, 5), (0, 3, 3), (1, 1, 9))] + [np.outer(v, v) for v in rng.normal(size=(5, 3))]
    rows = [tuple(map(float, (t[0, 0], t[1, 1], t[2, 2], t[0, 1], t[0, 2], t[1, 2]))) for t in tensors]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, xx double, yy double, zz double, xy double, xz double, yz double")
    got = df.select("n", *[e.alias(f"e{k}") for k, e in enumerate(aggregates.principal_moments(*[F.col(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")]))]).collect()
    for r in got:
        assert [r.e0, r.e1, r.e2] == pytest.approx(np.linalg.eigvalsh(tensors[r.n]).tolist(), abs=1e-6)


def test_kinds_of_molecules(spark):
    water = [(0, 16.0, 0, 0, 0), (0, 1.0, 0.96, 0, 0), (0, 1.0, -0.24, 0.927, 0)]
    rows = [(0, *a) for a in water] + [*[(0, 1, w, *(np.array([5.0, 5, 5]) + 1.16 * k * np.array([1, 2, 2]) / 3)) for k, w in enumerate((16.0, 12.0, 16.0))], (0, 2, 40.0, 9.0, 9.0, 9.0)]
    atoms = spark.createDataFrame([(f, m, w, float(x), float(y), float(z)) for f, m, w, x, y, z in rows], "frame long, mol_index long, mass double, x double, y double, z double")
    moments = aggregates.molecule_moments(atoms)
    got = {r.mol_index: (r.i_1, r.i_2, r.i_3) for r in moments.collect()}
    xyz, m = np.array([a[2:] for a in water]), np.array([a[1] for a in water])
    d = xyz - m @ xyz / m.sum()
    want = np.linalg.eigvalsh((m[:, None, None] * ((d**2).sum(1)[:, None, None] * np.eye(3) - d[:, :, None] * d[:, None])).sum(0))
    assert got[0] == pytest.approx(want.tolist()) and got[1] == pytest.approx((0, 2 * 16 * 1.16**2, 2 * 16 * 1.16**2)) and got[2] == (0, 0, 0)
    assert got[1][0] == 0.0
    kinds = spark.createDataFrame([(0, i, f"M{i + 1}", n) for i, n in enumerate((3, 3, 1))], "frame long, mol_index long, mol_type string, n_atoms long")
    e = {r.mol_type: r for r in aggregates.molecule_energies(kinds, moments).collect()}
    kt, turn = 1.380649e-23 * 300, 8 * math.pi**2 * 1.380649e-23 * 300 / 6.62607015e-34**2 * 1.66053907e-47
    assert e["M3"].rotational == 0 and e["M2"].rotational == pytest.approx(-kt * 6.02214076e20 * math.log(turn * 43.0592), rel=1e-9)
    assert e["M1"].rotational == pytest.approx(-kt * 6.02214076e20 * math.log(math.sqrt(math.pi * want.prod()) * turn**1.5), rel=1e-9)
    assert e["M2"].translational < e["M3"].translational < e["M1"].translational < 0  # heavier ones lower
