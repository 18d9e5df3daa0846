import numpy as np
import pytest

from framelake.functions.geometry import Cell
from framelake.sources import codecs


def bits_of(xyz_int, small, low, runs):
    """Hand-packed XTC coordinates: one atom in full, then a run of atoms as differences."""
    sizes = [int(xyz_int[:, k].max() - low[k]) + 1 for k in range(3)]
    w = codecs.BitWriter()
    joint = codecs._bits_for(sizes)
    i = 0
    for run in runs:
        full = xyz_int[i + 1] if run else xyz_int[i]  # the first two atoms of a run change places
        w.triple(full - low, joint, sizes)
        w.bits(1, 1)
        w.bits(run * 3 + 1, 5)
        before, half = full, codecs.MAGIC_INTS[small] // 2
        order = [xyz_int[i], *xyz_int[i + 2 : i + 1 + run]] if run else []
        for k, here in enumerate(order):
            w.triple(here - before + half, small, [codecs.MAGIC_INTS[small]] * 3)
            before = before if k == 0 else here
        i += 1 + run
    return w.done(), [low[k] + sizes[k] - 1 for k in range(3)]


def test_xtc_runs():
    x = np.array([[100, 100, 100], [103, 98, 101], [105, 99, 103], [300, 5, 60], [304, 2, 62]])
    low = x.min(0).tolist()
    # the second atom of a run is the reference of the third as well
    data, high = bits_of(x, 15, low, [2, 1])
    got = codecs._unpack_coordinates(codecs.BitReader(data), 5, low, high, 15)
    assert got.tolist() == x.tolist()


@pytest.mark.parametrize("n", [3, 9, 10, 500])
def test_xtc_round_trip(n):
    xyz = np.random.default_rng(n).uniform(-40, 60, (n, 3))
    cell = Cell.of_lengths(15, 16, 17, 80, 85, 75)
    frames = list(codecs.read_xtc(b"".join(codecs.xtc_frame(xyz + f, cell, f) for f in range(3))))
    assert len(frames) == 3
    for f, frame in enumerate(frames):
        assert np.abs(frame["xyz"] - xyz - f).max() < 0.01
        assert Cell(frame["cell"]).parameters == pytest.approx((15, 16, 17, 80, 85, 75), abs=1e-2)


def test_dcd_round_trip():
    xyz = np.random.default_rng(0).uniform(-40, 60, (20, 3))
    cell = Cell.of_lengths(15, 16, 17, 80, 85, 75)
    for c in (cell, None):
        data = codecs.dcd_header(2, 20, c is not None) + codecs.dcd_frame(xyz, c) + codecs.dcd_frame(xyz + 1, c)
        a, b = codecs.read_dcd(data)
        assert np.abs(a["xyz"] - xyz).max() < 1e-5 and np.abs(b["xyz"] - xyz - 1).max() < 1e-5
        assert (a["cell"] is None) == (c is None)
        if c:
            assert Cell(a["cell"]).parameters == pytest.approx(c.parameters, abs=1e-6)


def test_dcd_bad_record():
    data = bytearray(codecs.dcd_header(1, 2, False))
    data[88] = 7
    with pytest.raises(ValueError):
        list(codecs.read_dcd(bytes(data)))


def test_xyz():
    text = '3\nLattice="10 0 0 0 11 0 0 0 12" Properties=species:S:1:pos:R:3\nO 0 0 0 extra\nFe 1 2 3\nXq 4 5 6\n\n2\nplain\nC 1 1 1\nN 2 2 2\n5\ncut\nO 0 0 0\n'
    a, b = codecs.read_xyz(text.encode())
    assert Cell(a["cell"]).parameters == pytest.approx((10, 11, 12, 90, 90, 90))
    assert a["element"] == ["O", "Fe", "Xx"] and b["cell"] is None and b["xyz"].tolist() == [[1, 1, 1], [2, 2, 2]]


@pytest.mark.parametrize("n", [0, 1, 99_999, 100_000, 1_000_000])
def test_hybrid36(n):
    text = codecs.hybrid36(n)
    assert len(text) == 5 and codecs.unhybrid36(text) == n
    assert codecs.hybrid36(100_000) == "A0000"


def test_pdb():
    line = "ATOM  {:>5} {:<4} {:>3} {}{:>4}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2}"
    rows = [line.format(1, " O", "HOH", "A", 1, 0, 0, 0, 1, 0, "O"), line.format(2, " H1", "HOH", "A", 1, 0.96, 0, 0, 1, 0, "H")]
    text = "\n".join(["CRYST1   10.000   11.000   12.000  90.00  90.00  90.00 P 1", "MODEL 1", *rows, "ENDMDL", "MODEL 2", *rows, "ENDMDL", "CONECT    1    2    9", "END"])
    a, b = codecs.read_pdb(text.encode())
    assert a["element"] == ["O", "H"] and a["residue"] == ["HOH", "HOH"] and a["bonds"] == b["bonds"] == [(0, 1)]
    assert Cell(b["cell"]).parameters[:3] == pytest.approx((10, 11, 12))
    with pytest.raises(ValueError):
        list(codecs.read_pdb(b"ATOM  xxxxx bad"))
