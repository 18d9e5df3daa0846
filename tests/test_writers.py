"""Files written by ranges of atoms equal those that are encoded frame by frame."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.sources import codecs, trajectories

CELL = Cell.of_lengths(15, 16, 17, 80, 85, 75)


def by_bits(xyz, cell, step):
    """A frame with its bits written one after another."""
    ints = codecs.xtc_integers(xyz)
    low, high = ints.min(0).tolist(), ints.max(0).tolist()
    sizes = [h - l + 1 for l, h in zip(low, high)]
    w, wide = codecs.BitWriter(), any(s > 0xFFFFFF for s in sizes)
    for row in (ints - low).tolist():
        if wide:
            for v, s in zip(row, sizes):
                w.bits(v, s.bit_length())
        else:
            w.triple(row, codecs._bits_for(sizes), sizes)
        w.bits(0, 1)
    data = w.done()
    before, behind = codecs.xtc_head(len(xyz), cell, step, low, high)
    assert before[-4:] == len(data).to_bytes(4, "big")
    return before + data + behind


@pytest.mark.parametrize("spread", [0.0005, 3, 400, 20_000, 90_000, 1e6])
def test_blocks_are_the_bits_of_the_frame(spread):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-spread, spread, (203, 3)) * [1, 0.7, 1]
    assert codecs.xtc_frame(xyz, CELL, 7) == by_bits(xyz, CELL, 7)
    ints = codecs.xtc_integers(xyz)
    low, high = ints.min(0).tolist(), ints.max(0).tolist()
    assert b"".join(codecs.xtc_block(ints[i : i + 64], low, high) for i in range(0, 203, 64)) == codecs.xtc_block(ints, low, high)
    (back,) = codecs.read_xtc(codecs.xtc_frame(xyz, CELL, 7))
    assert np.abs(back["xyz"] - xyz).max() < 0.0051 + spread * 1e-12


@pytest.mark.parametrize("ext", ["dcd", "xtc"])
@pytest.mark.parametrize(("n", "parts"), [(3, 1), (9, 2), (50_001, 1), (3000, 3)])
def test_file_equals_the_one_of_whole_frames(spark, tmp_path, monkeypatch, ext, n, parts):
    """Frames of many blocks of atoms, whose indices have gaps."""
    monkeypatch.setattr(trajectories, "BLOCK_ATOMS", 1 << 12)
    xyz = np.random.default_rng(n).uniform(-40, 60, (4, n, 3))
    at = F.expr(f"cast((id div {n}) as int)"), F.expr(f"cast((id % {n}) as int)")
    values = spark.sparkContext.broadcast(xyz)

    def fill(batches):
        for b in batches:
            p = values.value[b["frame"], b["k"]]
            yield b.assign(x=p[:, 0], y=p[:, 1], z=p[:, 2], atom_index=b["k"] * 3 + 5)

    ids = spark.range(4 * n).select(at[0].alias("frame"), at[1].alias("k"), F.lit(1).alias("rank"))
    atoms = ids.repartition(5).mapInPandas(fill, "frame long, k long, rank int, x double, y double, z double, atom_index long")
    atoms = atoms.withColumn("cell", F.when(F.lit(n != 9), CELL.column()))
    path = f"{tmp_path}/t.{ext}"
    trajectories.write(atoms, path, parts=parts)
    cell = CELL if n != 9 else None
    encode = (lambda f: codecs.dcd_frame(xyz[f], cell)) if ext == "dcd" else (lambda f: codecs.xtc_frame(xyz[f], cell, f))
    files = sorted(p for p in glob.glob(f"{path}/*") if "/_" not in p)
    assert len(files) == parts and len(glob.glob(f"{path}/*")) == parts
    done = 0
    for p in files:
        data = open(p, "rb").read()
        frames = len(list(codecs.READERS[ext](data)))
        assert data == (codecs.dcd_header(frames, n, cell is not None) if ext == "dcd" else b"") + b"".join(map(encode, range(done, done + frames)))
        done += frames
    assert done == 4


def test_dcd_frames_are_alike(spark, tmp_path):
    rows = [(0, 0, 1.0, 1.0, 1.0), (0, 1, 1.0, 1.0, 1.0), (1, 0, 1.0, 1.0, 1.0)]
    with pytest.raises(ValueError, match="equally many"):
        trajectories.write(spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double"), f"{tmp_path}/t.dcd")


def test_dcd_files_end_where_frames_change_size(spark, tmp_path):
    """Frames of 3, 3, 2 and 3 atoms: three files, read back as they were."""
    rows = [(f, i, f + 0.25 * i, 0.5, 1.0) for f, n in enumerate((3, 3, 2, 3)) for i in range(n)]
    atoms = spark.createDataFrame(rows, "frame long, atom_index long, x double, y double, z double")
    trajectories.write(atoms.where("frame = 0").withColumn("type", F.lit("C")), f"{tmp_path}/t.xyz")
    trajectories.write(atoms, f"{tmp_path}/t.dcd", by_size=True)
    assert len([p for p in (tmp_path / "t.dcd").iterdir() if p.name.startswith("part-")]) == 3
    back = trajectories.load(spark, [f"{tmp_path}/t.xyz", f"{tmp_path}/t.dcd"]).where("frame > 0")
    assert sorted((r.frame - 1, r.atom_index, r.x, r.y, r.z) for r in back.collect()) == rows
