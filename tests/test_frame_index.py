"""Files cut into small byte ranges give the frames that the codecs find in the whole file; a slice opens its own bytes only."""

import struct

import numpy as np
import pytest

from framelake.functions.geometry import Cell
from framelake.sources import codecs, frame_index, trajectories

CELL = Cell.of_lengths(15, 16, 17, 80, 85, 75)


def xyz_file(rng, frames=23):
    out = []
    for f in range(frames):
        n = int(rng.integers(0, 30))
        out.append(f"{n}\n" + ("12\n" if f % 4 == 1 else f'Lattice="{10 + f} 0 0 0 11 0 0 0 12"\n' if f % 2 else "\n"))
        out += [f"{'O' if i % 2 else '7'} {rng.uniform(-9, 9):.4f} 1e0 {i}\n" for i in range(n)]
        out.append("\n" if f % 7 == 3 else "")
    return "".join(out).encode()


def pdb_file(rng, models=17):
    line = "ATOM  {:>5} {:<4} {:>3} {}{:>4}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}          {:>2}\n"
    out = ["REMARK a file\n"] * 4
    for m in range(models):
        if m in (2, 9, 13):
            a = {2: 10.0, 9: 20.0, 13: 0.0}[m]
            out.append("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1\n" % (a, a, a, 90, 90, 90))
        out.append("" if m % 5 == 4 else f"MODEL {m:8d}\n")
        out += [line.format(i + 1, " O" if i % 3 else " CA", "HOH", "A", i // 3, *rng.uniform(-99, 99, 3), 1, 0, "O" if i % 3 else "C") for i in range(int(rng.integers(0, 12)))]
        out.append("ENDMDL\n")
    return "".join([*out, "CONECT    1    2    3\nCONECT    2    1 9999\nCONECT    2    2\nEND\n"]).encode()


def binary_file(rng, ext, frames=19, n=40, cell=CELL):
    make = codecs.dcd_frame if ext == "dcd" else lambda x, c: codecs.xtc_frame(x, c, 5)
    body = [make(rng.uniform(-20, 30, (n, 3)), cell) for _ in range(frames)]
    return (codecs.dcd_header(frames, n, cell is not None) if ext == "dcd" else b"") + b"".join(body)


def rows_of(spark, path, size):
    out = {}
    for r in trajectories.read_file(spark, path, size).collect():
        out.setdefault(r.file_frame, []).append((r.atom_index, r.name, r.element, r.mol_type, r.chain, r.umol_index, r.serial, r.x, r.y, r.z, tuple(r.cell.h) if r.cell else None))
    return {f: sorted(v, key=repr) for f, v in out.items()}


def expected(data, ext):
    out = {}
    for number, f in enumerate(codecs.READERS[ext](data)):
        n = len(f["xyz"])
        column = lambda k, d: f.get(k) or [d] * n  # noqa: B023, E731
        cell = tuple(Cell(tuple(f["cell"])).h) if f["cell"] else None
        rows = list(zip(range(n), column("name", None), column("element", None), column("residue", "UNK" if ext == "xyz" else None), column("chain", None), column("res_id", 0), column("serial", 0), *f["xyz"].T.tolist(), [cell] * n))
        if rows:
            out[number] = sorted(rows, key=repr)
    return out


@pytest.mark.parametrize(("ext", "size"), [("xyz", 300), ("xyz", 5000), ("pdb", 333), ("dcd", 600), ("xtc", 250)])
def test_ranges_find_all_frames(spark, tmp_path, ext, size):
    rng = np.random.default_rng(size)
    data = {"xyz": xyz_file, "pdb": pdb_file}.get(ext, lambda r: binary_file(r, ext))(rng)
    (tmp_path / f"t.{ext}").write_bytes(data)
    assert len(data) > 4 * size or size == 5000
    assert rows_of(spark, f"{tmp_path}/t.{ext}", size) == expected(data, ext)


def test_small_and_few_atoms(spark, tmp_path):
    """Frames of nine atoms and fewer, of one range and of many; a folder of parts; an empty file."""
    rng = np.random.default_rng(2)
    (tmp_path / "f.xtc").mkdir()
    parts = [binary_file(rng, "xtc", 5, n, c) for n, c in ((3, None), (9, CELL), (12, CELL))]
    for i, data in enumerate([*parts, b""]):
        (tmp_path / "f.xtc" / f"part-{i}.xtc").write_bytes(data)
    (tmp_path / "f.xtc" / "_part-9.xtc").write_bytes(b"left behind")
    index = frame_index.frame_index(spark, f"{tmp_path}/f.xtc", "xtc", 200).orderBy("file", "file_frame").collect()
    assert [(r.file[-5], r.file_frame, r.n) for r in index] == [(str(i), k, n) for i, n in enumerate((3, 9, 12)) for k in range(5)]
    assert [sum(r["size"] for r in index if r.file[-5] == str(i)) for i in range(3)] == [len(p) for p in parts]


def test_broken_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    whole = xyz_file(rng, 6)
    (tmp_path / "cut.xyz").write_bytes(whole + b"5\ncut\nO 0 0 0\n3\nlater\nO 0 0 0\nO 0 0 0\nO 0 0 0\n")
    assert rows_of(spark, f"{tmp_path}/cut.xyz", 150) == expected(whole, "xyz")  # the first that is cut off ends the file
    xtc = binary_file(rng, "xtc")
    for name, data, ext in (("a", xtc[:-4], "xtc"), ("b", xtc[:900] + b"junk" + xtc[900:], "xtc"), ("c", binary_file(rng, "dcd")[:-8], "dcd")):
        (tmp_path / f"{name}.{ext}").write_bytes(data)
        with pytest.raises(Exception, match="no XTC frame|cut off"):
            frame_index.frame_index(spark, f"{tmp_path}/{name}.{ext}", ext, 400).collect()
    with pytest.raises(FileNotFoundError):
        frame_index.files_of(spark, f"{tmp_path}/none.xtc")


def test_entry_that_only_looks_right_is_found_out(spark, tmp_path):
    """Comments and atoms that read as frames: ranges that are entered there are followed from the start instead."""
    fake = "1\n1\n2 0 0 0\n" * 30
    rows = fake.splitlines()
    data = (f"{len(rows)}\n" + "x\n" + "".join(f"{r.split()[0]} 1 2 3\n" for r in rows) + "2\n1\nO 1 2 3\nO 4 5 6\n" * 40).encode()
    (tmp_path / "t.xyz").write_bytes(data)
    assert rows_of(spark, f"{tmp_path}/t.xyz", 64) == expected(data, "xyz")


def test_slice_opens_its_own_bytes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    (tmp_path / "top.xyz").write_bytes(b"40\n\n" + b"O 1 2 3\n" * 40)
    for ext in ("dcd", "xtc"):
        (tmp_path / f"t.{ext}").write_bytes(binary_file(rng, ext, 100))
        index = frame_index.frame_index(spark, f"{tmp_path}/t.{ext}", ext, 900)
        asked = index.where("file_frame % 10 = 4").collect()
        source = frame_index.Source(asked[0].file)
        for r in asked:
            source.read(r.at, r["size"])
        assert source.read_bytes == sum(r["size"] for r in asked) <= 0.11 * len((tmp_path / f"t.{ext}").read_bytes())
        sent = []
        plain = trajectories.read_frames
        monkeypatch.setattr(trajectories, "read_frames", lambda index, *a, **k: sent.append(index) or plain(index, *a, **k))
        got = trajectories.load(spark, [f"{tmp_path}/top.xyz", f"{tmp_path}/t.{ext}"], frames=(5, -1, 10), range_bytes=900)
        assert sorted({r.frame for r in got.select("frame").distinct().collect()}) == list(range(5, 101, 10))
        read = [r for i in sent[1:] for r in i.collect()]  # what was opened, but for the file that names the atoms
        assert sorted(r.at for r in read if r.file.endswith(ext)) == sorted(r.at for r in asked)
        monkeypatch.setattr(trajectories, "read_frames", plain)


def test_bonds_of_records(spark, tmp_path):
    data = pdb_file(np.random.default_rng(5))
    (tmp_path / "t.pdb").write_bytes(data)
    got = {(r.frame, r.i, r.j) for r in trajectories.read_bonds(spark, f"{tmp_path}/t.pdb").collect()}
    assert got == {(k, *b) for k, f in enumerate(codecs.read_pdb(data)) for b in f["bonds"]} and got


def test_batch_size_is_left_alone(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    (tmp_path / "t.xyz").write_bytes(xyz_file(np.random.default_rng(6)))
    trajectories.load(spark, [f"{tmp_path}/t.xyz"]).count()
    assert spark.conf.get(name) == before


def test_xtc_runs_must_fit():
    writer = codecs.BitWriter()
    writer.triple((0, 0, 0), 3, (1, 1, 4))
    writer.bits(1, 1)
    writer.bits(31, 5)
    with pytest.raises(ValueError, match="run"):
        codecs._unpack_coordinates(codecs.BitReader(writer.done() + b"\0" * 64), 5, [0, 0, 0], [0, 0, 3], 15)
    assert struct.calcsize(">3if") == 16
