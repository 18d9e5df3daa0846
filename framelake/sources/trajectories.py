"""Trajectory files as DataFrames, and DataFrames as trajectory files.

A file is read by many tasks, each of which opens the bytes of its frames (``frame_index``), through
any store that ``pyarrow`` opens. Written trajectories are folders of parts: each part holds consecutive frames and is a valid
file by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from framelake.functions.geometry import CELL_TYPE, Cell
from framelake.operators.components import numbered
from framelake.operators.transforms import slice_frames
from framelake.runtime import batches_of, staged
from framelake.sources import codecs, frame_index

ATOMS = f"file string, file_frame long, atom_index long, serial long, name string, type string, element string, mol_type string, chain string, umol_index long, charge double, x double, y double, z double, cell {CELL_TYPE}"
ROWS = 20_000  #: atoms handed over at a time


def extension(path: str) -> str:
    """Lower-case extension that names a format; others are an error."""
    ext = path.rstrip("/").rpartition(".")[2]
    if ext not in codecs.READERS:
        raise ValueError(f"unknown file extension of {path!r}")
    return ext


def check_inputs(paths: Sequence[str]) -> None:
    """A PDB, XYZ or DCD file is needed; XTC alone has no atoms to name."""
    if not {extension(p) for p in paths} & {"pdb", "xyz", "dcd"}:
        raise ValueError("no files: a PDB, XYZ or DCD file is needed")


_CELL = [f"c{i}" for i in range(25)]  #: both triples of vectors, and lengths, angles and volume
_RAW = [f.strip() for f in ATOMS.split(", cell")[0].split(",")]


def _decoded(ext: str, carried: Sequence[str]):
    """Atoms of the frames that an index names: their bytes alone are read."""
    reader = codecs.READERS[ext]

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, dict]]:
        sources: dict[str, frame_index.Source] = {}
        heads: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.file not in sources:
                    sources.clear()
                    heads.clear()
                    source = sources[row.file] = frame_index.Source(row.file)
                    heads[row.file] = b""
                    if ext == "dcd":
                        start = source.read(0, 1 << 16)
                        heads[row.file] = start[: codecs.dcd_layout(start)[1]]
                for f in reader(heads[row.file] + sources[row.file].read(row.at, row.size)):
                    if ext == "pdb":
                        f["cell"] = tuple(row.cell) if row.cell is not None and len(row.cell) else None
                    yield row, f

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for row, f in frames(batches):
            n = len(f["xyz"])
            default = lambda key, value: f.get(key) or [value] * n  # noqa: B023, E731
            columns = {
                "file": row.file, "file_frame": row.file_frame, "atom_index": np.arange(n), "serial": default("serial", 0), "name": default("name", None), "type": default("name", None), "element": default("element", None),
                "mol_type": default("residue", "UNK" if ext == "xyz" else None), "chain": default("chain", None), "umol_index": default("res_id", 0), "charge": 0.0, "x": f["xyz"][:, 0], "y": f["xyz"][:, 1], "z": f["xyz"][:, 2],
                **{c: getattr(row, c) for c in carried},
            }
            cell = Cell(tuple(f["cell"])).row() if f["cell"] else None
            numbers = [*cell["h"], *cell["g"], *(cell[k] for k in ("a", "b", "c", "alpha", "beta", "gamma", "volume"))] if cell else [np.nan] * 25
            whole = pd.DataFrame({**columns, "periodic": cell is not None, **dict(zip(_CELL, numbers, strict=True))}, index=range(n))
            for at in range(0, n, ROWS):
                held.append(whole.iloc[at : at + ROWS])
                rows += len(held[-1])
                if rows >= ROWS:
                    yield pd.concat(held, ignore_index=True)
                    held, rows = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return decode


def read_frames(index: DataFrame, ext: str, carried: Sequence[str] = (), range_bytes: int = frame_index.RANGE_BYTES) -> DataFrame:
    """``ATOMS`` columns of the frames in ``index``, and its further long columns ``carried``; neighbouring frames share a task."""
    total = index.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(frame_index.MOST_TASKS, -(-total // range_bytes)))
    near = F.expr(f"`at` div {range_bytes}")
    asked = index.repartition(tasks, "file", near).sortWithinPartitions("file", "at")
    schema = ", ".join([*_RAW, *(f"{c} long" for c in carried), "periodic boolean", *(f"{c} double" for c in _CELL)])
    rows = asked.mapInPandas(_decoded(ext, carried), schema)
    inner = [F.array(*_CELL[:9]).alias("h"), F.array(*_CELL[9:18]).alias("g"), *[F.col(c).alias(k) for c, k in zip(_CELL[18:], ("a", "b", "c", "alpha", "beta", "gamma", "volume"), strict=True)]]
    cell = F.when(F.col("periodic"), F.struct(*inner)).cast(CELL_TYPE).alias("cell")
    return rows.select(*[c.split()[0] for c in _RAW], cell, *carried)


def read_file(spark: SparkSession, path: str, range_bytes: int = frame_index.RANGE_BYTES) -> DataFrame:
    """Atoms of one file or folder of parts: ``ATOMS`` columns. A file is read by as many tasks as it has ranges."""
    ext = extension(path)
    return read_frames(staged(frame_index.frame_index(spark, path, ext, range_bytes)), ext, (), range_bytes)


def load(spark: SparkSession, paths: Sequence[str], cache: bool = False, frames: tuple[int, int, int] | None = None, range_bytes: int = frame_index.RANGE_BYTES) -> DataFrame:
    """Atoms of all files, in order: ``frame`` counts over files, a topology file being frame 0.

    DCD and XTC frames take names, types and residues from the first frame of the first PDB or XYZ
    file. ``frames`` is a slice (begin, end, step) of the index, so no byte of other frames is read.
    """
    check_inputs(paths)
    parts, offset, template = [], 0, None
    for path in paths:
        ext = extension(path)
        index = staged(frame_index.frame_index(spark, path, ext, range_bytes))
        sizes = index.groupBy("file").agg(F.count("*").alias("n"))  # a folder's parts follow one another by name
        base = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = index.join(F.broadcast(sizes.select("file", base.alias("_base"))), "file").withColumn("frame", F.col("file_frame") + F.col("_base") + F.lit(offset)).drop("_base")
        count = index.count()
        if ext in ("pdb", "xyz"):
            if template is None and count:
                names = ("serial", "name", "type", "element", "mol_type", "chain", "umol_index")
                template = staged(read_frames(numbered.where(F.col("frame") == offset), ext).select("atom_index", *names))
        elif template is None:
            raise ValueError(f"{path!r} needs a PDB or XYZ file before it")
        offset += count
        df = staged(read_frames(slice_frames(numbered, *frames) if frames else numbered, ext, ("frame",), range_bytes))
        if ext not in ("pdb", "xyz"):
            df = df.drop(*[c for c in template.columns if c != "atom_index"]).join(template, "atom_index")
        parts.append(df.select("frame", *[c for c in ("file", "file_frame", "atom_index", "serial", "name", "type", "element", "mol_type", "chain", "umol_index", "charge", "x", "y", "z", "cell")]))
    out = reduce(DataFrame.unionByName, parts)
    return out.persist() if cache else out


def read_bonds(spark: SparkSession, path: str) -> DataFrame:
    """``frame, i, j`` of the CONECT records of a PDB file, in each of its frames; unknown serials are left out."""
    atoms = read_file(spark, path).groupBy("file_frame", "serial").agg(F.max("atom_index").alias("atom_index"))
    atoms = staged(atoms.withColumnRenamed("file_frame", "frame"))
    lines = spark.read.text(path).where(F.trim(F.substring("value", 1, 6)) == "CONECT")
    columns = [frame_index.serial_number(F.substring("value", a, 5)) for a in (7, 12, 17, 22, 27)]
    pairs = lines.select(columns[0].alias("a"), F.explode(F.array(*columns[1:])).alias("b")).dropna().distinct()
    first = atoms.select("frame", F.col("serial").alias("a"), F.col("atom_index").alias("p"))
    second = atoms.select("frame", F.col("serial").alias("b"), F.col("atom_index").alias("q"))
    found = pairs.join(first, "a").join(second, ["frame", "b"]).where("p <> q")
    return found.select("frame", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).distinct()


# --- writing -----------------------------------------------------------------------------------


def xyz_lines(atoms: DataFrame) -> DataFrame:
    """``frame, part, atom_index, value``: the lines of an XYZ file, in the order of the first three."""
    frames = atoms.groupBy("frame").agg(F.count("*").alias("n"), *([F.first("cell").alias("cell")] if "cell" in atoms.columns else []))
    h = F.array_join(F.transform(F.col("cell.h"), lambda v: F.format_string("%.6f", v)), " ") if "cell" in atoms.columns else F.lit(None).cast("string")
    comment = F.concat(F.coalesce(F.concat(F.lit('Lattice="'), h, F.lit('" ')), F.lit("")), F.lit("Properties=species:S:1:pos:R:3"))
    symbol = F.coalesce(F.when(F.col("element") != "Xx", F.col("element")), F.col("type"), F.lit("X")) if "element" in atoms.columns else F.coalesce("type", F.lit("X"))
    head = frames.select("frame", F.lit(0).alias("part"), F.lit(0).cast("long").alias("atom_index"), F.col("n").cast("string").alias("value")).union(frames.select("frame", F.lit(1), F.lit(0).cast("long"), comment))
    return head.union(atoms.select("frame", F.lit(2), F.col("atom_index").cast("long"), F.format_string("%s %.6f %.6f %.6f", symbol, "x", "y", "z")))


def pdb_lines(atoms: DataFrame, bonds: DataFrame | None = None) -> DataFrame:
    """``frame, part, atom_index, value``: the lines of a PDB file with a model per frame.

    Serials beyond 99999 are hybrid-36, in CONECT lines too. CONECT lines of the bonds (of the first frame) come last.
    """
    has = set(atoms.columns)
    n = F.col("atom_index") + 1
    number = lambda m: F.when(m <= 99_999, F.lpad(m.cast("string"), 5, " ")).otherwise(F.conv((m + (10 * 36**4 - 100_000)).cast("string"), 10, 36))
    serial = number(n)
    text = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in has else F.lit(default)
    symbol = text("element", "Xx")
    line = F.concat(
        F.lit("ATOM  "), serial, F.lit(" "), F.rpad(F.substring(text("type", "X"), 1, 4), 4, " "), F.lit(" "), F.rpad(F.substring(text("mol_type", "UNK"), 1, 3), 3, " "), F.lit(" A"), F.lpad(F.substring(text("umol_index", "0"), -4, 4), 4, " "),
        F.lit("    "), F.format_string("%8.3f%8.3f%8.3f%6.2f%6.2f", F.col("x"), F.col("y"), F.col("z"), F.lit(1.0), F.lit(0.0)), F.lit(" " * 10), F.lpad(symbol, 2, " "), F.format_string("%8.4f", F.col("charge") if "charge" in has else F.lit(0.0)),
    )
    zero = F.lit(0).cast("long")
    frames = atoms.groupBy("frame").agg(*([F.first("cell").alias("cell")] if "cell" in has else [F.lit(None).alias("cell")]))
    out = frames.select("frame", F.lit(1).alias("part"), zero.alias("atom_index"), F.format_string("MODEL %8d", F.col("frame") + 1).alias("value"))
    if "cell" in has:
        c = [F.col(f"cell.{k}") for k in ("a", "b", "c", "alpha", "beta", "gamma")]
        out = out.union(frames.where("cell is not null").select("frame", F.lit(0), zero, F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1", *c)))
    out = out.union(atoms.select("frame", F.lit(2), F.col("atom_index").cast("long"), line)).union(frames.select("frame", F.lit(3), zero, F.lit("ENDMDL")))
    if bonds is not None:
        last = atoms.agg(F.max("frame")).first()[0]
        first = bonds.where(F.col("frame") == F.lit(bonds.agg(F.min("frame")).first()[0]))
        out = out.union(first.select(F.lit(last), F.lit(4), F.col("i").cast("long"), F.concat(F.lit("CONECT"), number(F.col("i") + 1), number(F.col("j") + 1))))
    return out


class BinaryParts(DataSource):
    """Sink ``framelake-binary``: rows (part long, body binary), sorted by part and then in order, as one file a part."""

    @classmethod
    def name(cls) -> str:
        return "framelake-binary"

    def writer(self, schema, overwrite):
        return _BinaryWriter(self.options["path"], self.options["suffix"])


class _BinaryWriter(DataSourceWriter):
    """Appends pieces as they come: a task holds one batch of them, not a frame and not a part."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, rows):
        from pyspark import TaskContext

        store, base = self.store()
        attempt, made, out, part = TaskContext.get().taskAttemptId(), [], None, None
        for r in rows:
            if r.part != part:
                if out is None:
                    store.create_dir(base, recursive=True)
                else:
                    out.close()
                part, name = r.part, f"part-{r.part:05d}"
                made.append((f"{base}/_{attempt}-{name}.{self.suffix}", f"{base}/{name}-{uuid.uuid4().hex}.{self.suffix}"))
                out = store.open_output_stream(made[-1][0])  # readers pass over it until it is committed
            out.write(bytes(r.body))
        if out is not None:
            out.close()
        return _Written(made)

    def commit(self, messages):
        """Of every part the file of the attempt that counts gets its final name; what failed attempts left stays unread."""
        store, _ = self.store()
        for name, final in (pair for m in messages if m is not None for pair in m.names):
            store.move(name, final)

    def abort(self, messages):
        store, _ = self.store()
        for name, _ in (pair for m in messages if m is not None for pair in m.names):
            store.delete_file(name)


class _Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


BLOCK_ATOMS = 1 << 15  #: atoms encoded together, a multiple of eight
_LAST = 1 << 60


def _like_frames(frames: DataFrame) -> DataFrame:
    """``frames`` with ``part`` numbered anew, in order: a part ends where the next frame has more or fewer atoms, or a cell where this has none."""
    like = F.struct("n", F.col("h").isNotNull())
    within = Window.partitionBy("part").orderBy("frame")
    runs = frames.withColumn("_new", F.coalesce((like != F.lag(like).over(within)).cast("int"), F.lit(0)))
    runs = runs.withColumn("_run", F.sum("_new").over(within)).drop("_new")
    ends = runs.groupBy("part").agg((F.max("_run") + 1).alias("_runs"))  # a row a part
    first = F.coalesce(F.sum("_runs").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.join(F.broadcast(ends.select("part", first.alias("_first"))), "part").withColumn("part", (F.col("_first") + F.col("_run")).cast("long")).drop("_run", "_first")


def _binary_pieces(atoms: DataFrame, ext: str, parts: int, by_size: bool = False) -> DataFrame:
    """``part, frame, a, b, body``: pieces of the files of all parts, in the order of the first four columns.

    A task encodes ``BLOCK_ATOMS`` atoms. What stands around them follows from a row a frame, with its size
    and extremes: XTC atoms take equally many bits, so blocks join without a gap.
    """
    periodic = "cell" in atoms.columns
    stored = lambda k: F.floor(F.col(k) / 10 * 1000.0 + 0.5)
    extremes = [f(stored(k)).alias(f"{n}_{k}") for n, f in (("low", F.min), ("high", F.max)) for k in "xyz"]
    h = F.first("cell.h").alias("h") if periodic else F.lit(None).cast("array<double>").alias("h")
    frames = staged(atoms.groupBy("frame").agg(F.count("*").alias("n"), h, *extremes).repartitionByRange(parts, "frame").withColumn("part", F.spark_partition_id().cast("long")))
    if ext == "dcd" and by_size:
        frames = staged(_like_frames(frames))
    files = frames.groupBy("part").agg(F.count("*").alias("frames"), F.min("frame").alias("frame"), F.max("n").alias("n"), F.min("n").alias("least"), F.max(F.col("h").isNotNull()).alias("cell"), F.min(F.col("h").isNotNull()).alias("cells"))
    if ext == "dcd" and files.where("n <> least or cell <> cells").limit(1).count():
        raise ValueError("frames of one DCD file have equally many atoms, and all of them a cell or none")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                cell = Cell(tuple(r.h)) if r.h is not None else None
                if ext == "dcd":
                    mark = int(4 * r.n).to_bytes(4, "little")
                    out += [(r.part, r.frame, -1, 0, codecs.dcd_cell(cell))] if cell else []
                    out += [(r.part, r.frame, k, b, mark) for k in range(3) for b in (-1, _LAST)]
                else:
                    before, behind = codecs.xtc_head(r.n, cell, r.frame, (r.low_x, r.low_y, r.low_z), (r.high_x, r.high_y, r.high_z))
                    out += [(r.part, r.frame, -1, 0, before), (r.part, r.frame, 0, _LAST, behind)]
            yield pd.DataFrame(out, columns=["part", "frame", "a", "b", "body"])

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank")
        first, xyz = g.iloc[0], g[["x", "y", "z"]].to_numpy(float)
        head = (int(first["part"]), int(first["frame"]))
        block = int(first["rank"]) // BLOCK_ATOMS
        if ext == "dcd":
            rows = [(*head, k, block, np.ascontiguousarray(xyz[:, k], "<f4").tobytes()) for k in range(3)]
        elif first["n"] <= 9:
            rows = [(*head, 0, block, (xyz / 10).astype(">f4").tobytes())]
        else:
            low, high = ([int(first[f"{n}_{k}"]) for k in "xyz"] for n in ("low", "high"))
            rows = [(*head, 0, block, codecs.xtc_block(codecs.xtc_integers(xyz), low, high))]
        return pd.DataFrame(rows, columns=["part", "frame", "a", "b", "body"])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.part, r.frame, -2, 0, codecs.dcd_header(r.frames, r.n, r.cell)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["part", "frame", "a", "b", "body"])

    schema = "part long, frame long, a int, b long, body binary"
    blocks = numbered(atoms.select("frame", "atom_index", "x", "y", "z"), ["frame"], "atom_index", "rank", BLOCK_ATOMS).join(frames.drop("h"), "frame")
    made = blocks.groupBy("frame", F.expr(f"rank div {BLOCK_ATOMS}").alias("block")).applyInPandas(encode, schema)
    out = made.unionByName(frames.mapInPandas(around, schema))
    return out.unionByName(files.mapInPandas(opened, schema)) if ext == "dcd" else out


def write(atoms: DataFrame, path: str, bonds: DataFrame | None = None, parts: int = 1, original_ids: bool = False, by_size: bool = False) -> None:
    """Write a trajectory; the format follows the extension and ``path`` is a folder of parts.

    Frames are cut into ``parts`` ranges; with one part there is one file. The frames of one DCD file have
    equally many atoms, and all of them a cell or none; others are an error, or with ``by_size`` begin a further file. Atoms are numbered anew in
    order, or keep their serials with ``original_ids``. No atoms: an error.
    """
    ext = extension(path)
    if not atoms.limit(1).count():
        raise ValueError("there is no frame to write")
    if original_ids and "serial" in atoms.columns:
        atoms = atoms.withColumn("atom_index", F.col("serial") - 1 if ext == "pdb" else F.col("serial"))
    if ext in ("xyz", "pdb"):
        lines = xyz_lines(atoms) if ext == "xyz" else pdb_lines(atoms, bonds)
        ordered = lines.repartitionByRange(parts, "frame").sortWithinPartitions("frame", "part", "atom_index")
        ordered.select("value").write.text(path)
    else:
        atoms.sparkSession.dataSource.register(BinaryParts)
        pieces = staged(_binary_pieces(atoms, ext, parts, by_size))
        ordered = pieces.repartition(parts, "part").sortWithinPartitions("part", "frame", "a", "b").select("part", "body")
        with batches_of(atoms.sparkSession, 64):
            ordered.write.format("framelake-binary").mode("append").options(path=path, suffix=ext).save()
