"""Where each frame of a trajectory file lies, found side by side in byte ranges.

A file is cut into ranges, and a task per range finds the frames that begin in it: DCD frames follow
from the header, as all have one size; XTC frames form a chain of headers that give their sizes; XYZ
frames form a chain of counted lines; PDB models are runs of atom records between terminators. A task
enters a chain in the middle of a file by a header that looks right and is followed by another. That
entry is confirmed afterwards: the chain of the range before must end where it begins. A file with an entry
that is not confirmed is followed from its start by one task instead, so the index never guesses. A PDB
model that goes on over a range's end is put together from its pieces.

The index is a table of a row a frame. A slice of frames is a filter on it, and only the bytes of the
frames that are left are opened.
"""

from __future__ import annotations

import io
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import Cell
from framelake.runtime import staged
from framelake.sources import codecs

RANGE_BYTES = 64 << 20
MOST_TASKS = 10_000
INDEX = "file string, file_frame long, at long, size long, n long, cell array<double>"
#: Pieces of frames: range, number in it, place, end, atoms; whether it may go on from before, and beyond; the cell known by then.
_PIECE = "file string, range long, k long, at long, end long, n long, joins boolean, open boolean, cell array<double>"


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, or of the parts of a folder by name; hidden ones are passed over."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.getLen(), s.getPath().getName(), s.isDirectory()) for top in (store.globStatus(hadoop) or []) for s in store.listStatus(top.getPath())]
    kept = sorted((uri, size) for uri, size, name, folder in found if not folder and name[:1] not in "._")
    if not kept:
        raise FileNotFoundError(path)
    return kept


def address(uri: str) -> str:
    """As ``pyarrow`` wants it: Hadoop writes local files with one slash."""
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Source:
    """One open file, read at places; ``read_bytes`` counts what was asked of it."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(address(uri))
        self.file, self.read_bytes = store.open_input_file(path), 0

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data

    def lines(self, at: int) -> io.BufferedReader:
        """The file from a place on, for reading line by line."""
        self.file.seek(at)
        return io.BufferedReader(self.file, 1 << 20)


# --- chains: frames that say where the next one is ------------------------------------------------


def _xtc_frame(source: Source, at: int, size: int) -> tuple[int, int] | None:
    """(end, atoms) of the frame at a place, by its header; None where there is none."""
    head = source.read(at, 92)
    if len(head) < 56:
        return None
    magic, n = struct.unpack_from(">2i", head)
    if magic != codecs.XTC_MAGIC or n < 0 or struct.unpack_from(">i", head, 52)[0] != n:
        return None
    if n <= 9:
        end = at + 56 + 12 * n
    elif len(head) < 92:
        return None
    else:
        (stored,) = struct.unpack_from(">i", head, 88)
        if stored < 0:
            return None
        end = at + 92 + stored + -stored % 4
    return (end, n) if end <= size else None


def _xtc_entry(source: Source, lo: int, hi: int, size: int) -> int | None:
    mark = struct.pack(">i", codecs.XTC_MAGIC)
    for base in range(lo, hi, 1 << 20):
        data = source.read(base, min(1 << 20, hi - base) + 3)
        found = data.find(mark)
        while found >= 0:
            at = base + found
            frame = _xtc_frame(source, at, size)
            if frame and (frame[0] == size or _xtc_frame(source, frame[0], size)):
                return at
            found = data.find(mark, found + 1)
    return None


def _xyz_frame(source: Source, at: int, size: int) -> tuple[int, int] | None:
    """(end, atoms) of the frame that begins at a line, blank lines before it included; None where it is not whole."""
    lines = source.lines(at)
    try:
        line = lines.readline()
        end = at + len(line)
        while line and not line.strip():
            line = lines.readline()
            end += len(line)
        n = int(line.split()[0])
        end += len(lines.readline())
        for _ in range(n):
            line = lines.readline()
            end += len(line)
            _, x, y, z = line.split(None, 4)[:4]
            float(x), float(y), float(z)
    except (IndexError, ValueError):
        return None
    finally:
        source.read_bytes += lines.tell() - at
        lines.detach()
    return (end, n) if n >= 0 else None


def _xyz_entry(source: Source, lo: int, hi: int, size: int) -> int | None:
    """A line that is a count and begins a whole frame, behind which the file ends or another count stands."""
    lines, at = source.lines(lo - 1), lo - 1
    at += len(lines.readline())
    counts = []
    while at < hi:
        line = lines.readline()
        if not line:
            break
        if line.strip().isdigit():
            counts.append(at)
        at += len(line)
    source.read_bytes += at - lo
    lines.detach()
    for at in counts:
        frame = _xyz_frame(source, at, size)
        if frame:
            after = source.read(frame[0], 64).split(b"\n")[0].strip()
            if frame[0] >= size or not after or after.isdigit():
                return at
    return None


_CHAINS = {"xtc": (_xtc_frame, _xtc_entry), "xyz": (_xyz_frame, _xyz_entry)}


def _chain(source: Source, ext: str, at: int | None, hi: int, size: int) -> Iterator[tuple]:
    """(place, end, atoms) of the frames that begin before ``hi``; of what is left at last, atoms -1."""
    frame_at, _ = _CHAINS[ext]
    while at is not None and at < min(hi, size):
        frame = frame_at(source, at, size)
        if frame is None:
            if source.read(at, 1 << 16).strip() or ext == "xtc":
                yield at, at, -1  # no frame: the file's frames end here
            return
        yield at, *frame
        at = frame[0]


def _pdb_pieces(source: Source, lo: int, hi: int) -> Iterator[tuple]:
    """(place, end, atoms, joins, open, cell) of the runs of atom records that begin in a range."""
    lines = source.lines(max(0, lo - 1))
    at = max(0, lo - 1) + (len(lines.readline()) if lo else 0)
    first, end, n, closed, cell = None, at, 0, False, None
    joins = True  # nothing in this range has ended what came before it
    while at < hi:
        line = lines.readline()
        if not line:
            break
        record = line[:6].strip()
        if record in (b"ATOM", b"HETATM"):
            if first is None:
                first, joins = at, not closed
            n, end = n + 1, at + len(line)
        elif record == b"CRYST1":
            try:
                v = [float(line[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))]
            except ValueError as e:
                raise ValueError(f"malformed cell record {line!r}") from e
            cell = list(Cell.of_lengths(*v).h) if all(1e-6 <= x <= 1e6 for x in v) else []
        elif record in (b"ENDMDL", b"MODEL", b"END"):
            if first is not None:
                yield first, end, n, joins, False, cell
                first, n = None, 0
            closed = True
        at += len(line)
    source.read_bytes += at - lo
    lines.detach()
    if first is not None:
        yield first, end, n, joins, True, cell
    elif closed or cell is not None:
        yield at, at, 0, not closed, not closed, cell  # no atoms, but what later ranges must know


def _pieces(files: list[tuple[str, int]], firsts: list[int], ext: str, range_bytes: int, whole: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number in batch["id"].tolist():
                which = bisect_right(firsts, number) - 1
                uri, size = files[which]
                lo = (number - firsts[which]) * range_bytes
                hi = size if whole else min(size, lo + range_bytes)
                source, out = Source(uri), []
                if ext == "pdb":
                    found = _pdb_pieces(source, lo, hi)
                else:
                    start = 0 if lo == 0 else _CHAINS[ext][1](source, lo, hi, size)
                    found = ((at, end, n, False, False, None) for at, end, n in _chain(source, ext, start, hi, size))
                for k, row in enumerate(found):
                    out.append((uri, lo // range_bytes, k, *row))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in _PIECE.split(", ")]
    return scan


def _scanned(spark: SparkSession, files: list[tuple[str, int]], ext: str, range_bytes: int, whole: bool = False) -> DataFrame:
    counts = [1 if whole else max(1, -(-size // range_bytes)) for _, size in files]
    firsts = [sum(counts[:i]) for i in range(len(counts))]
    tasks = spark.range(0, sum(counts), 1, min(sum(counts), MOST_TASKS))
    return staged(tasks.mapInPandas(_pieces(files, firsts, ext, range_bytes, whole), _PIECE))


def _confirmed(pieces: DataFrame, files: list[tuple[str, int]]) -> list[str]:
    """Files in which the chain of some range does not begin where the chain before it ends."""
    ends = pieces.groupBy("file", "range").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.min("n").alias("least"))
    before = F.lag("end").over(Window.partitionBy("file").orderBy("range"))  # a row a range
    broken = ends.withColumn("before", before).where((F.col("before") != F.col("at")) | (F.col("least") < 0))
    last = ends.groupBy("file").agg(F.max("end").alias("end"))
    short = last.join(F.broadcast(pieces.sparkSession.createDataFrame(files, "file string, size long")), "file").where("end < size").select("file")
    return [r.file for r in broken.select("file").union(short).distinct().collect()]  # at most as many as files


def frame_index(spark: SparkSession, path: str, ext: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``INDEX`` rows of all frames of a file or folder of parts: frames count from 0 in each file.

    ``at`` and ``size`` are in bytes, ``n`` is the number of atoms, ``cell`` is known for PDB only (empty: none
    holds). What is no whole frame ends an XYZ file; in an XTC file it is an error. A DCD file whose last
    frame is cut off is an error.
    """
    files = files_of(spark, path)
    if ext == "dcd":
        return _dcd_index(spark, files)
    pieces = _scanned(spark, files, ext, range_bytes)
    if ext != "pdb":
        guessed = set(_confirmed(pieces, files))
        if guessed:
            again = _scanned(spark, [f for f in files if f[0] in guessed], ext, range_bytes, whole=True)
            if ext == "xtc" and (bad := again.where("n < 0").select("file", "at").first()):
                raise ValueError(f"no XTC frame at byte {bad['at']} of {bad['file']}")
            pieces = pieces.where(~F.col("file").isin(*guessed)).unionByName(again)
        pieces = pieces.where("n >= 0")
    return _numbered(pieces)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Frames from pieces: those that go on from an open one before are put to it; numbers by sums over ranges."""
    first = F.min(F.when(F.col("n") > 0, F.col("k")))
    ranges = pieces.groupBy("file", "range").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("frames"), first.alias("first"), F.min_by("joins", "k").alias("joins"), F.max_by("open", "k").alias("open"), F.max_by("cell", F.when(F.col("cell").isNotNull(), F.col("k"))).alias("latest")
    )
    w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    open_before = F.coalesce(F.last(F.when((F.col("frames") > 0) | ~F.col("open"), F.col("open")), ignorenulls=True).over(w), F.lit(False))
    ranges = ranges.withColumn("open_before", open_before).withColumn("goes_on", (F.col("frames") > 0) & F.col("joins") & F.col("open_before"))
    own = F.col("frames") - F.col("goes_on").cast("long")
    ranges = ranges.withColumns({"before": F.coalesce(F.sum(own).over(w), F.lit(0)), "known": F.last("latest", ignorenulls=True).over(w)})
    joined = pieces.where("n > 0").join(F.broadcast(ranges.select("file", "range", "first", "goes_on", "before", "known")), ["file", "range"])
    number = F.col("before") + F.col("k") - F.col("first") - F.col("goes_on").cast("long")
    rows = joined.select("file", number.alias("file_frame"), "at", "end", "n", F.coalesce("cell", "known").alias("cell"))
    frames = rows.groupBy("file", "file_frame").agg(F.min("at").alias("at"), (F.max("end") - F.min("at")).alias("size"), F.sum("n").alias("n"), F.max_by("cell", "at").alias("cell"))
    return frames.select(*[c.split()[0] for c in INDEX.split(", ")])


def _dcd_index(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"].tolist():
                uri, size = files[i]
                n, first, stride = codecs.dcd_layout(Source(uri).read(0, 1 << 16))
                if (size - first) % stride:
                    raise ValueError(f"{uri}: the last frame is cut off")
                out.append((uri, n, first, stride, (size - first) // stride))
            yield pd.DataFrame(out, columns=["file", "n", "first", "stride", "frames"])

    laid = spark.range(0, len(files), 1, min(len(files), MOST_TASKS)).mapInPandas(heads, "file string, n long, first long, stride long, frames long").where("frames > 0")
    each = laid.select("*", F.explode(F.expr("sequence(0L, frames - 1)")).alias("file_frame"))
    return each.select("file", "file_frame", (F.col("first") + F.col("file_frame") * F.col("stride")).alias("at"), F.col("stride").alias("size"), "n", F.lit(None).cast("array<double>").alias("cell"))


def serial_number(text: Column) -> Column:
    """The number of a PDB serial: decimal, or hybrid-36 from 100 000 on."""
    t = F.trim(text)
    return F.when(t.rlike("^-?[0-9]+$"), t.cast("long")).when(t != "", F.conv(t, 36, 10).cast("long") - (10 * 36**4 - 100_000))
