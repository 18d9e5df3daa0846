"""Bonds of crowded frames.

Where atoms stand so close that most of the work is comparing them, bins meet as arrays: a task holds the atoms
of one bin, or a part of them, and a part of those in and around it, and takes their distances block by block. The
sums are those of ``neighbour_pairs``, in the same order, so a pair bonds here if it bonds there. How many parts a
bin has follows from its own count, so few rows that make many pairs spread, and no bin is one task.

What needs all bonds around an atom (angles, dihedrals, rings of three, atoms two bonds away) is made in tasks that
hold a part of a bin and the atoms around it (``around``): what is shuffled are atoms, some copies of each, where
lists of bonds would grow with the square of a crowded frame and bonds with their neighbours with its third power.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions.geometry import fractional, vec
from framelake.operators import pairs
from framelake.runtime import join_lookup, staged

#: Rows of one bin in a part at most, and candidates of a block of distances.
PART_ROWS = 4_096
BLOCK = 1 << 15
#: Candidates of a group: of a part of a bin and a part of what is around it.
GROUP_PAIRS = 16_000_000
_BINS = ["_b0", "_b1", "_b2"]
_FRACTIONS = ["_f0", "_f1", "_f2"]
_EDGES = [f"_h{i}" for i in range(9)]
_COUNTS = ["_n0", "_n1", "_n2"]
_HOME = ["_c0", "_c1", "_c2"]
#: Groups that ``around`` aims at, and ends of bonds in a batch of its rows.
GROUPS = 256
BATCH_ENDS = 1_000_000
#: Ends of bonds that are found at once where they stay in the task.
LINKED_ENDS = 16_000_000
#: Bytes of a set of atoms at most.
STRIPE_BYTES = 2_048
#: Atoms around a bin that one task may hold; where there are more, bonds are joined by rows.
HELD_ATOMS = 5_000_000

Columns = dict[str, np.ndarray]


def _columns(df: pd.DataFrame) -> Columns:
    return {c: df[c].to_numpy() for c in df.columns}


def _blocks(a: Columns, b: Columns, cutoff: float, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of both sides no farther apart than the cutoff, and their squared distances; with ``later`` partners of greater ``id`` only."""
    many = len(b["id"])
    step = max(1, BLOCK // many)
    for lo in range(0, len(a["id"]), step):
        rows = slice(lo, lo + step)
        first = int(np.searchsorted(b["id"], a["id"][lo], side="right")) if later else 0
        if first == many:
            return
        near = lambda c: (a[c][rows, None], b[c][None, first:])  # noqa: E731, B023
        cells = []
        for f in _FRACTIONS:
            p, q = near(f)
            least, most = np.floor(p.min() - q.max() + 0.5), np.floor(p.max() - q.min() + 0.5)
            cells.append(least if least == most else np.floor(p - q + 0.5))
        r2 = 0.0
        for k, c in enumerate("xyz"):
            p, q = near(c)
            d = p - q
            edges = [a[_EDGES[3 * i + k]][rows, None] for i in range(3)]
            moved = [n * e for n, e in zip(cells, edges, strict=True) if np.any(n) and e.any()]
            if moved:
                d -= sum(moved[1:], moved[0])
            d *= d
            r2 = d if k == 0 else r2 + d
        at = np.flatnonzero(r2 <= cutoff * cutoff)
        i, j = np.divmod(at, r2.shape[1])
        yield i + lo, j + first, r2.ravel()[at]


def _bonded(d: np.ndarray, a: Columns, b: Columns, i: np.ndarray, j: np.ndarray, tolerance: float, rules: Sequence[tuple[float, bool]]) -> np.ndarray:
    """Which pairs (rows ``i`` of a, ``j`` of b, ``d`` apart) are within their radii and the tolerance and keep the rules."""
    keep = d <= a["radius"][i] + b["radius"][j] + tolerance
    for n, (distance, below) in enumerate(rules):
        u, v, p, q = ((side[c][at] >> n & 1).astype(bool) for side, at in ((a, i), (b, j)) for c in ("_u", "_v"))
        keep &= ~(u & q | p & v) | (d < distance if below else d > distance)
    return keep


def _places(atoms: DataFrame, cutoff: float, more: Sequence[str]) -> DataFrame:
    """Atoms with all that a bond asks for, their bins and numbers of bins, fractional coordinates and the edges of their cell."""
    periodic = "cell" in atoms.columns
    cell = F.col("cell") if periodic else None
    zero = F.lit(0.0)
    cols = ["frame", F.col("atom_index").alias("id"), "x", "y", "z", "radius", *more]
    cols += [(F.coalesce(f, zero) if periodic else zero).alias(n) for n, f in zip(_FRACTIONS, fractional(vec(), cell) if periodic else [zero] * 3, strict=True)]
    bins = pairs._bins(cell, cutoff)
    counts = [n.alias(c) for c, (_, n) in zip(_COUNTS, bins, strict=True)]
    placed = atoms.where(" and ".join(f"{c} is not null" for c in ("frame", "atom_index", "x", "y", "z", "radius")))
    return placed.select(*cols, *[b.alias(c) for c, (b, _) in zip(_BINS, bins, strict=True)], *counts, *[(F.coalesce(cell["h"][i], zero) if periodic else zero).alias(e) for i, e in enumerate(_EDGES)])


def crowded_bonds(atoms: DataFrame, cutoff: float, tolerance: float, rules: Sequence[tuple[float, bool]] = (), lists: bool = False) -> DataFrame | None:
    """``frame, i, j, length`` of pairs within their radii and the tolerance, or with ``lists`` ``frame, centre, ends``: every atom's bonds in a row or more.

    A rule (distance, below) holds for pairs of one atom with its bit in ``_u`` and one with it in ``_v``. ``cutoff`` is
    the greatest distance of a bond. None where candidates are too few to be worth it, or atoms are not numbered.
    """
    names = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    if not 0 < cutoff < math.inf or len(rules) > 62 or names["atom_index"] not in ("int", "bigint"):
        return None
    bits = ["_u", "_v"] if rules else []
    places = _places(atoms, cutoff, bits)

    def spread(df: DataFrame) -> DataFrame:
        for i, b in enumerate(_BINS):
            df = df.withColumn(b, F.explode(pairs._around(F.col(b), F.col(f"_n{i}"))))
        return df

    own = staged(places.groupBy("frame", *_BINS, "_n0", "_n1", "_n2").agg(F.count("*").alias("_p")))
    around = spread(own).groupBy("frame", *_BINS).agg(F.sum("_p").alias("_q"))
    met = own.groupBy("frame", *_BINS).agg(F.sum("_p").alias("_p")).join(around, ["frame", *_BINS])
    rows = F.least("_p", F.lit(PART_ROWS))
    sizes = staged(met.select("frame", *_BINS, F.ceil(F.col("_p") / PART_ROWS).alias("_ones"), F.ceil(F.col("_q") / F.ceil(GROUP_PAIRS / rows)).alias("_twos"), (F.col("_p") * F.col("_q").cast("double")).alias("_work")))
    n, work = sizes.agg(F.count("*"), F.sum("_work")).first()
    if not work or work <= pairs.TASK_PAIRS:
        return None
    part = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    keys = ["frame", *_BINS, "_s", "_t"]
    sizes = sizes.drop("_work")
    one = join_lookup(places, sizes, ["frame", *_BINS], "inner", rows=n).withColumns({"_s": part("_ones"), "_t": every("_twos")})
    two = join_lookup(spread(places.drop(*_EDGES)), sizes, ["frame", *_BINS], "inner", rows=n).withColumns({"_t": part("_twos"), "_s": every("_ones")})
    held = ["id", "x", "y", "z", "radius", *bits, *_FRACTIONS]
    one, two = one.select(*keys, *held, *_EDGES), two.select(*[F.col(c).alias(c) for c in (*keys, *held)])  # named anew, as both sides are one table
    tasks = min(pairs.MOST_TASKS, math.ceil(work / pairs.TASK_PAIRS) + 7)
    one, two = (df.repartition(tasks, *keys).groupBy(*keys) for df in (one, two))

    def bonded(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = one.sort_values("id"), two.sort_values("id")
        a, b = _columns(one), _columns(two)
        here, there = one["id"].to_numpy(), two["id"].to_numpy()
        starts, ends, lengths = [here[:0]], [there[:0]], [one["radius"].to_numpy()[:0]]
        for i, j, r2 in _blocks(a, b, cutoff, not lists) if len(one) and len(two) else ():
            d = np.sqrt(r2)
            keep = _bonded(d, a, b, i, j, tolerance, rules) & (here[i] != there[j] if lists else here[i] < there[j])
            at = np.flatnonzero(keep)
            starts.append(here[i[at]])
            ends.append(there[j[at]])
            lengths.append(d[at])
        i, j = np.concatenate(starts), np.concatenate(ends)
        if not lists:
            return pd.DataFrame({"frame": np.repeat(one["frame"].to_numpy()[:1], len(i)), "i": i, "j": j, "length": np.concatenate(lengths)})
        centres, begins = np.unique(i, return_index=True)  # rows of a centre follow one another
        return pd.DataFrame({"frame": np.repeat(one["frame"].to_numpy()[:1], len(centres)), "centre": centres, "ends": pd.Series(np.split(j, begins[1:]) if len(i) else [], dtype=object)})

    index = names["atom_index"]
    schema = f"frame {names['frame']}, centre {index}, ends array<{index}>" if lists else f"frame {names['frame']}, i {index}, j {index}, length double"
    return one.cogroup(two).applyInPandas(bonded, schema)


class Near:
    """The atoms around one bin of a frame in the order of their numbers, and those of them that are the task's ``own``."""

    def __init__(self, table: pa.Table, cutoff: float, tolerance: float, rules: Sequence[tuple[float, bool]]):
        df = table.to_pandas().sort_values("id")
        self.atoms, self.cutoff, self.tolerance, self.rules = _columns(df.drop(columns=["_mine", *_HOME, *_COUNTS])), cutoff, tolerance, rules
        self.id = self.atoms["id"]
        self.own = np.flatnonzero(df["_mine"].to_numpy())
        self.frame = table.column("frame")[0]
        self.bins, self.bin = np.unique(df[_HOME].to_numpy(), axis=0, return_inverse=True)
        counts = table.select(_COUNTS).slice(0, 1).to_pylist()[0]
        self.counts = [counts[c] for c in _COUNTS]

    def take(self, at: np.ndarray) -> Columns:
        return {c: v[at] for c, v in self.atoms.items()}

    def _beside(self, home: np.ndarray) -> np.ndarray:
        """Which bins are no more than one away."""
        far = np.abs(self.bins - home)
        for k, n in enumerate(self.counts):
            if n is not None:
                far[:, k] = np.minimum(far[:, k], n - far[:, k])
        return (far <= 1).all(axis=1)

    def links(self, centres: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ends): how many atoms (of ``among``, a mask) are bonded to each of the rows ``centres`` (ascending), and those of all, in order."""
        starts, ends = [centres[:0]], [centres[:0]]
        for b in np.unique(self.bin[centres]):
            here = centres[self.bin[centres] == b]
            beside = self._beside(self.bins[b])[self.bin]
            there = np.flatnonzero(beside if among is None else beside & among)
            if not len(there):
                continue
            one, two = self.take(here), self.take(there)
            for i, j, r2 in _blocks(one, two, self.cutoff, False):
                at = np.flatnonzero(_bonded(np.sqrt(r2), one, two, i, j, self.tolerance, self.rules) & (one["id"][i] != two["id"][j]))
                starts.append(here[i[at]])
                ends.append(there[j[at]])
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(start, kind="stable")
        first = np.searchsorted(start[order], centres)
        return np.diff(np.append(first, len(start))), end[order]

    def parts(self) -> Iterator[np.ndarray]:
        """Own atoms, so many at a time that their ends stay within a batch."""
        step = max(1, BATCH_ENDS // len(self.id))
        for lo in range(0, len(self.own), step):
            yield self.own[lo : lo + step]

    def listed(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each own atom with the atoms bonded to it, in order."""
        for part in self.parts():
            sizes, ends = self.links(part)
            yield from zip(part.tolist(), np.split(ends, np.cumsum(sizes)[:-1]), strict=True)

    def mutual(self, one: np.ndarray, two: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``one`` and ``two`` (rows in order) of atoms that are bonded; with ``later`` those of greater number in two only."""
        a, b = self.take(one), self.take(two)
        firsts, seconds = [one[:0]], [two[:0]]
        for i, j, r2 in _blocks(a, b, self.cutoff, later):
            at = np.flatnonzero(_bonded(np.sqrt(r2), a, b, i, j, self.tolerance, self.rules) & (a["id"][i] < b["id"][j] if later else a["id"][i] != b["id"][j]))
            firsts.append(i[at])
            seconds.append(j[at])
        return np.concatenate(firsts), np.concatenate(seconds)

    def between(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """Components of the vectors from rows ``two`` to rows ``one``, by the nearest image."""
        a, b = self.take(one), self.take(two)
        cells = [np.floor(a[f] - b[f] + 0.5) for f in _FRACTIONS]
        return [a[c] - b[c] - sum(n * a[_EDGES[3 * i + k]] for i, n in enumerate(cells)) for k, c in enumerate("xyz")]


def ragged(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Lists of so many of the values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def batch(frame: pa.Scalar, rows: int, **columns) -> pa.RecordBatch:
    """Rows of one frame."""
    return pa.RecordBatch.from_pydict({"frame": pa.array([frame.as_py()], frame.type).take(pa.array(np.zeros(rows, np.int64))), **columns})


def around(
    atoms: DataFrame, cutoff: float, tolerance: float, rules: Sequence[tuple[float, bool]], made: Callable[[Near], Iterator[pa.RecordBatch]], schema: str, *, reach: int = 1, power: int = 1, more: Sequence[str] = (), centres: DataFrame | None = None
) -> DataFrame | None:
    """Rows that ``made`` yields for parts of bins, each with all atoms in up to ``reach`` bins around; None where ``crowded_bonds`` is None, or too many atoms stand around one bin.

    What is made for an atom grows as the ``power`` of the atoms around it: this decides into how many parts a bin's own
    atoms go. ``schema`` is written with ``{frame}`` and ``{index}`` for the types of these. ``centres`` (``frame, id``,
    distinct) are the own atoms, if not all are. The whole cell of a group's frame is taken from its first atom.
    """
    names = {f.name: f.dataType.simpleString() for f in atoms.schema.fields}
    if not 0 < cutoff < math.inf or len(rules) > 62 or names["atom_index"] not in ("int", "bigint"):
        return None
    bits = ["_u", "_v"] if rules else []
    places = _places(atoms, cutoff, [*bits, *more])
    places = places.withColumn("_may", F.lit(True)) if centres is None else places.join(centres.withColumn("_may", F.lit(True)), ["frame", "id"], "left")

    def near(b: str, n: str):
        bins = F.sequence(F.col(b) - reach, F.col(b) + reach)
        return F.explode(F.when(F.col(n).isNull(), bins).otherwise(F.array_distinct(F.transform(bins, lambda x: F.pmod(x, F.col(n))))))

    def spread(df: DataFrame) -> DataFrame:
        for b, c, n in zip(_BINS, _HOME, _COUNTS, strict=True):
            df = df.withColumn(c, F.col(b)).withColumn(b, near(c, n))
        return df

    keys = ["frame", *_BINS]
    filled = staged(places.groupBy(*keys, *_COUNTS).agg(F.count("*").alias("_p"), F.count("_may").alias("_m")))
    around = spread(filled).groupBy(*keys).agg(F.sum("_p").alias("_q"))
    met = filled.where("_m > 0").groupBy(*keys).agg(F.sum("_m").alias("_m")).join(around, keys)
    weight = F.col("_m") * F.pow(F.col("_q").cast("double"), F.lit(power))
    sizes = staged(met.select(*keys, "_m", "_q", weight.alias("_weight"), (F.col("_m") * F.col("_q").cast("double")).alias("_work")))
    n, work, total, most = sizes.agg(F.count("*"), F.sum("_work"), F.sum("_weight"), F.max("_q")).first()
    if centres is None and (not work or work <= pairs.TASK_PAIRS) or (most or 0) > HELD_ATOMS:
        return None
    sizes = sizes.select(*keys, F.least("_m", F.ceil(F.col("_weight") * (GROUPS / total if total else 0.0))).alias("_ones"))
    home = F.lit(True)
    for b, c in zip(_BINS, _HOME, strict=True):
        home = home & (F.col(b) == F.col(c))
    rows = join_lookup(spread(places), sizes, keys, "inner", rows=n).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ones") - 1)))
    mine = home & F.coalesce(F.col("_may"), F.lit(False)) & (F.pmod(F.xxhash64("id"), F.col("_ones")) == F.col("_s"))
    rows = rows.select(*keys, "_s", "id", "x", "y", "z", "radius", *bits, *more, *_FRACTIONS, *_EDGES, *_HOME, *_COUNTS, mine.alias("_mine"))
    tasks = min(pairs.MOST_TASKS, n + GROUPS, max(math.ceil((work or 0) / pairs.TASK_PAIRS) + 7, GROUPS // 2 if power > 1 else 1))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Near(pa.Table.from_batches(list(batches)), cutoff, tolerance, rules)
        if len(held.own):
            yield from made(held)

    return rows.repartition(tasks, *keys, "_s").groupBy(*keys, "_s").applyInArrow(group, schema.format(frame=names["frame"], index=names["atom_index"]))
