"""Per-frame transforms as DataFrame -> DataFrame functions, chained with ``DataFrame.transform``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.geometry import cartesian, fractional, vec, wrapped
from framelake.operators.selection import compile_selection, select

Transform = Callable[[DataFrame], DataFrame]


def pipeline(atoms: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    """Apply the steps in order."""
    return reduce(DataFrame.transform, steps, atoms)


def slice_frames(df: DataFrame, begin: int = 0, end: int = -1, step: int = 1, frame: str = "frame") -> DataFrame:
    """Frames ``begin, begin + step, ...`` before ``end`` (exclusive; negative: all)."""
    if begin < 0 or step < 1:
        raise ValueError("a slice begins at 0 or later and steps by 1 or more")
    f = F.col(frame)
    out = df.where((f >= begin) & ((f - begin) % step == 0))
    return out.where(f < end) if end >= 0 else out


def parse_slice(text: str) -> tuple[int, int, int]:
    """``b:e:s`` with each part optional."""
    parts = text.split(":")
    if len(parts) > 3 or not text:
        raise ValueError(f"{text!r} is no slice b:e:s")
    try:
        b, e, s = (int(p) if p.strip() else d for p, d in zip(parts + [""] * (3 - len(parts)), (0, -1, 1), strict=True))
    except ValueError:
        raise ValueError(f"{text!r} is no slice b:e:s") from None
    if b < 0 or s < 1:
        raise ValueError(f"slice {text!r}: begin is 0 or more, step 1 or more")
    return b, e, s


def _chosen(atoms: DataFrame, selection: str | None) -> tuple[DataFrame, Column | None]:
    """The atoms with what is needed to tell chosen ones, and the condition; None: all."""
    if selection is None:
        return atoms, None
    s = compile_selection(selection)
    if s.kind == "atom" or "(x " not in s.sql and "(y " not in s.sql and "(z " not in s.sql:
        return atoms, s.column
    picked = select(atoms, selection).select("frame", "mol_index").distinct().withColumn("_in", F.lit(True))
    return atoms.join(picked, ["frame", "mol_index"], "left"), F.coalesce("_in", F.lit(False))


def _set(atoms: DataFrame, selection: str | None, values: dict[str, Column]) -> DataFrame:
    df, chosen = _chosen(atoms, selection)
    if chosen is None:
        return df.withColumns(values)
    # the condition may read columns that change, so it is fixed first
    return df.withColumn("_c", chosen).withColumns({n: F.when(F.col("_c"), v).otherwise(F.col(n)) for n, v in values.items()}).select(*atoms.columns)


def translate(dx: float, dy: float, dz: float, selection: str | None = None) -> Transform:
    """Shift all atoms, or those of a selection (of molecules: their atoms); no shift, no step."""
    if dx == dy == dz == 0:
        return lambda atoms: atoms
    return lambda atoms: _set(atoms, selection, {k: F.col(k) + F.lit(float(d)) for k, d in zip("xyz", (dx, dy, dz), strict=True)})


def rotate(degrees: float, axis: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), selection: str | None = None) -> Transform:
    """Right-handed rotation about an axis through ``origin``."""
    if axis not in ("x", "y", "z"):
        raise ValueError(f"{axis!r} is no axis")
    u, v = {"x": "yz", "y": "zx", "z": "xy"}[axis]
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    o = dict(zip("xyz", map(float, origin), strict=True))
    du, dv = F.col(u) - o[u], F.col(v) - o[v]
    return lambda atoms: _set(atoms, selection, {u: du * c - dv * s + o[u], v: du * s + dv * c + o[v]})


def wrap_atoms() -> Transform:
    """Every atom into the cell by itself; frames without a cell stay."""
    return lambda atoms: atoms.withColumns(dict(zip("xyz", wrapped(vec(), F.col("cell")), strict=True)))


def wrap_molecules() -> Transform:
    """Every molecule by whole cells, so that its centre of mass lies inside; frames without a cell stay."""

    def step(atoms: DataFrame) -> DataFrame:
        w = Window.partitionBy("frame", "mol_index")
        centre = tuple(F.sum(F.col("mass") * F.col(k)).over(w) / F.sum("mass").over(w) for k in "xyz")
        df = atoms.withColumns({f"_{k}": c for k, c in zip("xyz", centre, strict=True)})
        cell = F.col("cell")
        shift = cartesian(tuple(F.floor(f) for f in fractional(vec("_"), cell)), cell)
        return df.withColumns({k: F.when(cell.isNull(), F.col(k)).otherwise(F.col(k) - s) for k, s in zip("xyz", shift, strict=True)}).select(*atoms.columns)

    return step


def set_column(column: str, values: Sequence, selections: Sequence[str] | None = None) -> Transform:
    """Set ``charge``, ``type`` or ``mol_type``: one value for all atoms, or one per selection, in order."""
    if selections is not None and len(selections) != len(values):
        raise ValueError("as many selections as values are needed")
    if selections is None and len(values) != 1:
        raise ValueError("without selections there is one value")
    pairs = list(zip(values, selections or [None] * len(values), strict=True))
    return lambda atoms: reduce(lambda df, p: _set(df, p[1], {column: F.lit(p[0])}), pairs, atoms)


def modify(
    move: tuple[float, float, float] | None = None,
    turn: tuple[float, str] | None = None,
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0),
    wrap: bool = False,
    charges: Sequence[float] = (),
    types: Sequence[str] = (),
    mol_types: Sequence[str] = (),
    selections: Sequence[str] = (),
) -> list[Transform]:
    """Steps in their fixed order: translate, rotate, wrap, charges, types, molecule types.

    The first selection also restricts translation and rotation, not wrapping.
    """
    first = selections[0] if selections else None
    steps: list[Transform] = []
    if move:
        steps.append(translate(*move, selection=first))
    if turn:
        steps.append(rotate(*turn, origin=origin, selection=first))
    if wrap:
        steps.append(wrap_atoms())
    for column, values in (("charge", charges), ("type", types), ("mol_type", mol_types)):
        if values:
            steps.append(set_column(column, list(values), list(selections) or None))
    return steps
