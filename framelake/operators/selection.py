"""Selections of atoms or molecules by a short text, compiled to a Spark SQL predicate.

``i0-9,12`` atom indices, ``aO,H`` atom types, ``j3`` molecule indices, ``mM1`` molecule types,
``x < 4.5`` positions, joined by ``and``, ``or``, ``not`` and brackets. Selectors and positions are
rewritten to SQL predicates; brackets and precedence are left to Spark's own expression syntax.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COLUMN = {"i": "atom_index", "a": "type", "j": "mol_index", "m": "mol_type"}
_TOKEN = re.compile(r"\s*(?:(?P<word>and|or|not)\b|(?P<bracket>[()])|(?P<axis>[xyz])\s*(?P<op><=|>=|<|>)\s*(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|(?P<selector>[iajm][^\s()<>]+))", re.IGNORECASE)


@dataclass(frozen=True)
class Selection:
    """A compiled selection: what it selects (``atom`` or ``molecule``), its SQL, and its single criteria."""

    text: str
    kind: str
    sql: str
    criteria: tuple[str, ...]

    @property
    def column(self) -> Column:
        return F.expr(self.sql)


def _selector(body: str, text: str, allowed: str) -> tuple[set[str], list[str]]:
    prefix, found = "", {}
    for item in body.split(","):
        if item[:1] in _COLUMN and item[:1]:
            prefix, item = item[0], item[1:]
        if prefix not in allowed or not prefix:
            raise ValueError(f"selector {body!r} is not allowed in {text!r}")
        if prefix in "ij":
            m = re.fullmatch(r"(\d+)(?:-(\d+))?", item)
            if not m or m[2] and int(m[2]) < int(m[1]):
                raise ValueError(f"{item!r} is no index or range in {text!r}")
            c = _COLUMN[prefix]
            found.setdefault(f"{c} = {int(m[1])}" if not m[2] else f"{c} BETWEEN {int(m[1])} AND {int(m[2])}", prefix)
        else:
            if not re.fullmatch(r"[A-Za-z0-9_]+", item):
                raise ValueError(f"{item!r} is no type in {text!r}; a type cannot start with i, a, j or m behind a comma")
            found.setdefault(f"{_COLUMN[prefix]} = '{item}'", prefix)
    return {("atom" if p in "ia" else "molecule") for p in found.values()}, list(found)


def compile_selection(text: str, allowed: str = "iajm") -> Selection:
    """Compile ``text``; errors are ``ValueError`` with the text in them.

    A selection of positions only selects atoms. Atom and molecule criteria do not mix.
    """
    bare = re.sub(r",\s+", ",", text.strip())
    at, parts, kinds, criteria, last = 0, [], set(), [], None
    while at < len(bare):
        m = _TOKEN.match(bare, at)
        if not m:
            raise ValueError(f"cannot read {bare[at:]!r} in selection {text!r}")
        at = m.end()
        if m["word"]:
            word = m["word"].upper()
            if word == last == "NOT":
                raise ValueError(f"doubled not in selection {text!r}")
            parts.append(word)
            last = word
            continue
        last = None
        if m["bracket"]:
            parts.append(m["bracket"])
        elif m["axis"]:
            parts.append(f"({m['axis'].lower()} {m['op']} {float(m['number'])!r}D)")
        else:
            kind, found = _selector(m["selector"], text, allowed)
            kinds |= kind
            criteria += found
            parts.append(f"({' OR '.join(found)})")
    if not parts:
        raise ValueError(f"empty selection {text!r}")
    if len(kinds) > 1:
        raise ValueError(f"atoms and molecules are mixed in selection {text!r}")
    sql = " ".join(parts)
    depth = 0
    operand = False
    for p in parts:  # operands and operators must alternate; Spark would read some slips as aliases
        if p in ("AND", "OR") and not operand or p in ("NOT", "(") and operand or p == ")" and (not operand or depth == 0) or p not in ("AND", "OR", "NOT", "(", ")") and operand:
            raise ValueError(f"misplaced {p.lower()} in selection {text!r}")
        depth += (p == "(") - (p == ")")
        operand = p not in ("AND", "OR", "NOT", "(")
    if depth or not operand:
        raise ValueError(f"selection {text!r} is not complete")
    return Selection(text, (kinds or {"atom"}).pop(), sql, tuple(criteria))


def summary(text: str) -> dict[str, list[str]]:
    """What a selection names, by column: indices and ranges (``3``, ``4-9``) or types, in their order."""
    out: dict[str, list[str]] = {c: [] for c in _COLUMN.values()}
    for criterion in compile_selection(text).criteria:
        column, value = re.split(r" = | BETWEEN ", criterion)
        out[column].append(value.strip("'").replace(" AND ", "-"))
    return out


def check_matches(df: DataFrame, selection: Selection) -> None:
    """Raise where a single criterion matches nothing (one aggregate over ``df``)."""
    if selection.criteria:
        hits = df.agg(*[F.max(F.expr(c)).alias(f"c{n}") for n, c in enumerate(selection.criteria)]).first()
        for c, hit in zip(selection.criteria, hits, strict=True):
            if not hit:
                raise ValueError(f"no entities found for {c} in selection {selection.text!r}")


def molecules_of(atoms: DataFrame, origin: str = "com", keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row per molecule: ``keys, mol_index, mol_type, x, y, z, n_atoms, mass``.

    The point is the centre of mass (needs ``mass``) or the centroid of the raw coordinates.
    """
    if origin not in ("com", "centroid"):
        raise ValueError(f"a molecule has no origin {origin!r}")
    weight = F.col("mass") if origin == "com" else F.lit(1.0)
    centre = [(F.sum(weight * F.col(k)) / F.sum(weight)).alias(k) for k in "xyz"]
    extra = [F.first("cell").alias("cell")] if "cell" in atoms.columns else []
    mass = [F.sum("mass").alias("mass")] if "mass" in atoms.columns else []
    return atoms.groupBy(*keys, "mol_index", "mol_type").agg(*centre, F.count("*").cast("int").alias("n_atoms"), *mass, *extra)


def select(atoms: DataFrame, text: str, strict: bool = False, origin: str = "com", keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Rows of ``atoms`` that a selection picks in each frame; a molecule selection picks its atoms."""
    s = compile_selection(text)
    if s.kind == "atom":
        if strict:
            check_matches(atoms, s)
        return atoms.where(s.column)
    entities = molecules_of(atoms, origin, keys) if re.search(r"\([xyz] ", s.sql) else atoms
    if strict:
        check_matches(entities, s)
    if entities is atoms:
        return atoms.where(s.column)
    return atoms.join(entities.where(s.column).select(*keys, "mol_index"), [*keys, "mol_index"], "left_semi")


def select_entities(atoms: DataFrame, text: str, origin: str = "com", keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The selected entities as points: ``keys, kind, id, x, y, z (, cell)``."""
    s = compile_selection(text)
    df = atoms if s.kind == "atom" else molecules_of(atoms, origin, keys)
    name = "atom_index" if s.kind == "atom" else "mol_index"
    cell = ["cell"] if "cell" in df.columns else []
    return df.where(s.column).select(*keys, F.lit(s.kind).alias("kind"), F.col(name).cast("long").alias("id"), "x", "y", "z", *cell)


def select_static(atoms: DataFrame, text: str, anchor: Column | None = None) -> DataFrame:
    """Membership fixed on the anchor frame (default: the first): its ids in every frame."""
    s = compile_selection(text)
    name = "atom_index" if s.kind == "atom" else "mol_index"
    at = anchor if anchor is not None else F.col("frame") == F.lit(atoms.agg(F.min("frame")).first()[0])
    members = select(atoms.where(at), text).select(name).distinct()
    return atoms.join(members, name, "left_semi")


def flag_once(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``df`` with one row per key, the first in order: union of several selections without repeats."""
    w = Window.partitionBy("frame", key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
