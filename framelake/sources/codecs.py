"""Frames of trajectory files: decoding from bytes and encoding to bytes, one frame at a time.

A decoded frame is a dict with ``xyz`` (n x 3, angstrom), ``cell`` (nine numbers, lattice vectors in
rows, or None) and, where the format has them, lists ``name``, ``element``, ``residue``, ``chain``,
``res_id``, ``serial``.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

from framelake.functions.elements import ELEMENTS
from framelake.functions.geometry import Cell

SYMBOLS = {e[0] for e in ELEMENTS}


def element(name: str) -> str:
    """Exact symbol, else the first two characters, else the first, else ``Xx``."""
    return next((s for s in (name, name[:2], name[:1]) if s in SYMBOLS), "Xx")


# --- XYZ ---------------------------------------------------------------------------------------


def lattice(comment: str) -> tuple[float, ...] | None:
    """The nine numbers of ``Lattice="..."`` (lattice vectors in rows), quoted or bare."""
    m = re.search(r"Lattice\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|((?:[-+.\deE]+\s*){9}))", comment)
    if not m:
        return None
    v = [float(x) for x in (m[1] or m[2] or m[3]).split()]
    return tuple(v) if len(v) == 9 else None


def read_xyz(data: bytes) -> Iterator[dict]:
    """Frames of an XYZ file; the first truncated or malformed one ends the stream."""
    lines = data.decode("utf-8", "replace").splitlines()
    at = 0
    while True:
        while at < len(lines) and not lines[at].strip():
            at += 1
        try:
            n = int(lines[at].split()[0])
            rows = [lines[at + 2 + i].split() for i in range(n)]
            xyz = np.array([[float(x) for x in r[1:4]] for r in rows], float).reshape(n, 3)
        except (IndexError, ValueError):
            return
        names = [r[0] for r in rows]
        yield {"xyz": xyz, "cell": lattice(lines[at + 1]), "name": names, "element": [element(x) for x in names], "serial": list(range(n))}
        at += n + 2


# --- PDB ---------------------------------------------------------------------------------------


def hybrid36(n: int) -> str:
    """Serial in five columns: decimal to 99999, then base 36 from A0000."""
    if n <= 99_999:
        return f"{n:5d}"
    n += 10 * 36**4 - 100_000
    out = ""
    for _ in range(5):
        n, d = divmod(n, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out


def unhybrid36(text: str) -> int:
    text = text.strip()
    return int(text) if text.lstrip("-").isdigit() else int(text, 36) - 10 * 36**4 + 100_000


def read_pdb(data: bytes) -> Iterator[dict]:
    """Models of a PDB file; a cell holds for later models, CONECT records (``bonds``) for all of them."""
    cell, atoms, frames, serials = None, [], [], []

    def made() -> dict:
        return {"cell": cell, "xyz": np.array([a[0] for a in atoms], float).reshape(-1, 3), **{k: [a[i] for a in atoms] for i, k in enumerate(("name", "element", "residue", "chain", "res_id", "serial"), 1)}}

    for line in data.decode("latin-1").splitlines():
        record = line[:6].strip()
        if record == "CRYST1":
            v = [float(line[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))]
            cell = Cell.of_lengths(*v).h if all(1e-6 <= x <= 1e6 for x in v) else None
        elif record in ("ATOM", "HETATM"):
            try:
                name, symbol = line[12:16].strip(), line[76:78].strip().capitalize()
                res = line[22:26].strip()
                atoms.append(([float(line[30:38]), float(line[38:46]), float(line[46:54])], name, symbol if symbol in SYMBOLS else element(name), line[17:20].strip(), line[21:22].strip(), int(res) if res else 0, unhybrid36(line[6:11])))
            except ValueError as e:
                raise ValueError(f"malformed atom record {line!r}") from e
        elif record in ("ENDMDL", "MODEL", "END") and atoms:
            frames.append(made())
            atoms = []
        elif record == "CONECT":
            found = [line[a : a + 5].strip() for a in (6, 11, 16, 21, 26)]
            serials += [(unhybrid36(found[0]), unhybrid36(x)) for x in found[1:] if x and found[0]]
    if atoms:
        frames.append(made())
    for f in frames:
        place = {s: i for i, s in enumerate(f["serial"])}
        f["bonds"] = sorted({tuple(sorted((place[a], place[b]))) for a, b in serials if a in place and b in place and a != b})
        yield f


# --- DCD ---------------------------------------------------------------------------------------


def _record(data: memoryview, at: int) -> tuple[memoryview, int]:
    (n,) = struct.unpack_from("<i", data, at)
    if n < 0 or struct.unpack_from("<i", data, at + 4 + n)[0] != n:
        raise ValueError("a record's lengths differ")
    return data[at + 4 : at + 4 + n], at + n + 8


def dcd_layout(data: bytes) -> tuple[int, int, int]:
    """(atoms, bytes before the first frame, bytes of a frame) from the first bytes of a DCD file; frames are alike."""
    view = memoryview(data)
    head, at = _record(view, 0)
    if bytes(head[:4]) != b"CORD":
        raise ValueError("not a DCD file")
    flags = struct.unpack_from("<20i", head, 4)
    _, at = _record(view, at)
    natoms, at = _record(view, at)
    (n,) = struct.unpack("<i", natoms)
    cell, fourth = flags[19] != 0 and flags[10] != 0, flags[19] != 0 and flags[11] != 0
    return n, at, (56 if cell else 0) + (4 if fourth else 3) * (4 * n + 8)


def read_dcd(data: bytes) -> Iterator[dict]:
    """Frames of a little-endian DCD file, to its end whatever its header's count says."""
    view = memoryview(data)
    head, at = _record(view, 0)
    if bytes(head[:4]) != b"CORD":
        raise ValueError("not a DCD file")
    flags = struct.unpack_from("<20i", head, 4)
    has_cell, has_4d = flags[19] != 0 and flags[10] != 0, flags[19] != 0 and flags[11] != 0
    _, at = _record(view, at)  # titles
    natoms, at = _record(view, at)
    (n,) = struct.unpack("<i", natoms)
    while at < len(view):
        cell = None
        if has_cell:
            block, at = _record(view, at)
            a, gamma, b, beta, alpha, c = struct.unpack("<6d", block)
            if all(-1 <= v <= 1 for v in (alpha, beta, gamma)):
                alpha, beta, gamma = (float(np.degrees(np.arccos(v))) for v in (alpha, beta, gamma))
            if all(1e-6 <= v <= 1e6 for v in (a, b, c, alpha, beta, gamma)):
                cell = Cell.of_lengths(a, b, c, *(round(v, 9) for v in (alpha, beta, gamma))).h
        xyz = np.empty((n, 3))
        for k in range(3):
            values, at = _record(view, at)
            xyz[:, k] = np.frombuffer(values, "<f4", n)
        if has_4d:
            _, at = _record(view, at)
        yield {"xyz": xyz, "cell": cell}


def dcd_header(frames: int, atoms: int, cell: bool) -> bytes:
    flags = [0] * 20
    flags[0], flags[1], flags[2], flags[3], flags[10], flags[19] = frames, 0, 1, frames, int(cell), 24
    head = b"CORD" + struct.pack("<20i", *flags)
    title = struct.pack("<i", 1) + b"particle trajectory".ljust(80)
    return b"".join(struct.pack("<i", len(r)) + r + struct.pack("<i", len(r)) for r in (head, title, struct.pack("<i", atoms)))


def dcd_cell(cell: Cell) -> bytes:
    """The record of a frame's cell."""
    a, b, c, alpha, beta, gamma = cell.parameters
    return struct.pack("<i6di", 48, a, gamma, b, beta, alpha, c, 48)


def dcd_frame(xyz: np.ndarray, cell: Cell | None) -> bytes:
    parts = [np.ascontiguousarray(xyz[:, k], "<f4").tobytes() for k in range(3)]
    return (dcd_cell(cell) if cell else b"") + b"".join(struct.pack("<i", len(r)) + r + struct.pack("<i", len(r)) for r in parts)


# --- XTC ---------------------------------------------------------------------------------------

# Fixed values of the format: sizes of small differences.
MAGIC_INTS = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812,
    1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015,
    65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122,
    1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)
FIRST_SMALL = 9
XTC_MAGIC = 1995


class BitReader:
    """Big-endian bits; mixed-radix triples are stored with their low byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        end = self.at + n
        value = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end % 8)
        self.at = end
        return value & (1 << n) - 1

    def triple(self, n: int, sizes) -> tuple[int, int, int]:
        value, shift = 0, 0
        while n > 8:
            value |= self.bits(8) << shift
            n, shift = n - 8, shift + 8
        value |= self.bits(n) << shift
        value, z = divmod(value, sizes[2])
        x, y = divmod(value, sizes[1])
        return x, y, z


class BitWriter:
    def __init__(self):
        self.value, self.n, self.out = 0, 0, bytearray()

    def bits(self, value: int, n: int) -> None:
        self.value = self.value << n | value
        self.n += n
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.value >> self.n & 255)
        self.value &= (1 << self.n) - 1

    def triple(self, values, n: int, sizes) -> None:
        whole = (int(values[0]) * sizes[1] + int(values[1])) * sizes[2] + int(values[2])
        while n > 8:
            self.bits(whole & 255, 8)
            whole, n = whole >> 8, n - 8
        self.bits(whole, n)

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.value << 8 - self.n & 255]) if self.n else b"")



def _unpack_coordinates(reader: BitReader, n: int, low, high, small: int) -> np.ndarray:
    sizes = [h - l + 1 for l, h in zip(low, high, strict=True)]  # noqa: E741
    wide = any(s > 0xFFFFFF for s in sizes)
    each, joint = [s.bit_length() for s in sizes], 0 if wide else _bits_for(sizes)
    if any(s < 1 for s in sizes):
        raise ValueError("least and greatest coordinates are exchanged")
    out, i, run = np.empty((n, 3), np.int64), 0, 0
    while i < n:
        here = [reader.bits(b) for b in each] if wide else reader.triple(joint, sizes)
        here = [v + l for v, l in zip(here, low, strict=True)]  # noqa: E741
        change = 0
        if reader.bits(1):
            run = reader.bits(5)
            change = run % 3
            run -= change
            change -= 1
        if run // 3 > n - i - 1 or (run and not FIRST_SMALL <= small < len(MAGIC_INTS)):
            raise ValueError("a run does not fit the frame")
        at = i
        out[at] = here
        i += 1
        half, radix = MAGIC_INTS[small] // 2, [MAGIC_INTS[small]] * 3
        before = here
        for k in range(0, run, 3):
            delta = reader.triple(small, radix)
            here = [d + p - half for d, p in zip(delta, before, strict=True)]
            if k == 0:  # the first two atoms of a run are stored in exchanged order
                out[at], out[i] = here, before
            else:
                out[i] = before = here
            i += 1
        small += change
    return out


def _bits_for(sizes) -> int:
    """Bits of a joint triple: those of the product of the three sizes."""
    return (sizes[0] * sizes[1] * sizes[2]).bit_length()


def read_xtc(data: bytes) -> Iterator[dict]:
    """Frames of an XTC file, in angstrom."""
    at = 0
    while at < len(data):
        magic, n, step, time = struct.unpack_from(">3if", data, at)
        if magic != XTC_MAGIC:
            raise ValueError("not an XTC frame")
        box = np.frombuffer(data, ">f4", 9, at + 16).astype(float) * 10
        (stored,) = struct.unpack_from(">i", data, at + 52)
        at += 56
        if stored <= 9:
            xyz = np.frombuffer(data, ">f4", 3 * n, at).astype(float).reshape(n, 3) * 10
            at += 12 * n
        else:
            precision, *ints = struct.unpack_from(">f8i", data, at)
            low, high, small, size = ints[:3], ints[3:6], ints[6], ints[7]
            at += 36
            xyz = _unpack_coordinates(BitReader(data[at : at + size]), n, low, high, small) / precision * 10
            at += size + -size % 4
        cell = Cell(tuple(box))
        ok = box.any() and abs(np.linalg.det(box.reshape(3, 3))) > 1e-12 and all(1e-6 <= v <= 1e6 for v in cell.parameters)
        yield {"xyz": xyz, "cell": tuple(box) if ok else None, "step": step, "time": time}


def xtc_integers(xyz: np.ndarray, precision: float = 1000.0) -> np.ndarray:
    """Positions in angstrom as the integers that a frame stores."""
    return np.floor(xyz / 10 * precision + 0.5).astype(np.int64)


def xtc_width(low, high) -> int:
    """Bits of an atom in a frame without runs: its three numbers, and a bit that says that no run begins."""
    sizes = [h - l + 1 for l, h in zip(low, high, strict=True)]  # noqa: E741
    return (sum(s.bit_length() for s in sizes) if any(s > 0xFFFFFF for s in sizes) else _bits_for(sizes)) + 1


def xtc_block(ints: np.ndarray, low, high) -> bytes:
    """Consecutive atoms of a frame, all with as many bits: blocks of a multiple of eight atoms may be encoded apart and joined."""
    sizes = [int(h - l + 1) for l, h in zip(low, high, strict=True)]  # noqa: E741
    rest = ints - np.asarray(low, np.int64)
    if any(s > 0xFFFFFF for s in sizes):
        columns = [rest[:, k] >> b & 1 for k, s in enumerate(sizes) for b in range(s.bit_length() - 1, -1, -1)]
        bits = np.stack(columns, 1).astype(np.uint8)
    else:
        n = _bits_for(sizes)
        kind = np.int64 if n < 63 else object  # a joint number may pass 64 bits
        x, y, z = (rest[:, k].astype(kind) for k in range(3))
        whole = (x * sizes[1] + y) * sizes[2] + z
        last = (n - 1) // 8  # low byte first; the last has what bits are left
        each = np.stack([(whole >> 8 * j & 255).astype(np.uint8) for j in range(last + 1)], 1)
        bits = np.unpackbits(each, axis=1)
        bits = np.delete(bits, np.s_[8 * last : 8 * last + 8 - (n - 8 * last)], 1)
    return np.packbits(np.pad(bits, ((0, 0), (0, 1)))).tobytes()


def xtc_head(n: int, cell: Cell | None, step: int, low=(0, 0, 0), high=(0, 0, 0), time: float = 0.0, precision: float = 1000.0) -> tuple[bytes, bytes]:
    """What stands before the coordinates of a frame, and behind them."""
    box = np.array(cell.h if cell else [0.0] * 9) / 10
    out = struct.pack(">3if", XTC_MAGIC, n, step, time) + box.astype(">f4").tobytes() + struct.pack(">i", n)
    if n <= 9:
        return out, b""
    size = -(-n * xtc_width(low, high) // 8)
    return out + struct.pack(">f8i", precision, *low, *high, FIRST_SMALL, size), b"\0" * (-size % 4)


def xtc_frame(xyz: np.ndarray, cell: Cell | None, step: int, time: float = 0.0, precision: float = 1000.0) -> bytes:
    """One frame: raw up to nine atoms, else compressed without runs."""
    if len(xyz) <= 9:
        return xtc_head(len(xyz), cell, step, time=time)[0] + (xyz / 10).astype(">f4").tobytes()
    ints = xtc_integers(xyz, precision)
    low, high = ints.min(0).tolist(), ints.max(0).tolist()
    before, behind = xtc_head(len(xyz), cell, step, low, high, time, precision)
    return before + xtc_block(ints, low, high) + behind


READERS = {"xyz": read_xyz, "pdb": read_pdb, "dcd": read_dcd, "xtc": read_xtc}
