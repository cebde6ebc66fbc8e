"""Frame parsers for one byte range of a structure file.

Every format yields one item per frame that starts inside [start, end), so a
large file is read by many tasks: the parsed frame, a dict with the fields of
``schemas.FRAME``, where ``want(i)`` holds for the i-th start, else None.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import numpy as np

# Bytes looked at before a range, enough to see the line or header before it.
LOOK_BACK = 1 << 20
BLOCK = 4 << 20

Frames = Iterator[dict | None]
Want = Callable[[int], bool]

# Chemical symbols by atomic number, starting with the dummy X.
SYMBOLS = (
    "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def make_frame(symbols, positions, cell, pbc, energy=None, forces=None, fixed=None) -> dict:
    atoms = []
    for i, (s, p) in enumerate(zip(symbols, positions)):
        atoms.append(
            {
                "atom_id": i,
                "symbol": s,
                "pos": [float(v) for v in p],
                "force": None if forces is None else [float(v) for v in forces[i]],
                "is_fixed": bool(fixed[i]) if fixed is not None else False,
            }
        )
    return {
        "cell": None if cell is None else [[float(v) for v in row] for row in cell],
        "pbc": [bool(v) for v in pbc],
        "energy": None if energy is None else float(energy),
        "atoms": atoms,
    }


def _lines_from(f, start: int) -> tuple[bytes, int]:
    """(text of the line before the first whole line at or after start, its offset)."""
    back = max(0, start - LOOK_BACK)
    f.seek(back)
    head = f.read(start - back)
    if start and not head.endswith(b"\n"):
        head += f.readline()
    previous = head.rstrip(b"\n").rsplit(b"\n", 1)[-1] if head else b""
    return previous, back + len(head)


# ---------------------------------------------------------------- extended XYZ

_PAIR = re.compile(r'([A-Za-z_][\w-]*)\s*=\s*("[^"]*"|\'[^\']*\'|\{[^}]*\}|\S+)')


def _is_count(line: bytes) -> bool:
    return line.strip().isdigit()


def _flag(text: str) -> bool:
    return text.upper() in ("T", "TRUE", "1")


def parse_xyz(comment: str, rows: list[list[str]]) -> dict:
    info = {k.lower(): v.strip("\"'{}") for k, v in _PAIR.findall(comment)}
    cell = pbc = None
    if "lattice" in info:
        cell = np.array(info["lattice"].split(), dtype=float).reshape(3, 3)
    if "pbc" in info:
        pbc = [_flag(v) for v in info["pbc"].split()]
    layout = info.get("properties", "species:S:1:pos:R:3").split(":")
    columns, at = {}, 0
    for name, kind, count in zip(layout[0::3], layout[1::3], layout[2::3]):
        columns[name.lower()] = (at, int(count), kind)
        at += int(count)

    def block(name):
        if name not in columns:
            return None
        first, count, _ = columns[name]
        return [[float(v) for v in r[first : first + count]] for r in rows]

    species = columns.get("species", (0, 1, "S"))[0]
    forces = block("forces") if "forces" in columns else block("force")
    fixed = None
    if "move_mask" in columns:
        first, count, _ = columns["move_mask"]
        # Constrained along any direction counts as fixed.
        fixed = [not all(_flag(v) for v in r[first : first + count]) for r in rows]
    return make_frame(
        [r[species] for r in rows],
        block("pos"),
        cell,
        pbc if pbc is not None else [cell is not None] * 3,
        info.get("energy"),
        forces,
        fixed,
    )


def xyz_frames(f, start: int, end: int, want: Want) -> Frames:
    """A count line starts a frame if the line before is an atom line or none.

    The comment line, which may be a number too, always follows a count line.
    """
    previous, at = _lines_from(f, start)
    synced, seen = at == 0, 0
    while at < end:
        f.seek(at)
        line = f.readline()
        if not line:
            return
        if not _is_count(line) or not (synced or len(previous.split()) >= 4 or not previous.strip()):
            previous, at, synced = line, at + len(line), False
            continue
        count, comment = int(line), f.readline()
        body = [f.readline() for _ in range(count)]
        if len(body) < count or (count and not body[-1]):
            raise ValueError(f"truncated frame at byte {at}")
        yield parse_xyz(comment.decode(), [b.decode().split() for b in body]) if want(seen) else None
        seen += 1
        at += len(line) + len(comment) + sum(map(len, body))
        previous, synced = (body[-1] if body else comment), True


# ---------------------------------------------------------------- XDATCAR


def _is_marker(line: bytes) -> bool:
    return line.lstrip().lower().startswith((b"direct", b"cartesian"))


def _vasp_header(lines: list[bytes]):
    scale = float(lines[1].split()[0])
    cell = np.array([l.split()[:3] for l in lines[2:5]], dtype=float)
    if scale < 0:  # a negative scale is the wanted volume
        scale = (-scale / abs(np.linalg.det(cell))) ** (1.0 / 3.0)
    names, counts = lines[5].decode().split(), [int(v) for v in lines[6].split()]
    return cell * scale, [s for s, n in zip(names, counts) for _ in range(n)]


def _all_integers(line: bytes) -> bool:
    parts = line.split()
    return bool(parts) and all(p.isdigit() for p in parts)


def xdatcar_frames(f, start: int, end: int, want: Want) -> Frames:
    """Frames begin at their ``Direct configuration`` line; a header may repeat before it."""
    f.seek(0)
    header = [f.readline() for _ in range(7)]
    _, at = _lines_from(f, start)
    recent: list[bytes] = []
    seen = 0
    if at:
        back = max(0, at - LOOK_BACK)
        f.seek(back)
        recent = f.read(at - back).splitlines(keepends=True)[-7:]
    while at < end:
        f.seek(at)
        line = f.readline()
        if not line:
            return
        if not _is_marker(line):
            recent = [*recent[-6:], line]
            at += len(line)
            continue
        if len(recent) == 7 and _all_integers(recent[-1]):
            header = recent
        cell, symbols = _vasp_header(header)
        body = [f.readline() for _ in symbols]
        frame = None
        if want(seen):
            scaled = np.array([b.split()[:3] for b in body], dtype=float)
            direct = not line.lstrip().lower().startswith(b"cartesian")
            frame = make_frame(symbols, scaled @ cell if direct else scaled, cell, [True] * 3)
        yield frame
        seen += 1
        at += len(line) + sum(map(len, body))
        recent = body[-7:]


# ---------------------------------------------------------------- vasprun.xml


def _read_until(f, mark: bytes) -> bytes:
    f.seek(0)
    data = b""
    while mark not in data:
        block = f.read(BLOCK)
        if not block:
            break
        data += block
    return data[: data.find(mark) + len(mark)]


def _rows(node) -> np.ndarray:
    return np.array([v.text.split() for v in node.findall("v")], dtype=float)


def _vasprun_header(f) -> tuple[list[str], list[bool] | None]:
    text = _read_until(f, b"</atominfo>")
    info = ET.fromstring(text[text.rfind(b"<atominfo") :])
    table = next(a for a in info.findall("array") if a.get("name") == "atoms")
    symbols = [rc.find("c").text.strip() for rc in table.find("set").findall("rc")]
    head = _read_until(f, b"<calculation")
    fixed = None
    found = re.search(rb'<varray name="selective"\s*>(.*?)</varray>', head, re.S)
    if found:
        flags = re.findall(rb"<v[^>]*>([^<]*)</v>", found.group(1))
        fixed = [not all(_flag(v) for v in row.decode().split()) for row in flags]
    return ["X" if s == "r" else s for s in symbols], fixed


def _named(node, path: str, name: str):
    return next((i for i in node.findall(path) if i.get("name") == name), None)


def parse_calculation(text: bytes, symbols: list[str], fixed) -> dict:
    calc = ET.fromstring(text)
    structure = calc.find("structure")
    cell = _rows(_named(structure, "crystal/varray", "basis"))
    positions = _rows(_named(structure, "varray", "positions")) @ cell
    forces = _named(calc, "varray", "forces")
    energy = None
    total = calc.find("energy")
    if total is not None:
        free, zero = _named(total, "i", "e_fr_energy"), _named(total, "i", "e_0_energy")
        steps = calc.findall("scstep")
        last = steps[-1].find("energy") if steps else None
        if free is not None and last is not None and _named(last, "i", "e_0_energy") is not None:
            # The closing block repeats the free energy; the last electronic
            # step carries the entropy correction to zero smearing.
            gap = float(_named(last, "i", "e_0_energy").text) - float(_named(last, "i", "e_fr_energy").text)
            energy = float(free.text) + gap
        elif zero is not None:
            energy = float(zero.text)
        elif free is not None:
            energy = float(free.text)
    return make_frame(
        symbols, positions, cell, [True] * 3, energy, None if forces is None else _rows(forces), fixed
    )


def vasprun_frames(f, start: int, end: int, want: Want) -> Frames:
    header, seen = None, 0
    opening, closing = b"<calculation", b"</calculation>"
    f.seek(start)
    data, base, at = f.read(BLOCK), start, 0

    def more() -> bool:
        nonlocal data
        block = f.read(BLOCK)
        data += block
        return bool(block)

    while True:
        found = data.find(opening, at)
        if found < 0:
            if base + len(data) - len(opening) >= end or not more():
                return
            keep = max(at, 0)
            data, base, at = data[keep:], base + keep, 0
            continue
        if base + found >= end:
            return
        wanted = want(seen)
        seen += 1
        if not wanted:
            yield None
            at = found + len(opening)
            continue
        if header is None:
            resume = f.tell()
            header = _vasprun_header(f)
            f.seek(resume)
        stop = data.find(closing, found)
        while stop < 0:
            if not more():
                raise ValueError(f"calculation at byte {base + found} has no end; the run may still be writing it")
            stop = data.find(closing, found)
        stop += len(closing)
        yield parse_calculation(data[found:stop], *header)
        data, base, at = data[stop:], base + stop, 0


# ---------------------------------------------------------------- binary trajectory

ULM_MAGIC = b"- of Ulm"


def ulm_offsets(f) -> np.ndarray:
    f.seek(0)
    if f.read(8) != ULM_MAGIC:
        raise ValueError("not a binary trajectory")
    f.read(16)
    _, items, table = np.frombuffer(f.read(24), dtype="<i8")
    f.seek(int(table))
    return np.frombuffer(f.read(8 * int(items)), dtype="<i8")


def ulm_item(f, offset: int) -> dict:
    f.seek(int(offset))
    length = int(np.frombuffer(f.read(8), dtype="<i8")[0])
    tree = json.loads(f.read(length))

    def resolve(node):
        out = {}
        for key, value in node.items():
            if key.endswith(".") and isinstance(value, dict):
                if "ndarray" in value:
                    shape, dtype, where = value["ndarray"]
                    kind = np.dtype(dtype).newbyteorder("<")
                    f.seek(int(where))
                    raw = f.read(int(np.prod(shape, dtype=int)) * kind.itemsize)
                    out[key[:-1]] = np.frombuffer(raw, dtype=kind).reshape(shape)
                else:
                    out[key[:-1]] = resolve(value)
            elif isinstance(value, dict) and "__ndarray__" in value:
                shape, dtype, flat = value["__ndarray__"]
                out[key] = np.array(flat, dtype=dtype).reshape(shape)
            else:
                out[key] = value
        return out

    return resolve(tree)


def fixed_from_constraints(text, count: int) -> list[bool]:
    fixed = [False] * count
    for c in json.loads(text) if isinstance(text, str) else (text or []):
        kwargs = c.get("kwargs", {})
        indices = kwargs.get("indices", kwargs.get("a", kwargs.get("index", [])))
        for i in indices if isinstance(indices, list) else [indices]:
            fixed[int(i)] = True
    return fixed


def traj_frames(f, start: int, end: int, want: Want) -> Frames:
    """Items by offset; numbers, pbc and constraints may be stated only in the first."""
    offsets = ulm_offsets(f)
    if not len(offsets):
        return
    first = None
    for seen, offset in enumerate(o for o in offsets if start <= o < end):
        if not want(seen):
            yield None
            continue
        first = first or ulm_item(f, offsets[0])
        own = ulm_item(f, offset)
        item = {**first, "calculator": {}, **own}
        numbers = np.asarray(item["numbers"])
        results = item.get("calculator", {})
        cell = np.asarray(item["cell"], dtype=float)
        cell = np.diag(cell) if cell.ndim == 1 else cell
        yield make_frame(
            [SYMBOLS[n] for n in numbers],
            item["positions"],
            cell if np.any(cell) else None,
            item.get("pbc", [False] * 3),
            results.get("energy"),
            results.get("forces"),
            fixed_from_constraints(item.get("constraints"), len(numbers)),
        )


READERS = {"xyz": xyz_frames, "xdatcar": xdatcar_frames, "vasprun": vasprun_frames, "traj": traj_frames}


def format_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".xml"):
        return "vasprun"
    if name.endswith((".xyz", ".extxyz")):
        return "xyz"
    if name.endswith(".traj"):
        return "traj"
    if "XDATCAR" in name:
        return "xdatcar"
    raise ValueError(f"unknown structure file type: {path}")
