"""Hand-made structure files."""

from __future__ import annotations

import numpy as np


def water_xyz(frames: int = 7, seed: int = 0, forces: bool = True) -> str:
    rng = np.random.default_rng(seed)
    out = []
    for t in range(frames):
        pos = np.array([[0.1, 0.2, 0.3], [0.9, 0.4, 0.1], [4.8, 0.6, 4.9]]) + rng.normal(0, 0.05, (3, 3))
        extra = ":forces:R:3" if forces else ""
        head = f'Lattice="5.0 0 0 0 5.0 0 0 0 5.0" Properties=species:S:1:pos:R:3:move_mask:L:1{extra} energy={-10 - t / 8} pbc="T T T"'
        lines = ["3", head]
        for s, p, mask in zip("OHH", pos, "FTT"):
            f = " ".join(f"{v:.6f}" for v in rng.normal(0, 1, 3)) if forces else ""
            lines.append(f"{s} " + " ".join(f"{v:.8f}" for v in p) + f" {mask} {f}".rstrip())
        out.append("\n".join(lines))
    return "\n".join(out) + "\n"


def plain_xyz(counts=(2, 1, 3)) -> str:
    """No cell, comments that look like counts or are empty."""
    comments = ["12", "", "free text with many words here"]
    out = []
    for n, c in zip(counts, comments):
        out += [str(n), c] + [f"C {i}.0 0.5 {n}.25" for i in range(n)]
    return "\n".join(out) + "\n"


def xdatcar(frames: int = 4, variable: bool = False) -> str:
    out = []

    def header(scale):
        return ["slab", f"{scale}", "4 0 0", "0 4 0", "0 0 8", "Cu O", "2 1"]

    out += [] if variable else header(1.0)
    for t in range(frames):
        out += header(1.0 + t) if variable else []
        out.append(f"Direct configuration=  {t + 1}")
        out += [f"0.{t}00 0.0 0.0", "0.5 0.5 0.5", "0.25 0.25 0.75"]
    return "\n".join(out) + "\n"


def vasprun(steps: int = 3) -> str:
    calcs = []
    for t in range(steps):
        calcs.append(
            f"""<calculation>
 <scstep><energy><i name="e_fr_energy">-9.0</i><i name="e_wo_entrp">-8.8</i><i name="e_0_energy">-8.9</i></energy></scstep>
 <structure><crystal><varray name="basis"><v>2 0 0</v><v>0 3 0</v><v>0 0 4</v></varray></crystal>
 <varray name="positions"><v>0.0 0.0 0.{t}</v><v>0.5 0.5 0.5</v></varray></structure>
 <varray name="forces"><v>{t}.5 0 0</v><v>-{t}.5 0 0</v></varray>
 <energy><i name="e_fr_energy">{-9 - t}.0</i><i name="e_0_energy">{-9 - t}.0</i></energy>
</calculation>"""
        )
    return (
        '<?xml version="1.0" encoding="ISO-8859-1"?>\n<modeling>\n<atominfo><atoms>2</atoms>'
        '<array name="atoms"><set><rc><c>Fe</c><c>1</c></rc><rc><c>O </c><c>2</c></rc></set></array></atominfo>\n'
        '<structure name="initialpos"><varray name="selective"><v type="logical">F F F</v>'
        '<v type="logical">T T T</v></varray></structure>\n' + "\n".join(calcs) + "\n</modeling>\n"
    )
