"""Frames to structure files, as ordered part files written in parallel."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.export import describe
from .files import file_system
from .formats import SYMBOLS, ULM_MAGIC


def _number(v: Column, form: str = "%.8f") -> Column:
    return F.format_string(form, v)


def _join(parts: Sequence[Column], sep: str = " ") -> Column:
    return F.concat_ws(sep, *parts)


def extxyz_text(with_forces: bool, with_mask: bool = True) -> Column:
    """One frame (cell, pbc, energy, atoms) as extended XYZ text."""
    cell = F.col("cell")
    lattice = F.when(
        cell.isNotNull(),
        F.concat(
            F.lit('Lattice="'),
            _join([_number(cell[i][j]) for i in range(3) for j in range(3)]),
            F.lit('" '),
        ),
    ).otherwise("")
    layout = "species:S:1:pos:R:3" + (":move_mask:L:1" if with_mask else "") + (":forces:R:3" if with_forces else "")
    energy = F.when(F.col("energy").isNotNull(), F.concat(F.lit(" energy="), F.col("energy").cast("string"))).otherwise("")
    pbc = F.concat(F.lit(' pbc="'), _join([F.when(F.col("pbc")[i], "T").otherwise("F") for i in range(3)]), F.lit('"'))
    head = F.concat(lattice, F.lit(f"Properties={layout}"), energy, pbc)

    def line(a: Column) -> Column:
        parts = [F.rpad(a["symbol"], 2, " "), *[_number(a["pos"][i], "%16.8f") for i in range(3)]]
        if with_mask:
            parts.append(F.when(a["is_fixed"], "F").otherwise("T"))
        if with_forces:
            parts += [_number(a["force"][i], "%16.8f") for i in range(3)]
        return _join(parts)

    return F.concat_ws("\n", F.size("atoms").cast("string"), head, F.array_join(F.transform("atoms", line), "\n"))


def _has_forces() -> Column:
    return F.forall("atoms", lambda a: a["force"].isNotNull())


def write_extxyz(frames: DataFrame, path: str, order_by: Sequence[str] = ("file_path", "source_struct_id")) -> str:
    """Part files in ``order_by`` order; together they are the merged file."""
    text = F.when(_has_forces(), extxyz_text(True)).otherwise(extxyz_text(False))
    frames.orderBy(*order_by).select(text.alias("value")).write.mode("overwrite").text(path)
    return path


def fractional(cell: Column, pos: Column) -> list[Column]:
    """Coordinates along the lattice vectors."""
    a = [cell[i] for i in range(3)]
    out = []
    for i in range(3):
        u, v = a[(i + 1) % 3], a[(i + 2) % 3]
        normal = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        span = sum((normal[j] * a[i][j] for j in range(1, 3)), normal[0] * a[i][0])
        out.append(sum((normal[j] * pos[j] for j in range(1, 3)), normal[0] * pos[0]) / span)
    return out


def species_sequence() -> Column:
    return F.array_join(F.transform("atoms", lambda a: a["symbol"]), " ")


def _runs(symbols: Column) -> Column:
    """ARRAY<STRUCT<symbol, n>> of consecutive equal symbols."""
    empty = F.array().cast("array<struct<symbol:string,n:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (F.size(acc) > 0) & (last["symbol"] == s)
        grown = F.concat(
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(last["symbol"].alias("symbol"), (last["n"] + 1).alias("n"))),
        )
        return F.when(same, grown).otherwise(F.concat(acc, F.array(F.struct(s.alias("symbol"), F.lit(1).alias("n")))))

    return F.aggregate(symbols, empty, step)


def xdatcar_text(number: Column) -> Column:
    """One frame with its own header, as variable-cell XDATCAR files have it."""
    cell = F.col("cell")
    runs = _runs(F.transform("atoms", lambda a: a["symbol"]))
    header = F.concat_ws(
        "\n",
        F.array_join(F.transform(runs, lambda r: r["symbol"]), " "),
        F.lit("1.0"),
        *[_join([_number(cell[i][j], "%.10f") for j in range(3)]) for i in range(3)],
        F.array_join(F.transform(runs, lambda r: r["symbol"]), " "),
        F.array_join(F.transform(runs, lambda r: r["n"].cast("string")), " "),
    )
    rows = F.transform("atoms", lambda a: _join([_number(f, "%.10f") for f in fractional(F.col("cell"), a["pos"])]))
    return F.concat_ws(
        "\n", header, F.concat(F.lit("Direct configuration= "), number.cast("string")), F.array_join(rows, "\n")
    )


def one_species_sequence(frames: DataFrame) -> bool:
    """XDATCAR needs the same ordered species in every frame; false for no frames."""
    seen = frames.select(F.when(F.col("cell").isNotNull(), species_sequence()).alias("s")).distinct().limit(2).collect()
    return len(seen) == 1 and seen[0]["s"] is not None


def write_xdatcar(frames: DataFrame, path: str, order_by: Sequence[str] = ("file_path", "source_struct_id")) -> str:
    number = F.col("source_struct_id") + 1
    frames.orderBy(*order_by).select(xdatcar_text(number).alias("value")).write.mode("overwrite").text(path)
    return path


def _folder_name(value: str) -> str:
    """How a partition value is written in a folder's name."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def write_xdatcar_per_file(frames: DataFrame, path: str) -> dict[str, str]:
    """A folder for every source file whose frames agree in species, by the file's stem.

    Files of one stem are told apart by their ``file_id``.
    """
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", ""), r"\.xml", "")
    named = frames.withColumn("stem", stem)
    agree = (
        named.select("file_id", "stem", F.when(F.col("cell").isNotNull(), species_sequence()).alias("s"))
        .groupBy("file_id", "stem")
        .agg(F.count_distinct("s").alias("n"), F.bool_or(F.col("s").isNull()).alias("bad"))
        .filter("n = 1 AND NOT bad")
        .select("file_id", "stem")
    )
    (
        named.join(agree, ["file_id", "stem"], "left_semi")
        .repartitionByRange("file_id", "pos")
        .sortWithinPartitions("file_id", "pos")
        .select("file_id", "stem", xdatcar_text(F.col("source_struct_id") + 1).alias("value"))
        .write.mode("overwrite")
        .partitionBy("file_id", "stem")
        .text(path)
    )
    files = agree.orderBy("file_id").collect()  # a row for each exported file
    out: dict[str, str] = {}
    for row in files:
        name = row["stem"] if row["stem"] not in out else f"{row['stem']}#{row['file_id']}"
        out[name] = f"{path}/file_id={row['file_id']}/stem={_folder_name(row['stem'])}"
    return out


def _write_ulm(path: str, frames: list[dict]) -> None:
    system, inner = file_system(path)
    body, offsets = bytearray(48), []

    def put(array: np.ndarray) -> dict:
        pad = -len(body) % 8
        body.extend(b"\0" * pad)
        at = len(body)
        body.extend(np.ascontiguousarray(array).astype(array.dtype.newbyteorder("<")).tobytes())
        return {"ndarray": [list(array.shape), array.dtype.name, at]}

    for frame in frames:
        atoms = frame["atoms"]
        fixed = [a["atom_id"] for a in atoms if a["is_fixed"]]
        constraints = [{"name": "FixAtoms", "kwargs": {"indices": fixed}}] if fixed else []
        item = {
            "version": 1,
            "pbc": frame["pbc"],
            "cell": frame["cell"] or [[0.0] * 3] * 3,
            "numbers.": put(np.array([SYMBOLS.index(a["symbol"]) for a in atoms], dtype=np.int64)),
            "positions.": put(np.array([a["pos"] for a in atoms], dtype=float).reshape(len(atoms), 3)),
            "constraints": json.dumps(constraints),
        }
        results = {} if frame["energy"] is None else {"energy": frame["energy"]}
        if atoms and all(a["force"] is not None for a in atoms):
            results["forces."] = put(np.array([a["force"] for a in atoms], dtype=float))
        if results:
            item["calculator."] = {"name": "unknown", **results}
        text = json.dumps(item).encode()
        body.extend(b"\0" * (-len(body) % 8))
        offsets.append(len(body))
        body.extend(np.array([len(text)], dtype="<i8").tobytes() + text)
    body.extend(b"\0" * (-len(body) % 8))
    table = len(body)
    body.extend(np.array(offsets, dtype="<i8").tobytes())
    body[:48] = ULM_MAGIC + b"ASE-Trajectory".ljust(16) + np.array([3, len(offsets), table], dtype="<i8").tobytes()
    with system.open_output_stream(inner) as out:
        out.write(bytes(body))


# A part file is built in memory, so it is closed after this many atoms.
TRAJ_PART_ATOMS = 500_000


def write_traj(frames: DataFrame, path: str, order_by: Sequence[str] = ("file_path", "source_struct_id")) -> str:
    """Binary trajectory parts ``part-NNNNN-MMMM.traj`` in order; a retry rewrites its parts."""
    system, inner = file_system(path)
    system.create_dir(inner, recursive=True)
    for info in system.get_file_info(fs.FileSelector(inner)):
        if info.base_name.endswith(".traj"):
            system.delete_file(info.path)

    def save(batches):
        from pyspark import TaskContext

        task, part, pending, atoms = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal part, pending, atoms
            _write_ulm(f"{path}/part-{task:05d}-{part:04d}.traj", pending)
            done = len(pending)
            part, pending, atoms = part + 1, [], 0
            return pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

        for batch in batches:
            for frame in batch.to_pylist():
                pending.append(frame)
                atoms += len(frame["atoms"])
                if atoms >= TRAJ_PART_ATOMS:
                    yield flush()
        if pending:
            yield flush()

    ordered = frames.orderBy(*order_by).select("cell", "pbc", "energy", "atoms")
    ordered.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()
    return path


def export_manifest(frames: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The requested ``columns`` of frames in ``pos`` order with n_atoms, formula and ordered species."""
    described = describe(frames, F.transform("atoms", lambda a: a["symbol"])).orderBy("pos")
    return described.select(*columns, "n_atoms", "formula", "species_sequence")


def split_manifest(frames: DataFrame, index: str = "index") -> DataFrame:
    """index, natoms, cell lengths, pbc and energy of split frames, as text lines."""

    def length(i: int) -> Column:
        row = F.col("cell")[i]
        return F.sqrt(row[0] * row[0] + row[1] * row[1] + row[2] * row[2])

    flag = [F.when(F.col("pbc")[i], "True").otherwise("False") for i in range(3)]
    return frames.select(
        F.col(index).alias("index"),
        F.concat_ws(
            "\t",
            F.col(index).cast("string"),
            F.size("atoms").cast("string"),
            *[F.format_string("%.6f", F.coalesce(length(i), F.lit(0.0))) for i in range(3)],
            F.concat(F.lit("("), F.concat_ws(", ", *flag), F.lit(")")),
            F.coalesce(F.col("energy").cast("string"), F.lit("")),
        ).alias("line"),
    )


def write_split_manifest(frames: DataFrame, path: str, header: dict[str, object], title: str, index: str = "index") -> str:
    """Tab-separated manifest below ``#`` lines, ordered by index."""
    lines = [f"# {title}", *[f"# {k}: {v}" for k, v in header.items()], ""]
    lines.append("\t".join(["index", "natoms", "cell_a", "cell_b", "cell_c", "pbc", "energy"]))
    head = frames.sparkSession.createDataFrame([(-1, "\n".join(lines))], "index bigint, line string")
    body = split_manifest(frames, index).withColumn("index", F.col("index").cast("bigint"))
    head.unionByName(body).orderBy("index").select("line").write.mode("overwrite").text(path)
    return path
