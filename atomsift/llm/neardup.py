"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample; every vector belongs to its nearest
cell and visits every other cell that may hold a vector it links with. A cell may
not if it lies beyond its radius and the angle of the bound, or if the vector is
further than that angle from the border between the two cells; both are exact, so
no link is missed, whatever the cells. Of two cells only one is visited by the
other. Equal vectors are one vector with a number of copies. Members and visitors
of a cell are dealt in blocks, one task for each pair of blocks, so a cell of any
size is compared completely.

Where directions are so many that the bounds cut nothing, all pairs are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

SAMPLE_ROWS = 1 << 14
CELL_ROWS = 1 << 13
LEAST_CELLS = 16
MOST_CELLS = 1 << 11
BLOCK = 1 << 13
BLOCK_VALUES = 1 << 19
STRIP_PAIRS = 1 << 22
SLACK = 1e-9


def unit(column) -> tuple[np.ndarray, list | np.ndarray]:
    """Row numbers and unit vectors of the usable rows of a list column."""
    if len(column) and not column.null_count:
        sizes, flat = np.unique(column.value_lengths().to_numpy()), column.flatten()
        if len(sizes) == 1 and sizes[0] and not flat.null_count:
            x = flat.to_numpy().reshape(len(column), sizes[0]).astype(float)
            top = np.abs(x).max(1)
            rows = np.flatnonzero((top > 0) & np.isfinite(top))
            x = x[rows] / top[rows, None]
            return rows, x / np.sqrt((x * x).sum(1, keepdims=True))
    rows, vectors = [], []
    for i, v in enumerate(column):
        v = v.as_py()
        if v is None or any(x is None for x in v):
            continue
        v = np.asarray(v, float)
        top = np.abs(v).max(initial=0.0)
        if top > 0 and np.isfinite(top):
            v = v / top
            rows.append(i)
            vectors.append(v / np.sqrt((v * v).sum()))
    return np.array(rows, np.int64), vectors


def fit_cells(sample: np.ndarray, cells: int, steps: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(steps):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _homes(centres):
    """Every vector with its own cell and its cosine to the cell's centroid."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("x")) @ centres.value.T
                cell = near.argmax(1)
                best = pa.array(near[np.arange(len(near)), cell])
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("cosine", best)

    return run


def visited(x: np.ndarray, own: np.ndarray, centres: np.ndarray, radius: np.ndarray, least: float) -> np.ndarray:
    """Which cells each vector has to visit for all links of at least ``least``, both directions; a cell of no radius is empty."""
    angle = np.arccos(np.clip(least, -1.0, 1.0))
    near = x @ centres.T
    there = np.arccos(np.clip(near, -1.0, 1.0)) <= radius + angle + SLACK
    if angle < np.pi / 2:
        apart = _apart(centres)[own]
        # the sine of the angle between a vector and the plane halfway between two centroids
        there &= near[np.arange(len(x)), own][:, None] - near <= (np.sin(angle) + SLACK) * apart + SLACK
    there[np.arange(len(x)), own] = False
    return there


def _apart(centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 0.0))


def _visits(cells, least: float, count: bool):
    """Members (``home``) and visitors of cells, or only how many there are."""

    def run(batches):
        centres, radius = cells.value
        number = np.arange(len(centres))
        for batch in batches:
            own = batch.column("cell").to_numpy()
            there = visited(_matrix(batch.column("x")), own, centres, radius, least) if len(own) else None
            if there is None:
                continue
            # of two cells, the lower one is visited if the sum of their numbers is even
            there &= (number < own[:, None]) == ((number + own[:, None]) % 2 == 0)
            for cell in number:
                for home, at in ((True, np.flatnonzero(own == cell)), (False, np.flatnonzero(there[:, cell]))):
                    if not len(at):
                        continue
                    size = 1 if count else len(at)
                    columns = [pa.array(np.full(size, cell, np.int32)), pa.array(np.full(size, home))]
                    if count:
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([len(at)], pa.int64())], ["cell", "home", "n"])
                    else:
                        names = ["node", "copies", "x"]
                        columns += [batch.column(name).take(pa.array(at)) for name in names]
                        yield pa.RecordBatch.from_arrays(columns, ["cell", "home", *names])

    return run


def _join(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component names (a row of each) after rows ``a`` and ``b`` are joined."""
    while True:
        apart = name[a] != name[b]
        if not apart.any():
            return name
        a, b = a[apart], b[apart]
        low, high = np.minimum(name[a], name[b]), np.maximum(name[a], name[b])
        np.minimum.at(name, high, low)
        while (name[name] != name).any():
            name = name[name]


def compare(copies: np.ndarray, side: np.ndarray, x: np.ndarray, least: float):
    """Links between two blocks, or inside one: linked copies of each row, and edges that connect what is linked."""
    links, name = np.zeros(len(x), np.int64), np.arange(len(x))
    one = side.min() == side.max()
    left = np.arange(len(x)) if one else np.flatnonzero(side == side.min())
    right = left if one else np.flatnonzero(side == side.max())
    x_left, x_right = x[left], x[right]
    step = max(1, STRIP_PAIRS // len(right))
    for start in range(0, len(left), step):
        first = start if one else 0
        near = x_left[start : start + step] @ x_right[first:].T >= least
        if one:
            near = np.triu(near, 1)
        if not near.any():
            continue
        a, b = np.nonzero(near)
        a, b = left[start + a], right[first + b]
        for here, other in ((a, b), (b, a)):
            links += np.bincount(here, copies[other], len(x)).astype(np.int64)
        name = _join(name, a, b)
    joined = np.flatnonzero(name != np.arange(len(name)))
    return links, joined, name[joined]


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        links, a, b = compare(copies, table["side"].to_numpy(), _matrix(table["x"].combine_chunks()), least)
        some = np.flatnonzero(links)
        nothing = pa.nulls(len(some), pa.int64())
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[some], node[a]])),
                "b": pa.concat_arrays([nothing, pa.array(node[b])]),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Two vectors link if their cosine, in double precision, is at least ``least``.
    ``n_links`` counts the other rows a row links with directly, ``component_id``
    is the smallest id reachable over links, and the row with that id is kept.

    Vectors that are null, empty, zero or hold null or non-finite values link with
    nothing and are kept; so do vectors of another width than the first usable
    row's (by id). Equal vectors link with each other. Ids should be unique; rows
    with null ids link nothing. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))

    def usable(batches):
        for batch in batches:
            at, x = unit(batch.column("x"))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array(list(x), pa.list_(pa.float64()))],
                    ["vec_id", "x"],
                )

    good = scratch.keep(rows.where("vec_id IS NOT NULL").mapInArrow(usable, "vec_id long, x array<double>"), "units")
    first = good.agg(F.min_by(F.size("x"), "vec_id").alias("width"), F.count("*").alias("rows")).first()
    answer = rows.select("vec_id")
    if not first["rows"]:
        return answer.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                             F.lit(True).alias("kept"))
    good = good.where(F.size("x") == first["width"])
    groups = good.groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    groups = scratch.keep(groups, "distinct")
    sample = groups.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("x").toArrow()["x"].combine_chunks()
    sample = sample.flatten().to_numpy().reshape(len(sample), -1)
    cells = max(LEAST_CELLS, first["rows"] // CELL_ROWS)
    centres = fit_cells(sample, int(np.clip(cells, 1, min(MOST_CELLS, len(sample)))))  # MOST_CELLS vectors at most
    homes = groups.select("node", "copies", "x").mapInArrow(
        _homes(spark.sparkContext.broadcast(centres)), "node long, copies long, x array<double>, cell int, cosine double"
    )
    homes = scratch.keep(homes, "homes")
    radius = np.full(len(centres), -np.inf)
    for r in homes.groupBy("cell").agg(F.min("cosine").alias("least")).collect():
        radius[r["cell"]] = np.arccos(np.clip(r["least"], -1.0, 1.0))
    bounds = spark.sparkContext.broadcast((centres, radius))
    counts = homes.mapInArrow(_visits(bounds, least, True), "cell int, home boolean, n long")
    block = max(1, min(BLOCK, BLOCK_VALUES // first["width"]))
    blocks = lambda home: F.ceil(F.sum(F.when(F.col("home") == home, F.col("n")).otherwise(0)) / block).cast("int")
    sizes = counts.groupBy("cell").agg(blocks(True).alias("members"), blocks(False).alias("visitors"))
    sizes = F.broadcast(sizes)  # a row for each of at most MOST_CELLS cells
    placed = homes.mapInArrow(
        _visits(bounds, least, False), "cell int, home boolean, node long, copies long, x array<double>"
    )
    # blocks of members come first, then blocks of visitors; visitors are not compared with each other
    dealt = placed.join(sizes, "cell").withColumn("hash", F.xxhash64("node")).withColumn(
        "side",
        F.when(F.col("home"), F.pmod("hash", "members")).otherwise(F.col("members") + F.pmod("hash", "visitors")).cast("int"),
    )
    last = F.col("members") - 1 + F.when(F.col("home"), F.col("visitors")).otherwise(0)
    dealt = dealt.where("members > 0").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    dealt = dealt.select("cell", "i", "j", "node", "copies", "side", "x")
    made = dealt.groupBy("cell", "i", "j").applyInArrow(_compare(least), "a long, b long, links long")
    made = scratch.keep(made, "links")
    scratch.drop(homes)
    links = made.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("linked"))
    components = connected_components(made.where("b IS NOT NULL"), scratch)
    per_node = groups.select("node", "copies", "x").join(links, "node", "left")
    per_node = per_node.join(components.withColumnRenamed("id", "node"), "node", "left").select(
        "x",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    found = good.join(per_node, "x").select("vec_id", "n_links", "component_id")
    return answer.join(found, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
