"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of ``edges``; component is its smallest node.

    Every round lets each node point at its smallest neighbour if that is
    smaller, follows the pointers a few times, and renames both ends of every
    edge. Pointers only go down, so the last name is the smallest node. Rounds
    shrink the graph at least by half; stars vanish in the first one. Sums per
    node are pre-aggregated, so a hub costs no more than other nodes, and all
    tables are written to the shared folder.

    Null ends and self-loops are ignored; an empty table gives an empty table.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    pairs = scratch.keep(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    names = None
    while not pairs.isEmpty():
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(
            pairs.select(F.col("b").alias("id"), F.col("a").alias("other"))
        )
        near = both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("to"))
        near = step = scratch.keep(near, "near")
        for _ in range(2):
            onward = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            step = step.join(onward, "to").select("id", F.col("next").alias("to"))
        step = scratch.keep(step, "step")
        rename_a = step.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        rename_b = step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        renamed = pairs.join(rename_a, "a").join(rename_b, "b").where("ta <> tb")
        left = scratch.keep(
            renamed.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct(), "edges"
        )
        scratch.drop(near, pairs)
        pairs = left
        if names is None:
            named = step.withColumnRenamed("to", "component")
        else:
            moved = step.select(F.col("id").alias("component"), "to")
            named = names.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        before, names = names, scratch.keep(named, "names")
        scratch.drop(step, *([] if before is None else [before]))
    scratch.drop(pairs)
    return scratch.spark.createDataFrame([], "id long, component long") if names is None else names
