"""Dependency order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.materialise import cut


def layers(items: DataFrame, needs: DataFrame) -> DataFrame:
    """atom_id, layer: 0 for what needs nothing, else one more than the highest that it needs; atoms on a cycle, or that need one, get null.

    Peels one layer a round, a join and an anti-join over what is left, until a round peels nothing; so
    chains of any length get their layers, and only cycles are left.
    """
    rest, arcs, done = cut(items.select("atom_id")), cut(needs.join(items.select(F.col("atom_id").alias("needs")), "needs", "left_semi")), None
    layer = 0
    while True:
        free = cut(rest.join(arcs.select("atom_id").distinct(), "atom_id", "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            break
        # Written every few layers, so that the plan doesn't grow with the chain.
        done = free if done is None else done.unionByName(free)
        if layer % 20 == 19:
            done = cut(done)
        rest = cut(rest.join(free, "atom_id", "left_anti"))
        arcs = cut(arcs.join(free.select(F.col("atom_id").alias("needs")), "needs", "left_anti"))
        layer += 1
    stuck = rest.withColumn("layer", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)
