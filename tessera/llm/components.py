"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``id, comp`` for every document in ``links(a, b)``; comp is the smallest id that it reaches.

    Labels take the least label among their neighbours and then the label of their label, until nothing changes; the
    second step halves the length of chains, so rounds grow with the logarithm of the longest path.
    """
    edges = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"edges_{name}")
    labels = scratch.save(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), f"labels_{name}_0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        least = labels.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        least = scratch.save(least, f"least_{name}_{turn}")
        jumped = least.join(least.select(F.col("id").alias("next"), F.col("next").alias("further")), "next", "left")
        new = scratch.save(jumped.select("id", F.least("next", F.coalesce("further", "next")).alias("comp"), "old"), f"labels_{name}_{turn}")
        scratch.drop(f"least_{name}_{turn}")
        scratch.drop(f"labels_{name}_{turn - 1}")
        labels = new.select("id", "comp")
        if not new.where("comp < old").limit(1).count():
            return labels
