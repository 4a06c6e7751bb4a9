"""Connected components of links, kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylog.session import materialise


def follow(pointers: DataFrame) -> DataFrame:
    """``node, root`` for a forest ``node, root`` whose pointers go to smaller numbers: each node's last pointer.

    Doubling: the number of joins is the logarithm of the longest chain.
    """
    while True:
        upper = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        longer = materialise(pointers.join(upper, "root", "left").select("node", F.coalesce("_next", "root").alias("root"), F.col("_next") < F.col("root")).toDF("node", "root", "moved"))
        pointers = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``links`` (two columns of ids): the smallest node that links lead to.

    Every node points to its smallest neighbour if that is smaller; pointers are followed to their ends, links are
    carried over to these ends, and what is left starts again. Each turn at least halves the nodes that have links.
    Links and labels stay in tables of the shared folder; only the answer to "any left?" comes to the driver.
    """
    u, v = links.columns
    links = materialise(links.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u != v").distinct())
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "u"))
        pointers = follow(materialise(both.groupBy("node").agg(F.min("root").alias("root")).select("node", F.least("node", "root").alias("root"))))
        if labels is None:
            labels = pointers
        else:
            upper = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = materialise(labels.join(upper, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        ends = [pointers.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("u", "v")]
        moved = links.join(ends[0], "u").join(ends[1], "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        links = materialise(moved.where("u != v").distinct())
    return labels if labels is not None else links.select(F.col("u").alias("node"), F.col("v").alias("root"))
