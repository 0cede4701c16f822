"""Connected components over links that live in a DataFrame; nothing is gathered on the driver.

Links are contracted to a spanning forest inside each task first, so a dense
group of near copies leaves a task as one row per member. The forests are then
joined by alternating large-star and small-star rounds (each a grouped minimum,
combined map-side, and an equi-join whose skewed keys adaptive execution can
split). Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import drop_saved, saved


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member of its group) for the pairs ``a[i] - b[i]``; members that are smallest are left out."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b: long) that is not the smallest of its component."""
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = saved(links.filter("a != b").select(high, low).distinct(), "links")

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(first.select("u", F.col("m").alias("v")))
        after = saved(small.distinct(), "links")
        now = mark(after)
        drop_saved(edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def smallest_of_group(members: DataFrame, value: str, name: str, salts: int = 32) -> DataFrame:
    """``members`` (with column ``root``) with the smallest ``value`` of each root's rows.

    Lone rows have their own. A root's rows are dealt over ``salts`` keys for
    the join, so that one that holds a large part of all rows is no single task.
    """
    least = members.groupBy("root").agg(F.min(value).alias(name), F.count("*").alias("_n")).filter("_n > 1").select(F.col("root").alias("_root"), F.col(name).alias("_least"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_at"))
    dealt = members.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    met = dealt.join(least, (F.col("root") == F.col("_root")) & (F.col("_salt") == F.col("_at")), "left")
    return met.withColumn(name, F.coalesce("_least", value)).drop("_salt", "_root", "_least", "_at")
