"""Connected components: a distributed form over link tables and a numpy form inside one block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every id in ``edges(a, b)``; component is the smallest id reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014).  In the large star a link (u, v),
    v < u, becomes (u, least neighbour of v); only an end with a smaller neighbour has one, so the hub of a
    group, its smallest id, is on neither side of a join's keys with a partner and its rows are never grouped by it.
    Each round is two aggregations with map-side combine and two joins.  The lookup tables of both are
    written, so that adaptive execution may broadcast them or split a hub's rows; a round's links are a
    written table, and only their count and hash sum reach the driver.
    """
    links = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(links)
    while True:
        least = ws.save(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = links.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = ws.save(large, "large")
        lowest = ws.save(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = ws.save(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = state(after)
        ws.drop(links, least, large, lowest)
        links = after
        if now == before:
            break
        before = now
    out = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = out.union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    saved = ws.save(out, "components")
    ws.drop(links)
    return saved


def block_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]
    return label
