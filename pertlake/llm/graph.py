"""Connected components of a link table, by alternating star contractions.

Each round replaces links by links to smaller neighbours (large-star, then small-star),
which reaches one star per component in a logarithmic number of rounds. Every round is a
partial-aggregated minimum and a join, written to the shared folder; nothing is collected.
At most ``LOCAL_LINKS`` links, 16 bytes each, are joined by one task instead of in rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertlake.llm.common import materialize

LOCAL_LINKS = 1 << 20


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v, of one contraction: neighbours are re-linked to the smallest of them."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(joined.select("u", F.col("low").alias("v")))
    return out.filter("u != v").distinct()


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        new, least = low.copy(), np.minimum(low[x], low[y])
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, low):
            return nodes, nodes[low]
        low = new


def _in_one_task(links: DataFrame) -> DataFrame:
    def join(batches):
        sides = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if sides:
            found = _joined(*(np.concatenate(x) for x in zip(*sides, strict=True)))
            yield pa.record_batch([pa.array(x) for x in found], names=["node", "component"])

    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(join, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has columns a and b (any order, repeats and self-links allowed).
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"), "links")
    if now.count() <= LOCAL_LINKS:
        return _in_one_task(now)
    now = now.distinct()
    while True:
        new = materialize(_star(_star(now, True), False), "links")
        shape = [x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first() for x in (now, new)]
        now = new
        if shape[0] == shape[1]:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
