"""Connected components of an edge table, without collecting it anywhere.

Partitions first contract their own edges by union-find, then alternating
large-star and small-star rounds run as grouped minima and equi-joins until the
edges stay the same. Minima are combined map-side, so a hub with a third of all
edges is no hot group; every round is cut off by a checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import checkpoint


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the least node of its component, itself left out."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(ids))
    while True:  # min-label hooking with pointer jumping, vectorised
        rx, ry = root[x], root[y]
        if np.array_equal(rx, ry):
            break
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    out = root != np.arange(len(ids))
    return ids[out], ids[root[out]]


def _contract_partitions(edges: DataFrame, rows: int = 1 << 18) -> DataFrame:
    def run(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += len(batch)
            if n >= rows:  # memory stays bounded: what is known so far is a forest
                x, y = contract(np.concatenate(a), np.concatenate(b))
                if len(x) > rows // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])
                    x, y = x[:0], y[:0]
                a, b, n = [x], [y], len(x)
        if a:
            x, y = contract(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["u", "v"])

    return edges.select("u", "v").transform(arrow_map, run, "u bigint, v bigint")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    star = linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge, root being the least node of its component; edges: u, v (long)."""
    now = checkpoint(_contract_partitions(edges.where(F.col("u") != F.col("v"))).distinct())
    told = None
    for _ in range(most_rounds):
        now = checkpoint(_star(_star(now, True), False))
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == told:
            break
        told = tuple(sign)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
