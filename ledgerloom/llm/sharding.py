"""Op 9: hierarchical weighted hash tree.

The tree is region > rack > shard. A shard's draw for a key is an exponential
variate ``-ln(u) / weight`` with ``u`` from a hash of (key, shard). A rack's draw
is the least draw among its shards, a region's the least among its racks; the
least of independent exponentials is itself exponential with the summed rate, so
every level is a weighted hash draw with its subtree's total weight. A key
descends by taking the child with the least draw. When a shard is added or gains
weight only draws on its own path change, and they only fall, so keys move into
that shard and nowhere else.

Law: ``key``. Everything is a function of doc_id and the tree; texts, row order
and partitioning have no part in it.

Defined cases: a null doc_id is one key of its own; a null text counts 0 bytes,
so its size is the overhead alone and its crc32 is 0; repeated rows share a shard
and get different slots; ties between draws go to the first child; a very long text
counts with its bytes and is shuffled as its size and checksum; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a stored row costs besides its text.
ROW_OVERHEAD = 16

#: Rows of one shard that are numbered together; what is sorted at once stays this small on average.
ROWS_PER_BUCKET = 50_000


@dataclass(frozen=True)
class Tree:
    """Nested shard numbers, ``regions[i][j]`` being a rack, and the shards' weights (1 if not named)."""

    regions: tuple[tuple[tuple[int, ...], ...], ...]
    weights: tuple[tuple[int, float], ...] = ()

    @staticmethod
    def of(shards: int, per_rack: int = 5, racks: int = 4) -> "Tree":
        """Fills racks, then regions, in the order of shard numbers: one more shard changes one path."""
        rack = [tuple(range(a, min(a + per_rack, shards))) for a in range(0, shards, per_rack)]
        return Tree(tuple(tuple(rack[a : a + racks]) for a in range(0, len(rack), racks)))

    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s in rack]


def _draw(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard).cast("long")), 11)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _least(values: Column) -> Column:
    """0-based place of the first least value."""
    return (F.array_position(values, F.array_min(values)) - 1).cast("int")


def place(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """Adds ``<out>_region``, ``<out>_rack`` and ``<out>``; the draws of all levels come from one pass over the shards."""
    weights = dict(tree.weights)
    draws = [[F.array(*[_draw(key, s, weights.get(s, 1.0)) for s in rack]) for rack in region] for region in tree.regions]
    df = df.withColumn("__shard_draws", F.array(*[F.array(*racks) for racks in draws]))
    df = df.withColumn("__rack_draws", F.transform("__shard_draws", lambda racks: F.transform(racks, F.array_min)))
    df = df.withColumn(f"{out}_region", _least(F.transform("__rack_draws", F.array_min)))
    df = df.withColumn(f"{out}_rack", _least(F.get("__rack_draws", F.col(f"{out}_region"))))
    df = df.withColumn("__at", _least(F.get(F.get("__shard_draws", F.col(f"{out}_region")), F.col(f"{out}_rack"))))
    numbers = F.array(*[F.array(*[F.array(*[F.lit(s) for s in rack]) for rack in region]) for region in tree.regions])
    df = df.withColumn(out, F.get(F.get(F.get(numbers, F.col(f"{out}_region")), F.col(f"{out}_rack")), F.col("__at")))
    return df.drop("__shard_draws", "__rack_draws", "__at")


def assign_shards(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and grown_shard for every row.

    Slots count a shard's rows gaplessly from 0. Numbering a whole shard in one
    task would not scale, so rows are numbered inside hashed buckets of a shard
    and shifted by the counts of the buckets before, which are summed map-side.
    Repeated rows are one row with a count until they are numbered, and told apart
    again in portions of bounded size.
    """
    tree, grown = tree or Tree.of(40), grown or Tree.of(41)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00null"))
    rows = place(place(rows, own, tree), own, grown, "grown_shard")
    same = [c for c in rows.columns if not c.startswith("__")]
    rows = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("__copies"))
    per_shard = max(1, len(tree.shards()))
    buckets = max(1, math.ceil(docs.select(F.lit(1).alias("one")).count() / per_shard / ROWS_PER_BUCKET))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(own, "text_crc32", "size", F.lit("bucket")), F.lit(buckets)))
    before = (
        rows.groupBy("shard", "__bucket").agg(F.sum("__copies").alias("n"))
        .withColumn("__before", F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "__bucket", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    in_bucket = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    portion = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / ROWS_PER_BUCKET)))
    numbered = (
        rows.withColumn("__first", F.sum("__copies").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__copies"))
        .join(before, ["shard", "__bucket"]).withColumn("__portion", portion)
    )
    spread = numbered.repartition("doc_id", "text_crc32", "__portion")
    at = F.col("__portion") * ROWS_PER_BUCKET
    return spread.withColumn("__i", F.explode(F.sequence(at, F.least(at + ROWS_PER_BUCKET, F.col("__copies")) - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__first") + F.col("__i")).cast("long").alias("slot"),
        "grown_shard", F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"),
    )
