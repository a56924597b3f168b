"""Counts, roll-ups, histograms and consistency checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import bucket_upper, has_flag, hex_of, log2_bucket, outcome_of, shard_of, size_class
from ..runtime import arrow_map
from .slots import tx_with_blocks
from .state import State


def _count(when: Column) -> Column:
    return F.count_if(when).cast("long")


def record_inventory(state: State) -> DataFrame:
    return state.tx.agg(
        F.count(F.lit(1)).alias("records"), _count(F.col("delete_at_height") != 0).alias("with_dah"),
        _count(F.col("unmined_since") != 0).alias("unmined"), _count(F.col("preserve_until") != 0).alias("preserved"), _count(has_flag("flags", C.EXTERNAL)).alias("external"),
    )


def slot_inventory(state: State) -> DataFrame:
    s = F.col("status")
    return state.utxo.agg(
        F.count(F.lit(1)).alias("total"), _count(s == C.SPENT).alias("spent"), _count(s == C.PRUNED).alias("pruned"), _count(s == C.FROZEN).alias("frozen"),
    ).withColumn("unspent", F.col("total") - F.col("spent") - F.col("pruned") - F.col("frozen"))


def records_by_class(state: State) -> DataFrame:
    return state.tx.groupBy(F.when(F.col("unmined_since") == 0, "mined").otherwise("unmined").alias("mined"), size_class(F.col("utxo_count")).alias("size_class")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("utxo_count").alias("slots")
    )


def status_report(state: State) -> DataFrame:
    """Sizes in bytes, and the share of slots that are dead in thousandths (0 for an empty store)."""
    t = state.tx.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("utxo_count"), F.lit(0)).alias("slots"), F.coalesce(F.sum(F.col("spent_utxos") + F.col("pruned_utxos")), F.lit(0)).alias("dead"))
    return t.select(
        "records", "slots", (F.col("records") * C.HEADER_BYTES + F.col("slots") * C.SLOT_BYTES).alias("bytes"),
        F.when(F.col("slots") == 0, 0).otherwise(F.floor(F.col("dead") * 1000 / F.col("slots"))).cast("long").alias("dead_permille"),
    )


def rendezvous_weight(shard: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The fixed 64-bit mix of shard and node that ranks a shard's nodes (unsigned, wrapping)."""
    # Seed and multipliers of the mix.
    seed, spread, first, second = (np.uint64(v) for v in (0x5EEDC0DE13579BDF, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    with np.errstate(over="ignore"):
        x = seed ^ (shard.astype(np.uint64) << np.uint64(48)) ^ (node.astype(np.uint64) * spread)
        for shift, by in ((30, first), (27, second)):
            x = (x ^ (x >> np.uint64(shift))) * by
        return x ^ (x >> np.uint64(31))


def _weigh(batches):
    """Weights as signed numbers of the same order. Wrapping products are beyond ANSI SQL; the rows are 4096 for each node."""
    for b in batches:
        w = rendezvous_weight(b.column(0).to_numpy(), b.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((w ^ np.uint64(1 << 63)).view(np.int64))], ["shard", "node", "weight"])


def placement(spark, nodes: list[int], copies: int, version: int = 2) -> DataFrame:
    """shard, rank (0: master), node. Version 1 goes round; version 2 ranks the nodes by a rendezvous weight, ties to the lower node."""
    nodes = sorted(nodes)
    n, copies = len(nodes), max(1, min(copies, len(nodes)))
    shards = spark.range(C.SHARDS).withColumnRenamed("id", "shard")
    if version < 2:
        listed = F.array(*[F.lit(x).cast("long") for x in nodes])
        return shards.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
            "shard", F.col("rank").cast("long").alias("rank"), F.get(listed, ((F.col("shard") + F.col("rank")) % n).cast("int")).alias("node")
        )
    both = shards.withColumn("node", F.explode(F.array(*[F.lit(x).cast("long") for x in nodes])))
    both = arrow_map(both, _weigh, "shard bigint, node bigint, weight bigint")
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("weight"), "node")) - 1
    return both.withColumn("rank", rank.cast("long")).where(F.col("rank") < copies).select("shard", "rank", "node")


def shards_by_node(placed: DataFrame) -> DataFrame:
    return placed.groupBy("node").agg(_count(F.col("rank") == 0).alias("masters"), _count(F.col("rank") > 0).alias("replicas"))


def migration_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shards whose master differs: from, to."""
    masters = lambda df, name: df.where("rank = 0").select("shard", F.col("node").alias(name))
    return masters(old, "source").join(masters(new, "target"), "shard").where("source <> target")


def keys_by_shard(state: State) -> DataFrame:
    return state.tx.groupBy(shard_of("txid").alias("shard")).agg(F.count(F.lit(1)).alias("keys"))


#: What a node says of its index, storage, redo log and connections, all summed up.
GAUGES = (
    "index_entries", "index_capacity", "index_memory_bytes", "storage_used_bytes", "storage_total_bytes", "storage_free_regions",
    "redo_current_sequence", "redo_write_position", "redo_available_space", "connections",
)


def _weighted_mean(group: str) -> Column:
    """Of the nodes' means by their counts, in whole numbers; nodes without samples are left out."""
    n = F.col(f"{group}_count")
    return F.when(F.sum(n) > 0, F.floor(F.sum((n * F.col(f"{group}_mean_ns")).cast("decimal(38,0)")) / F.sum(n))).otherwise(0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def roll_up(nodes: DataFrame) -> DataFrame:
    """One row from a row for each node: timestamp_ms, the counters, <group>_count, _mean_ns, _p50_ns, _p95_ns and _p99_ns of each
    latency group, the gauges, ready. Sums, means weighted by count, the worst percentiles, ratios of sums, all ready."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    latencies = [
        x for g in C.LATENCIES for x in (
            total(f"{g}_count"), _weighted_mean(g).cast("long").alias(f"{g}_mean_ns"),
            *[F.coalesce(F.max(f"{g}_{p}_ns"), F.lit(0)).alias(f"{g}_{p}_ns") for p in ("p50", "p95", "p99")],
        )
    ]
    out = nodes.agg(
        F.coalesce(F.max("timestamp_ms"), F.lit(0)).alias("timestamp_ms"), F.count(F.lit(1)).alias("node_count"), *[total(c) for c in (*C.COUNTERS, *GAUGES)], *latencies,
        F.coalesce(F.bool_and(F.coalesce("ready", F.lit(False))), F.lit(True)).alias("all_ready"),
    )
    return out.withColumns({
        "index_load_factor": _share(F.col("index_entries"), F.col("index_capacity")), "storage_utilization": _share(F.col("storage_used_bytes"), F.col("storage_total_bytes")),
        "redo_utilization": _share(F.col("redo_write_position"), F.col("redo_write_position") + F.col("redo_available_space")),
    })


def outcome_matrix(spark, answers: DataFrame) -> DataFrame:
    """Counts by op and outcome class of answers (op, code, idempotent), with a cell for every pair."""
    counted = answers.groupBy("op", outcome_of(F.col("code"), F.coalesce("idempotent", F.lit(False))).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(o, c) for o in C.OPERATIONS for c in C.OUTCOMES], "op string, outcome string")
    return F.broadcast(cells).join(counted, ["op", "outcome"], "left").select("op", "outcome", F.coalesce("n", F.lit(0)).alias("n"))


def latency_histogram(samples: DataFrame, ns: str, *by: str) -> DataFrame:
    """Counts in 25 doubling buckets with running sums; empty buckets have no row."""
    counted = samples.groupBy(*by, log2_bucket(F.col(ns)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    return counted.select(*by, "bucket", bucket_upper(F.col("bucket")).alias("upper_ns"), "n", running.alias("cumulative"))


def histogram_percentile(histogram: DataFrame, p: tuple[int, int], *by: str) -> DataFrame:
    """The upper bound of the first bucket whose running sum reaches the share p[0] / p[1] of all, rounded up."""
    total = F.max("cumulative").over(Window.partitionBy(*by))
    reached = histogram.withColumn("total", total).where(F.col("cumulative") >= F.ceil(F.col("total") * p[0] / p[1]))
    return reached.groupBy(*by).agg(F.min("upper_ns").alias("percentile_ns"))


def nearest_rank(samples: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long").alias("value"))


def prometheus_lines(histogram: DataFrame, metric: str, label: str) -> DataFrame:
    """Text lines of cumulative buckets, with the open one as +Inf."""
    le = F.when(F.col("bucket") >= 24, "+Inf").otherwise(F.col("upper_ns").cast("string"))
    return histogram.select(F.format_string(metric + '_bucket{' + label + '="%s",le="%s"} %d', F.col(label).cast("string"), le, F.col("cumulative")).alias("line"))


def rate(events: DataFrame, ts: str, *by: str) -> DataFrame:
    """Events in windows of ten seconds, one each second; operations per window. Empty windows have no row."""
    w = F.window(ts, "10 seconds", "1 second")
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start_s"), *by, "n")


def counter_faults(state: State) -> DataFrame:
    """Records whose counters disagree with their slots, and those without slots or slots without a record."""
    n = state.utxo.groupBy("txid").agg(F.count(F.lit(1)).alias("c"), _count(F.col("status") == C.SPENT).alias("s"), _count(F.col("status") == C.PRUNED).alias("p"))
    both = state.tx.select("txid", "utxo_count", "spent_utxos", "pruned_utxos").join(n, "txid", "full_outer")
    fault = (
        F.when(F.col("utxo_count").isNull(), "no_record").when(F.col("c").isNull(), "no_slots").when(F.col("c") != F.col("utxo_count"), "count")
        .when(F.col("s") != F.col("spent_utxos"), "spent").when(F.col("p") != F.col("pruned_utxos"), "pruned")
    )
    return both.select("txid", fault.alias("fault")).where("fault IS NOT NULL")


def replica_lag(acknowledged: DataFrame, threshold: int) -> DataFrame:
    """Distance of each replica (node, stream, seq) from its stream's last number."""
    last = acknowledged.groupBy("stream").agg(F.max("seq").alias("head"))
    lag = F.col("head") - F.col("seq")
    return acknowledged.join(last, "stream").select("stream", "node", lag.alias("lag"), (lag > threshold).alias("behind"))


def manifest(state: State) -> DataFrame:
    """A digest for each shard, whatever the order: records and the XOR of their row hashes."""
    row = F.sha2(F.concat_ws(":", hex_of("txid"), "generation", "spent_utxos", "flags"), 256)
    h = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return state.tx.groupBy(shard_of("txid").alias("shard")).agg(F.count(F.lit(1)).alias("records"), F.lpad(F.lower(F.hex(F.bit_xor(h))), 16, "0").alias("digest"))


def manifest_difference(a: State, b: State) -> DataFrame:
    """txids that only one side has, or that differ in generation."""
    left, right = (x.tx.select("txid", F.col("generation").alias(n)) for x, n in ((a, "a"), (b, "b")))
    kind = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("generation")
    return left.join(right, "txid", "full_outer").where("NOT (a <=> b)").select("txid", kind.alias("kind"))


def inspect(state: State, txid: bytes | None = None) -> DataFrame:
    """Records as JSON lines with hexadecimal ids; for one, the filter is pushed to the scans."""
    if txid is not None:
        state = state.but(**{n: getattr(state, n).where(F.col("txid") == F.lit(txid)) for n in ("tx", "block")})
    row = tx_with_blocks(state)
    return row.select(hex_of("txid").alias("txid"), F.to_json(F.struct(hex_of("txid").alias("txid"), *[c for c in state.tx.columns if c != "txid"], "n_blocks")).alias("json"))
