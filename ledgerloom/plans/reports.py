"""Reads, pruner, inventory and placement over the projection, with SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import error_name, fingerprint, fits_u32, frozen_cooldown, generation_ahead, hex_of, is_frozen, le_bytes, le_uint, lit_hex, shard_of
from ..operators import inventory as I
from ..operators import pruner, reads
from ..operators.lifecycle import evaluate
from ..operators.state import State
from ..sources import projection as P

NODES = [11, 22, 33, 44, 55]


def _with(sql: str, out: str) -> str:
    return f"WITH {sql}\n{out}"


def get_batch(s, d):
    mask = sum(1 << C.FIELDS.index(f) for f in ("flags", "utxo_count", "spent_utxos", "unmined_since", "block_entry_count"))
    out = reads.get(P.state(s, d), P.tx_items(s, d), mask)
    return out.select("k", "seq", "status", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("flags", "utxo_count", "spent_utxos", "unmined_since", "block_entry_count")])


def get_batch_sections(s, d):
    mask = sum(1 << C.FIELDS.index(f) for f in ("utxo_slots", "block_entries", "conflicting_children"))
    out = reads.get(P.state(s, d), P.tx_items(s, d), mask)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}")
    return out.select("k", "status", size("utxo_slots"), size("block_entries"), size("conflicting_children"))


def get_spend_batch(s, d):
    out = reads.get_spend(P.state(s, d), P.items(s, d, "A"))
    return out.select("k", "seq", "code", F.coalesce("slot_status", F.lit(-1)).alias("slot_status"), F.coalesce(hex_of("by_spender"), F.lit("")).alias("by_spender"))


def response_budget(s, d):
    items = P.tx_items(s, d).join(P.state(s, d).tx.select("txid", "utxo_count"), "txid", "left").withColumns({
        "batch": F.floor(F.col("k") / 4000), "bytes": (F.coalesce("utxo_count", F.lit(0)) * F.col("utxo_count") * 73 + 320).cast("long")})
    return reads.within_budget(items, "batch", "seq", "bytes", 2_000_000).select("k", "fits")


def query_old_unmined(s, d):
    return reads.keyset_page(reads.old_unmined(P.state(s, d), 1800), bytes.fromhex("40"), 500).select(hex_of("txid").alias("txid"), "truncated")


def query_conflicting(s, d):
    return reads.keyset_page(reads.conflicting(P.state(s, d)), None, 1000).select(hex_of("txid").alias("txid"), "truncated")


def cluster_union(s, d):
    st = P.state(s, d)
    return reads.union_of_nodes(reads.old_unmined(st, 1800), reads.conflicting(st), reads.old_unmined(st, 2500)).select(hex_of("txid").alias("txid"))


def inspect_records(s, d):
    """Every record as its JSON line, and the fields read back from it."""
    shown = I.inspect(P.state(s, d))
    return shown.select("txid", *[F.get_json_object("json", f"$.{c}").cast("long").alias(c) for c in ("flags", "utxo_count", "spent_utxos", "unmined_since", "n_blocks")],
                        F.get_json_object("json", "$.txid").alias("json_txid"))


def dah_range(s, d):
    return pruner.due_in_order(P.state(s, d), 2000, 300).select(hex_of("txid").alias("txid"), "delete_at_height")


def dah_sweep(s, d):
    return pruner.sweep(P.state(s, d), 2200).items.select(hex_of("txid").alias("txid"), "code")


def dah_sweep_state(s, d):
    st = pruner.sweep(P.state(s, d), 2200).state
    return st.tx.select(hex_of("txid").alias("txid"), "spent_utxos", "pruned_utxos", "generation")


def expire_preservations(s, d):
    st = pruner.expire_preservations(P.state(s, d), 2200)
    return st.tx.select(hex_of("txid").alias("txid"), "preserve_until", "delete_at_height", "generation")


def preserve_parents(s, d):
    r = pruner.preserve_parents(P.state(s, d), 2200, 4000)
    return r.state.tx.where("preserve_until = 4000").select(hex_of("txid").alias("txid"), "signal")


def pruner_pipeline(s, d):
    r = pruner.prune(P.state(s, d), 2400)
    return r.state.tx.select(hex_of("txid").alias("txid"), "spent_utxos", "preserve_until", "delete_at_height")


def _blobs(s, d):
    """A blob for each order, some without a record."""
    return P.read(s, d, "orders").select(
        P._sha(F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("b"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))).alias("txid"),
        (F.col("o_orderkey") % 1000 * 100).cast("long").alias("mtime_ms"), (F.col("o_orderkey") % 17 == 0).alias("pinned"),
    )


def blob_collection(s, d):
    return pruner.blob_verdicts(_blobs(s, d), P.state(s, d), 100_000).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _tombstones(s, d):
    return P.tx_items(s, d).select("txid", (F.col("k") % 5).cast("long").alias("generation"), (F.col("k") % 700).cast("long").alias("deletion_height"), (F.col("k") % 3).cast("long").alias("cause"))


def tombstone_heal(s, d):
    incoming = P.state(s, d).tx.select("txid", F.lit(2).cast("long").alias("generation"))
    return pruner.heals(_tombstones(s, d), incoming).groupBy("may").agg(F.count(F.lit(1)).alias("n"))


def tombstone_collection(s, d):
    protected = P.state(s, d).tx.where("preserve_until <> 0")
    return pruner.collect_tombstones(_tombstones(s, d), 600, 288, protected).select(hex_of("txid").alias("txid"), "cause")


def tombstone_reconcile(s, d):
    return pruner.reconcile(_tombstones(s, d), P.state(s, d)).select(hex_of("txid").alias("txid"), "cause")


def dah_grid(s, d):
    """The evaluation over every combination of flags, counters, blocks and heights; a fixed grid."""
    g = s.range(128).select(F.col("id").alias("flags"))
    for name, values in (("spent_utxos", [0, 1, 2]), ("n_blocks", [0, 1]), ("unmined_since", [0, 900]), ("delete_at_height", [0, 1100, 1500]), ("preserve_until", [0, 3000]), ("height", [1000, 4294967200]), ("retention", [0, 288])):
        g = g.withColumn(name, F.explode(F.array(*[F.lit(v).cast("long") for v in values])))
    e = evaluate(F.col("height"), F.col("retention"), F.col("n_blocks") > 0)
    g = g.withColumn("utxo_count", F.lit(2).cast("long")).withColumn("e", e)
    return g.select("flags", "spent_utxos", "n_blocks", "unmined_since", "delete_at_height", "preserve_until", "height", "retention", "e.signal", "e.dah", "e.last_spent_all", "e.overflow")


def record_inventory(s, d):
    return I.record_inventory(P.state(s, d))


def slot_inventory(s, d):
    return I.slot_inventory(P.state(s, d))


def records_by_class(s, d):
    return I.records_by_class(P.state(s, d))


def status_report(s, d):
    return I.status_report(P.state(s, d))


def shard_placement_v1(s, d):
    return I.placement(s, NODES, 2, 1)


def shard_placement_v2(s, d):
    return I.placement(s, NODES, 2, 2)


def shards_by_node(s, d):
    return I.shards_by_node(I.placement(s, NODES, 3, 1))


def migration_plan(s, d):
    return I.migration_plan(I.placement(s, NODES[:4], 1, 2), I.placement(s, NODES, 1, 2))


def keys_by_shard(s, d):
    return I.keys_by_shard(P.state(s, d))


def _node_columns() -> list[tuple[str, str]]:
    """A name and an aggregate for every column of a pretended node, the same text in both engines."""
    out = [("timestamp_ms", "max(c_custkey)"), ("ready", "bool_and(c_custkey > 0)")]
    out += [(c, f"count(CASE WHEN c_custkey % {i + 2} <> 0 THEN 1 END)") for i, c in enumerate((*C.COUNTERS, *I.GAUGES))]
    for i, g in enumerate(C.LATENCIES, 1):
        ns = f"c_custkey * {37 * i} % 100000"
        out += [(f"{g}_count", f"count(CASE WHEN c_nationkey % 4 <> 1 AND c_custkey % {i + 1} = 0 THEN 1 END)"), (f"{g}_mean_ns", f"CAST(floor(avg({ns})) AS BIGINT)")]
        out += [(f"{g}_{p}_ns", f"max({ns} // {k})".replace("//", "DIV")) for p, k in (("p50", 3), ("p95", 2), ("p99", 1))]
    return out


def _nodes(s, d):
    """A row for each node of a pretended cluster: nations are nodes."""
    return P.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(*[F.expr(x).alias(n) for n, x in _node_columns()])


def cluster_roll_up(s, d):
    return I.roll_up(_nodes(s, d))


def _samples(s, d):
    """Latencies in nanoseconds from the events: multiplied up so that many buckets fill."""
    return P.read(s, d, "events").select("event_type", ((F.col("event_id") * F.col("event_id")) % 100000000 + F.col("event_id") % 300).cast("long").alias("ns"), "ts")


def latency_histogram(s, d):
    return I.latency_histogram(_samples(s, d), "ns", "event_type")


def latency_percentile(s, d):
    return I.histogram_percentile(I.latency_histogram(_samples(s, d), "ns", "event_type"), (99, 100), "event_type")


def latency_nearest_rank(s, d):
    return I.nearest_rank(_samples(s, d), "ns", 0.95, "event_type")


def prometheus_text(s, d):
    return I.prometheus_lines(I.latency_histogram(_samples(s, d), "ns", "event_type"), "op_latency_ns", "event_type")


def outcome_counters(s, d):
    """Operations and outcome classes counted over real batches, a cell for every pair of the 16 operations and 8 classes."""
    from . import mutations as M

    return I.outcome_matrix(s, M.answers(s, d))


def throughput_rate(s, d):
    return I.rate(P.read(s, d, "events"), "ts", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.max("n").alias("most"))


def counter_faults(s, d):
    st = P.state(s, d)
    wrong = st.tx.withColumn("spent_utxos", F.when(F.col("flags") == 8, F.col("spent_utxos") + 1).otherwise(F.col("spent_utxos"))).where("flags <> 1")
    return I.counter_faults(st.but(tx=wrong)).select(hex_of("txid").alias("txid"), "fault")


def replica_lag(s, d):
    acknowledged = P.read(s, d, "events").groupBy((F.col("user_id") % 5).alias("stream"), (F.col("user_id") % 3).alias("node")).agg(F.max("event_id").alias("seq"))
    return I.replica_lag(acknowledged, 20)


def manifest_difference(s, d):
    a = P.state(s, d)
    b = State(a.tx.where("flags <> 8").withColumn("generation", F.when(F.col("flags") == 2, 1).otherwise(F.col("generation")).cast("long")), a.utxo, a.block, a.children)
    return I.manifest_difference(a, b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def manifest_counts(s, d):
    return I.manifest(P.state(s, d)).select("shard", "records", "digest")


def scalar_functions(s, d):
    t = P.state(s, d).tx
    return t.select(
        hex_of("txid").alias("txid"), shard_of("txid").alias("shard"), fingerprint("txid").alias("fingerprint"),
        hex_of(le_bytes(F.col("utxo_count"), 4)).alias("count_le"), le_uint(le_bytes(F.col("utxo_count") * 65537, 4), 0, 4).alias("back"),
        generation_ahead(fingerprint("txid"), F.lit(4294967000)).alias("ahead"), F.sha2("txid", 256).alias("digest"),
    )


def slot_scalars(s, d):
    """Frozen slots' stored cooldowns (old ones are FF bytes alone), 32-bit checks and error names."""
    u = P.state(s, d).utxo.withColumn("kept", F.col("vout") * 70000)
    data = F.when(F.col("vout") == 0, lit_hex("FF" * 36)).otherwise(F.concat(le_bytes(F.col("kept"), 4), lit_hex("FF" * 32)))
    return u.select(
        hex_of("txid").alias("txid"), "vout", is_frozen(F.col("status")).alias("frozen"), F.when(is_frozen(F.col("status")), frozen_cooldown(data)).otherwise(-1).alias("cooldown"),
        fits_u32(F.col("vout") * 1500000000 - 1).alias("fits"), error_name((F.col("vout") % 40).cast("int")).alias("error"),
    )


_SHARD = "(CAST('0x' || txid[3:4] AS BIGINT) * 256 + CAST('0x' || txid[1:2] AS BIGINT)) % 4096"
_FP = "(CAST('0x' || txid[7:8] || txid[5:6] || txid[3:4] || txid[1:2] AS BIGINT))"
_FINISHED = "(spent_utxos = utxo_count AND flags & 64 = 0 AND n_blocks > 0 AND unmined_since = 0)"
_ALL64 = "18446744073709551616"
_NODE_ROWS = "(VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate(NODES)) + ") n(i, node)"


def _mix(x: str, shift: int, by: int) -> str:
    return f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * CAST({by} AS UHUGEINT) % CAST({_ALL64} AS UHUGEINT) AS UBIGINT)"


def _weights(nodes: str) -> str:
    return f"""
p AS (SELECT s.shard, n.node FROM (SELECT unnest(range(4096)) AS shard) s CROSS JOIN {nodes}),
x0 AS (SELECT *, xor(xor(CAST(6840335469085432799 AS UBIGINT), CAST(CAST(shard AS UHUGEINT) * 281474976710656 % CAST({_ALL64} AS UHUGEINT) AS UBIGINT)),
  CAST(CAST(node AS UHUGEINT) * CAST(11400714819323198485 AS UHUGEINT) % CAST({_ALL64} AS UHUGEINT) AS UBIGINT)) AS x FROM p),
x1 AS (SELECT shard, node, {_mix('x', 30, 13787848793156543929)} AS x FROM x0),
x2 AS (SELECT shard, node, {_mix('x', 27, 10723151780598845931)} AS x FROM x1),
w AS (SELECT shard, node, xor(x, x >> 31) AS w FROM x2),
ranked AS (SELECT shard, node, row_number() OVER (PARTITION BY shard ORDER BY w DESC, node) - 1 AS rank FROM w)"""


_SAMPLES = """samples AS (SELECT event_type, (event_id * event_id) % 100000000 + event_id % 300 AS ns FROM events),
b AS (SELECT event_type, least(24, greatest(0, length(ltrim(bin(greatest(ns, 1)), '0')) - 1 - 7)) AS bucket, count(*) AS n FROM samples GROUP BY 1, 2),
h AS (SELECT event_type, bucket, CASE WHEN bucket = 0 THEN 128 WHEN bucket >= 24 THEN 9223372036854775807 ELSE CAST(128 * pow(2, bucket) AS BIGINT) END AS upper_ns, n,
  sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cumulative FROM b)"""
_TOMB = "tomb AS (SELECT txid, k % 5 AS generation, k % 700 AS deletion_height, k % 3 AS cause FROM tx_items)"
_BLOBS = """blobs AS (SELECT sha256(CASE WHEN o_orderkey % 13 = 0 THEN 'b' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END) AS txid,
  o_orderkey % 1000 * 100 AS mtime, o_orderkey % 17 = 0 AS pinned FROM o)"""
_SWEPT = """
due AS (SELECT *, {ok} AS ok FROM tx WHERE delete_at_height BETWEEN 1 AND 2200),
dead AS (SELECT txid FROM due WHERE ok),
hit AS (SELECT txid, count(*) AS p FROM utxo WHERE status = 1 AND spender IN (SELECT txid FROM dead) GROUP BY 1)""".format(
    ok=f"preserve_until = 0 AND (flags & 2 <> 0 OR {_FINISHED})"
)

_PIPELINE = f"""
young AS (SELECT txid FROM tx WHERE unmined_since BETWEEN 1 AND 2256),
kept AS (SELECT DISTINCT txid FROM utxo WHERE status = 1 AND spender IN (SELECT txid FROM young)),
t1 AS (SELECT * REPLACE (CASE WHEN txid IN (SELECT txid FROM kept) THEN 3840 ELSE preserve_until END AS preserve_until,
  CASE WHEN txid IN (SELECT txid FROM kept) THEN 0 ELSE delete_at_height END AS delete_at_height) FROM tx),
t2 AS (SELECT * REPLACE (CASE WHEN preserve_until BETWEEN 1 AND 2400 THEN 0 ELSE preserve_until END AS preserve_until,
  CASE WHEN preserve_until BETWEEN 1 AND 2400 THEN CASE WHEN flags & 2 <> 0 OR {_FINISHED} THEN 2688 ELSE 0 END ELSE delete_at_height END AS delete_at_height) FROM t1),
dead AS (SELECT txid FROM t2 WHERE preserve_until = 0 AND delete_at_height BETWEEN 1 AND 2400 AND (flags & 2 <> 0 OR {_FINISHED})),
hit AS (SELECT txid, count(*) AS p FROM utxo WHERE status = 1 AND spender IN (SELECT txid FROM dead) GROUP BY 1)
SELECT txid, CAST(spent_utxos - coalesce(p, 0) AS BIGINT) AS spent_utxos, CAST(preserve_until AS BIGINT) AS preserve_until, CAST(delete_at_height AS BIGINT) AS delete_at_height
FROM t2 LEFT JOIN hit USING (txid) WHERE txid NOT IN (SELECT txid FROM dead)"""

_GRID = """
g AS (SELECT flags, spent_utxos, n_blocks, unmined_since, delete_at_height, preserve_until, height, retention
  FROM (SELECT unnest(range(128)) AS flags) CROSS JOIN (SELECT unnest([0, 1, 2]) AS spent_utxos) CROSS JOIN (SELECT unnest([0, 1]) AS n_blocks)
  CROSS JOIN (SELECT unnest([0, 900]) AS unmined_since) CROSS JOIN (SELECT unnest([0, 1100, 1500]) AS delete_at_height) CROSS JOIN (SELECT unnest([0, 3000]) AS preserve_until)
  CROSS JOIN (SELECT unnest([1000, 4294967200]) AS height) CROSS JOIN (SELECT unnest([0, 288]) AS retention)),
f AS (SELECT *, height + retention AS due, flags & 16 <> 0 AS last, flags & 8 <> 0 AS ext, spent_utxos = 2 AND flags & 64 = 0 AS every FROM g),
r AS (SELECT *, CASE WHEN retention = 0 OR preserve_until <> 0 THEN 'none' WHEN due > 4294967295 THEN 'over'
    WHEN flags & 2 <> 0 THEN CASE WHEN delete_at_height = 0 THEN 'conflict' ELSE 'none' END
    WHEN every AND n_blocks > 0 AND unmined_since = 0 THEN CASE WHEN delete_at_height < due THEN 'set' ELSE 'keep' END
    WHEN delete_at_height <> 0 THEN 'clear' WHEN every <> last THEN 'flip' ELSE 'none' END AS rule FROM f)
SELECT CAST(flags AS BIGINT) AS flags, CAST(spent_utxos AS BIGINT) AS spent_utxos, CAST(n_blocks AS BIGINT) AS n_blocks, CAST(unmined_since AS BIGINT) AS unmined_since,
  CAST(delete_at_height AS BIGINT) AS delete_at_height, CAST(preserve_until AS BIGINT) AS preserve_until, height, CAST(retention AS BIGINT) AS retention,
  CAST(CASE WHEN rule IN ('conflict', 'set') AND ext THEN 3 WHEN rule = 'clear' AND ext THEN 4 WHEN rule = 'flip' THEN CASE WHEN every THEN 1 ELSE 2 END ELSE 0 END AS BIGINT) AS signal,
  CAST(CASE WHEN rule IN ('conflict', 'set') THEN due WHEN rule = 'clear' THEN 0 ELSE delete_at_height END AS BIGINT) AS dah,
  CASE WHEN rule IN ('set', 'keep') THEN true WHEN rule = 'clear' THEN false WHEN rule = 'flip' THEN every ELSE last END AS last_spent_all, rule = 'over' AS overflow
FROM r"""

QUERIES = {
    k: globals()[k]
    for k in (
        "get_batch", "get_batch_sections", "get_spend_batch", "response_budget", "query_old_unmined", "query_conflicting", "cluster_union", "inspect_records",
        "dah_range", "dah_sweep", "dah_sweep_state", "expire_preservations", "preserve_parents", "pruner_pipeline", "blob_collection", "tombstone_heal",
        "tombstone_collection", "tombstone_reconcile", "dah_grid", "record_inventory", "slot_inventory", "records_by_class", "status_report", "shard_placement_v1",
        "shard_placement_v2", "shards_by_node", "migration_plan", "keys_by_shard", "cluster_roll_up", "latency_histogram", "latency_percentile",
        "latency_nearest_rank", "prometheus_text", "outcome_counters", "throughput_rate", "counter_faults", "replica_lag", "manifest_difference",
        "manifest_counts", "scalar_functions", "slot_scalars",
    )
}

_B = lambda e, n: f"CAST({e} AS BIGINT) AS {n}"

ORACLES = {
    "get_batch": _with(P.SQL, "SELECT i.k, i.seq, " + _B("CASE WHEN t.txid IS NULL THEN 1 ELSE 0 END", "status") + ", " + ", ".join(_B(f"coalesce(t.{c}, -1)", n) for c, n in (("flags", "flags"), ("utxo_count", "utxo_count"), ("spent_utxos", "spent_utxos"), ("unmined_since", "unmined_since"), ("n_blocks", "block_entry_count"))) + " FROM tx_items i LEFT JOIN tx t ON t.txid = i.txid"),
    "get_batch_sections": _with(P.SQL, f"""SELECT i.k, {_B('CASE WHEN t.txid IS NULL THEN 1 ELSE 0 END', 'status')}, {_B('coalesce(t.utxo_count, 0)', 'n_utxo_slots')}, {_B('coalesce(t.n_blocks, 0)', 'n_block_entries')},
      {_B('coalesce(c.n, 0)', 'n_conflicting_children')} FROM tx_items i LEFT JOIN tx t ON t.txid = i.txid LEFT JOIN (SELECT parent, count(*) AS n FROM children WHERE kind = 'conflicting' GROUP BY 1) c ON c.parent = i.txid"""),
    "get_spend_batch": _with(P.SQL, """SELECT k, seq, CAST(code AS BIGINT) AS code, CAST(CASE WHEN code = 0 THEN status ELSE -1 END AS BIGINT) AS slot_status, coalesce(CASE WHEN code = 0 THEN s_spender END, '') AS by_spender
      FROM (SELECT i.k, i.seq, s.status, s.spender AS s_spender, CASE WHEN t.txid IS NULL THEN 1 WHEN i.vout >= t.utxo_count THEN 11 WHEN i.hash <> s.hash THEN 2 ELSE 0 END AS code
        FROM items i LEFT JOIN tx t ON t.txid = i.txid LEFT JOIN utxo s ON s.txid = i.txid AND s.vout = i.vout WHERE i.l_returnflag = 'A')"""),
    "query_old_unmined": _with(P.SQL, "SELECT txid, count(*) OVER () > 500 AS truncated FROM (SELECT txid FROM tx WHERE unmined_since BETWEEN 1 AND 1800 AND txid > '40' ORDER BY txid LIMIT 501) QUALIFY row_number() OVER (ORDER BY txid) <= 500"),
    "query_conflicting": _with(P.SQL, "SELECT txid, count(*) OVER () > 1000 AS truncated FROM (SELECT txid FROM tx WHERE flags & 2 <> 0 ORDER BY txid LIMIT 1001) QUALIFY row_number() OVER (ORDER BY txid) <= 1000"),
    "cluster_union": _with(P.SQL, "SELECT txid FROM tx WHERE unmined_since BETWEEN 1 AND 2500 OR flags & 2 <> 0"),
    "inspect_records": _with(P.SQL, "SELECT txid, " + ", ".join(_B(c, c) for c in ("flags", "utxo_count", "spent_utxos", "unmined_since", "n_blocks")) + ", txid AS json_txid FROM tx"),
    "dah_range": _with(P.SQL, "SELECT txid, CAST(delete_at_height AS BIGINT) AS delete_at_height FROM tx WHERE delete_at_height BETWEEN 1 AND 2000 ORDER BY delete_at_height, txid LIMIT 300"),
    "dah_sweep": _with(P.SQL + "," + _SWEPT, "SELECT txid, CAST(CASE WHEN ok THEN 0 ELSE 36 END AS BIGINT) AS code FROM due"),
    "dah_sweep_state": _with(P.SQL + "," + _SWEPT, f"SELECT txid, {_B('spent_utxos - coalesce(p, 0)', 'spent_utxos')}, {_B('pruned_utxos + coalesce(p, 0)', 'pruned_utxos')}, {_B('coalesce(p, 0)', 'generation')} FROM tx LEFT JOIN hit USING (txid) WHERE txid NOT IN (SELECT txid FROM dead)"),
    "expire_preservations": _with(P.SQL, f"""SELECT txid, {_B('CASE WHEN preserve_until BETWEEN 1 AND 2200 THEN 0 ELSE preserve_until END', 'preserve_until')},
      {_B(f'CASE WHEN preserve_until BETWEEN 1 AND 2200 THEN CASE WHEN flags & 2 <> 0 OR {_FINISHED} THEN 2488 ELSE 0 END ELSE delete_at_height END', 'delete_at_height')}, {_B('CASE WHEN preserve_until BETWEEN 1 AND 2200 THEN 1 ELSE 0 END', 'generation')} FROM tx"""),
    "preserve_parents": _with(P.SQL, f"SELECT txid, {_B('CASE WHEN flags & 8 <> 0 THEN 5 ELSE 0 END', 'signal')} FROM tx WHERE txid IN (SELECT txid FROM utxo WHERE status = 1 AND spender IN (SELECT txid FROM tx WHERE unmined_since BETWEEN 1 AND 2200))"),
    "pruner_pipeline": _with(P.SQL + ",", _PIPELINE),
    "blob_collection": _with(P.SQL + "," + _BLOBS, "SELECT CASE WHEN pinned OR mtime > 40000 THEN 'skipped' WHEN t.txid IS NULL THEN 'deleted_no_index' WHEN t.flags & 8 = 0 THEN 'deleted_not_external' ELSE 'kept' END AS verdict, count(*) AS n FROM blobs b LEFT JOIN tx t ON t.txid = b.txid GROUP BY 1"),
    "tombstone_heal": _with(P.SQL + "," + _TOMB, "SELECT t.txid IS NULL OR (t.cause = 0 AND 2 > t.generation) AS may, count(*) AS n FROM tx LEFT JOIN tomb t ON t.txid = tx.txid GROUP BY 1"),
    "tombstone_collection": _with(P.SQL + "," + _TOMB, "SELECT txid, CAST(cause AS BIGINT) AS cause FROM tomb WHERE deletion_height + 288 > 600 OR txid IN (SELECT txid FROM tx WHERE preserve_until <> 0)"),
    "tombstone_reconcile": _with(P.SQL + "," + _TOMB, "SELECT txid, CAST(cause AS BIGINT) AS cause FROM tomb WHERE txid NOT IN (SELECT txid FROM tx)"),
    "dah_grid": _with("", _GRID),
    "record_inventory": _with(P.SQL, "SELECT count(*) AS records, count(*) FILTER (delete_at_height <> 0) AS with_dah, count(*) FILTER (unmined_since <> 0) AS unmined, count(*) FILTER (preserve_until <> 0) AS preserved, count(*) FILTER (flags & 8 <> 0) AS external FROM tx"),
    "slot_inventory": _with(P.SQL, "SELECT count(*) AS total, count(*) FILTER (status = 1) AS spent, count(*) FILTER (status = 2) AS pruned, count(*) FILTER (status = 255) AS frozen, count(*) FILTER (status = 0) AS unspent FROM utxo"),
    "records_by_class": _with(P.SQL, "SELECT CASE WHEN unmined_since = 0 THEN 'mined' ELSE 'unmined' END AS mined, CASE WHEN utxo_count <= 1 THEN '1' WHEN utxo_count <= 4 THEN '2-4' WHEN utxo_count <= 16 THEN '5-16' ELSE '17+' END AS size_class, count(*) AS records, CAST(sum(utxo_count) AS BIGINT) AS slots FROM tx GROUP BY 1, 2"),
    "status_report": _with(P.SQL, "SELECT count(*) AS records, CAST(sum(utxo_count) AS BIGINT) AS slots, CAST(count(*) * 320 + sum(utxo_count) * 73 AS BIGINT) AS bytes, CAST(sum(spent_utxos + pruned_utxos) * 1000 // sum(utxo_count) AS BIGINT) AS dead_permille FROM tx"),
    "shard_placement_v1": f"SELECT shard, rank, CAST(node AS BIGINT) AS node FROM (SELECT unnest(range(4096)) AS shard) CROSS JOIN (SELECT unnest(range(2)) AS rank) JOIN {_NODE_ROWS} ON n.i = (shard + rank) % 5",
    "shard_placement_v2": _with(_weights(_NODE_ROWS), "SELECT shard, rank, CAST(node AS BIGINT) AS node FROM ranked WHERE rank < 2"),
    "shards_by_node": f"SELECT CAST(node AS BIGINT) AS node, count(*) FILTER (rank = 0) AS masters, count(*) FILTER (rank > 0) AS replicas FROM (SELECT unnest(range(4096)) AS shard) CROSS JOIN (SELECT unnest(range(3)) AS rank) JOIN {_NODE_ROWS} ON n.i = (shard + rank) % 5 GROUP BY 1",
    "migration_plan": _with(_weights(_NODE_ROWS) + ", b AS (SELECT shard, first(node ORDER BY w DESC, node) AS target, first(node ORDER BY w DESC, node) FILTER (node <> 55) AS source FROM w GROUP BY 1)", "SELECT shard, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target FROM b WHERE source <> target"),
    "keys_by_shard": _with(P.SQL, f"SELECT {_SHARD} AS shard, count(*) AS keys FROM tx GROUP BY 1"),
    "latency_histogram": _with(_SAMPLES, "SELECT event_type, CAST(bucket AS BIGINT) AS bucket, upper_ns, n, CAST(cumulative AS BIGINT) AS cumulative FROM h"),
    "latency_percentile": _with(_SAMPLES, "SELECT event_type, min(upper_ns) AS percentile_ns FROM (SELECT *, max(cumulative) OVER (PARTITION BY event_type) AS total FROM h) WHERE cumulative >= ceil(total * 99 / 100) GROUP BY 1"),
    "latency_nearest_rank": _with(_SAMPLES, "SELECT event_type, quantile_disc(ns, 0.95) AS value FROM samples GROUP BY 1"),
    "prometheus_text": _with(_SAMPLES, """SELECT 'op_latency_ns_bucket{event_type="' || event_type || '",le="' || CASE WHEN bucket >= 24 THEN '+Inf' ELSE CAST(upper_ns AS VARCHAR) END || '"} ' || CAST(cumulative AS BIGINT) AS line FROM h"""),
    "throughput_rate": """WITH w AS (SELECT event_type, unnest(range(CAST(floor(epoch(ts)) AS BIGINT) - 9, CAST(floor(epoch(ts)) AS BIGINT) + 1)) AS start_s FROM events),
      c AS (SELECT event_type, start_s, count(*) AS n FROM w GROUP BY 1, 2) SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM c GROUP BY 1""",
    "counter_faults": _with(P.SQL, "SELECT txid, CASE WHEN flags = 1 THEN 'no_record' ELSE 'spent' END AS fault FROM tx WHERE flags IN (1, 8)"),
    "replica_lag": "WITH a AS (SELECT user_id % 5 AS stream, user_id % 3 AS node, max(event_id) AS seq FROM events GROUP BY 1, 2) SELECT stream, node, max(seq) OVER (PARTITION BY stream) - seq AS lag, max(seq) OVER (PARTITION BY stream) - seq > 20 AS behind FROM a",
    "manifest_difference": _with(P.SQL, "SELECT CASE WHEN flags = 8 THEN 'only_a' ELSE 'generation' END AS kind, count(*) AS n FROM tx WHERE flags IN (8, 2) GROUP BY 1"),
    "scalar_functions": _with(P.SQL, f"""SELECT txid, {_SHARD} AS shard, {_FP} AS fingerprint, printf('%02x000000', utxo_count) AS count_le, CAST(utxo_count * 65537 AS BIGINT) AS back,
      ({_FP} - 4294967000 + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647 AS ahead, sha256(from_hex(txid)) AS digest FROM tx"""),
    "slot_scalars": _with(P.SQL, f"""SELECT txid, vout, status = 255 AS frozen, CAST(CASE WHEN status = 255 THEN vout * 70000 ELSE -1 END AS BIGINT) AS cooldown,
      vout * 1500000000 - 1 BETWEEN 0 AND 4294967295 AS fits, list_extract({list(C.ERRORS)}, CAST(vout % 40 AS INTEGER) + 1) AS error FROM utxo"""),
    "manifest_counts": _with(P.SQL, f"""SELECT {_SHARD} AS shard, count(*) AS records,
      lower(printf('%016x', bit_xor(CAST('0x' || sha256(txid || ':' || generation || ':' || spent_utxos || ':' || flags)[1:15] AS BIGINT)))) AS digest FROM tx GROUP BY 1"""),
}
def _outcomes_sql() -> str:
    from . import mutations as M

    told = {op: (M.ORACLES[name], idempotent) for op, name, idempotent in (
        ("spend", "spend_batch_outcomes", "idempotent"), ("unspend", "unspend_batch_outcomes", "idempotent"), ("freeze", "freeze_batch_outcomes", "false"),
        ("unfreeze", "unfreeze_batch_outcomes", "false"), ("reassign", "reassign_batch_outcomes", "false"), ("create", "create_batch_outcomes", "false"))}
    told |= {op: (M.ORACLES["tx_batch_outcomes"], "false") for op in M.RECORD_OPERATIONS}
    told |= {"get": (ORACLES["get_batch"].replace(" AS status", " AS code"), "false"), "get_spend": (ORACLES["get_spend_batch"], "false"), "process_expired": (ORACLES["dah_sweep"], "false")}
    rows = " UNION ALL ".join(f"SELECT '{op}' AS op, code, {idem} AS idem FROM ({sql})" for op, (sql, idem) in told.items())
    return f"""WITH counted AS (SELECT op, {M.CLASS_SQL} AS outcome, count(*) AS n FROM ({rows}) GROUP BY 1, 2)
      SELECT op, outcome, CAST(coalesce(n, 0) AS BIGINT) AS n
      FROM (SELECT unnest({list(C.OPERATIONS)}) AS op) CROSS JOIN (SELECT unnest({list(C.OUTCOMES)}) AS outcome) LEFT JOIN counted USING (op, outcome)"""


def _roll_up_sql() -> str:
    nodes = ", ".join(f"{x.replace('DIV', '//')} AS {n}" for n, x in _node_columns())
    total = [f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*C.COUNTERS, *I.GAUGES, *[f"{g}_count" for g in C.LATENCIES])]
    means = [f"CAST(CASE WHEN sum({g}_count) > 0 THEN sum({g}_count * {g}_mean_ns) // sum({g}_count) ELSE 0 END AS BIGINT) AS {g}_mean_ns" for g in C.LATENCIES]
    worst = [f"max({g}_{p}_ns) AS {g}_{p}_ns" for g in C.LATENCIES for p in ("p50", "p95", "p99")]
    return f"""WITH n AS (SELECT {nodes} FROM customer GROUP BY c_nationkey)
      SELECT max(timestamp_ms) AS timestamp_ms, count(*) AS node_count, {", ".join([*total, *means, *worst])}, bool_and(ready) AS all_ready,
        sum(index_entries) / sum(index_capacity) AS index_load_factor, sum(storage_used_bytes) / sum(storage_total_bytes) AS storage_utilization,
        sum(redo_write_position) / (sum(redo_write_position) + sum(redo_available_space)) AS redo_utilization FROM n"""


ORACLES["cluster_roll_up"] = _roll_up_sql()
ORACLES["outcome_counters"] = _outcomes_sql()
ORACLES["response_budget"] = _with(P.SQL, """, sized AS (SELECT i.k, i.k // 4000 AS batch, i.seq, coalesce(t.utxo_count * t.utxo_count * 73 + 320, 0) AS bytes FROM tx_items i LEFT JOIN tx t ON t.txid = i.txid),
  lists AS (SELECT batch, list({'k': k, 'bytes': CAST(bytes AS BIGINT)} ORDER BY seq) AS l FROM sized GROUP BY 1),
  folded AS (SELECT list_reduce(l, lambda a, x: {'used': a.used + CASE WHEN a.used + x.bytes + 5 <= 2000000 THEN x.bytes + 5 ELSE 5 END, 'told': list_append(a.told, {'k': x.k, 'fits': a.used + x.bytes + 5 <= 2000000})},
    {'used': CAST(13 AS BIGINT), 'told': CAST([] AS STRUCT(k BIGINT, fits BOOLEAN)[])}) AS f FROM lists)
  SELECT t.k, t.fits FROM (SELECT unnest(f.told) AS t FROM folded)""")
