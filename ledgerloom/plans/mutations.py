"""Mutation batches over the projection: outcomes of the items and the state after."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import OPERATIONS, OUTCOMES
from ..functions.scalars import hex_of
from ..operators import inventory, pruner, reads, records, slots
from ..operators.state import Heights, Result
from ..sources import projection as P

HEIGHTS = Heights(2000)
BLOCK_ID, BLOCK_HEIGHT = 103, 2000
REASSIGN_HEIGHT, REASSIGN_AFTER = 2000, 1000
NOW = 1720000000000


def _told(df: DataFrame, *more: str) -> DataFrame:
    """Answers without nulls: no holder is the empty string and -1, an unknown record was not locked."""
    shown = {
        "by_spender": F.coalesce(hex_of("by_spender"), F.lit("")), "by_vin": F.coalesce("by_vin", F.lit(-1)).cast("long"),
        "idempotent": F.col("idempotent"), "was_locked": F.coalesce("was_locked", F.lit(False)),
    }
    return df.select("k", "seq", F.col("code").cast("long").alias("code"), *[shown[c].alias(c) for c in more])


def _state(r: Result, *columns: str) -> DataFrame:
    return r.state.tx.select(hex_of("txid").alias("txid"), *[F.col(c).cast("long").alias(c) for c in columns])


_AFTER = ("updated_at", "spent_utxos", "generation", "flags", "delete_at_height", "signal")


def _spend(s: SparkSession, d: str) -> Result:
    return slots.spend(P.state(s, d), P.items(s, d, "A"), HEIGHTS, now_ms=NOW)


def spend_batch_outcomes(s, d):
    return _told(_spend(s, d).items, "idempotent", "by_spender", "by_vin")


def spend_batch_state(s, d):
    return _state(_spend(s, d), *_AFTER)


def spend_ignoring_gates(s, d):
    r = slots.spend(P.state(s, d), P.items(s, d, "A"), HEIGHTS, ignore_conflicting=True, ignore_locked=True)
    return _told(r.items, "idempotent", "by_spender", "by_vin")


def _look_sql(flag: str, conflicting: str = "", locked: str = "", coinbase: str = "", first: str = "", slot: str = "", order_first: str = "") -> str:
    """Items with record, slot and gate."""
    return f"""
look AS (
  SELECT i.*, t.utxo_count AS t_count, t.flags AS t_flags, s.hash AS s_hash, s.status AS s_status, s.spender AS s_spender, s.vin AS s_vin, s.cooldown AS s_cooldown,
    c.child IS NOT NULL AS gone,
    CASE {first} WHEN t.txid IS NULL THEN 1 {order_first} {conflicting} {locked} {coinbase} WHEN i.vout >= t.utxo_count THEN 11 ELSE 0 END AS record_gate
  FROM items i LEFT JOIN tx t ON t.txid = i.txid LEFT JOIN utxo s ON s.txid = i.txid AND s.vout = i.vout
    LEFT JOIN children c ON c.parent = i.txid AND c.child = i.spender AND c.kind = 'deleted'
  WHERE i.l_returnflag = '{flag}'),
gated AS (SELECT *, CASE WHEN record_gate <> 0 THEN record_gate WHEN hash <> s_hash THEN 2 {slot} ELSE 0 END AS gate FROM look),
won AS (SELECT *, min(CASE WHEN gate = 0 THEN seq END) OVER (PARTITION BY txid, vout) AS w_seq,
  arg_min(spender, CASE WHEN gate = 0 THEN seq END) OVER (PARTITION BY txid, vout) AS w_spender,
  arg_min(vin, CASE WHEN gate = 0 THEN seq END) OVER (PARTITION BY txid, vout) AS w_vin,
  arg_min(new_hash, CASE WHEN gate = 0 THEN seq END) OVER (PARTITION BY txid, vout) AS w_new_hash
  FROM gated)"""


_CONFLICTING, _LOCKED = "WHEN t.flags & 2 <> 0 THEN 8", "WHEN t.flags & 4 <> 0 AND t.n_blocks = 0 THEN 9"
_COINBASE = "WHEN t.spending_height > 0 AND t.spending_height > 2000 THEN 10"
_OPEN = "(s_status = 0 AND s_cooldown <= 2000)"


def _spend_sql(waived: bool) -> str:
    return P.SQL + "," + _look_sql("A", "" if waived else _CONFLICTING, "" if waived else _LOCKED, _COINBASE, "WHEN i.reserved THEN 6") + f""",
judged AS (
  SELECT *, gate = 0 AND {_OPEN} AND w_seq = seq AS changed,
    CASE WHEN gate <> 0 THEN gate WHEN s_status = 0 AND s_cooldown > 2000 THEN 13
      WHEN s_status = 0 AND w_seq = seq THEN 0
      WHEN s_status = 0 THEN CASE WHEN spender = w_spender AND vin = w_vin THEN CASE WHEN gone THEN 35 ELSE 0 END ELSE 3 END
      WHEN s_status = 1 THEN CASE WHEN spender = s_spender AND vin = s_vin THEN CASE WHEN gone THEN 35 ELSE 0 END ELSE 3 END
      WHEN s_status = 255 THEN 7 ELSE 6 END AS code
  FROM won)"""


_SPEND_OUT = f"""SELECT k, seq, CAST(code AS BIGINT) AS code, code = 0 AND NOT changed AS idempotent,
  coalesce(CASE WHEN gate = 0 AND code IN (3, 6) THEN CASE WHEN {_OPEN} THEN w_spender ELSE s_spender END END, '') AS by_spender,
  CAST(coalesce(CASE WHEN gate = 0 AND code IN (3, 6) THEN CASE WHEN {_OPEN} THEN w_vin ELSE s_vin END END, -1) AS BIGINT) AS by_vin FROM judged"""


def _settled_sql(change: int) -> str:
    return f""",
hits AS (SELECT txid, count(*) FILTER (changed) AS c FROM judged GROUP BY txid),
after AS (SELECT tx.* REPLACE (spent_utxos + coalesce(c, 0) * {change} AS spent_utxos, CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END AS generation), coalesce(c, 0) > 0 AS hit
  FROM tx LEFT JOIN hits USING (txid))"""


#: Every effective mutation leaves its time; the projection's records start with generation 0.
_UPDATED = f"CAST(CASE WHEN generation > 0 THEN {NOW} ELSE 1710000000000 END AS BIGINT) AS updated_at"


def _after_sql(columns: tuple[str, ...], source: str) -> str:
    return "SELECT txid, " + ", ".join(_UPDATED if c == "updated_at" else f"CAST({c} AS BIGINT) AS {c}" for c in columns) + f" FROM ({source})"


def _with(sql: str, out: str) -> str:
    return f"WITH {sql}\n{out}"


def unspend_batch_outcomes(s, d):
    return _told(slots.unspend(P.state(s, d), _owned(s, d), HEIGHTS, NOW).items, "idempotent")


def unspend_batch_state(s, d):
    return _state(slots.unspend(P.state(s, d), _owned(s, d), HEIGHTS, NOW), *_AFTER)


def _owned(s, d):
    """Unspend items name the slot's holder where seq is odd."""
    held = P.state(s, d).utxo.select("txid", "vout", F.col("spender").alias("own"), F.col("vin").alias("own_vin"))
    i = P.items(s, d, "R").join(held, ["txid", "vout"], "left")
    mine = (F.col("seq") % 2 == 1) & F.col("own").isNotNull()
    return i.withColumns({"spender": F.when(mine, F.col("own")).otherwise(F.col("spender")), "vin": F.when(mine, F.col("own_vin")).otherwise(F.col("vin"))}).drop("own", "own_vin")


_UNSPEND = P.SQL.replace("items AS (", "plain_items AS (", 1).replace("tx_plain_items", "tx_items") + """,
items AS (SELECT i.* REPLACE (CASE WHEN i.seq % 2 = 1 AND s.spender IS NOT NULL THEN s.spender ELSE i.spender END AS spender,
    CASE WHEN i.seq % 2 = 1 AND s.spender IS NOT NULL THEN s.vin ELSE i.vin END AS vin)
  FROM plain_items i LEFT JOIN utxo s ON s.txid = i.txid AND s.vout = i.vout),""" + _look_sql("R", slot="WHEN s_status = 2 THEN 6 WHEN s_status = 1 AND spender = s_spender AND vin = s_vin THEN 0 WHEN true THEN -1") + """,
judged AS (SELECT *, gate = 0 AND w_seq = seq AS changed, greatest(gate, 0) AS code FROM won)"""


def freeze_batch_outcomes(s, d):
    return _told(slots.freeze(P.state(s, d), P.items(s, d, "N")).items, "by_spender", "by_vin")


def unfreeze_batch_outcomes(s, d):
    return _told(slots.unfreeze(P.state(s, d), P.items(s, d, "N")).items)


def _reassign(s, d):
    return slots.reassign(P.state(s, d), P.items(s, d, "N"), REASSIGN_HEIGHT, REASSIGN_AFTER, NOW)


def reassign_batch_outcomes(s, d):
    return _told(_reassign(s, d).items)


def reassign_audit(s, d):
    return _reassign(s, d).audit.select(*[hex_of(c).alias(c) for c in ("txid", "old_hash", "new_hash")], "vout", "block_height")


def reassign_state(s, d):
    return _state(_reassign(s, d), "updated_at", "generation", "flags", "reassignment_count")


_FREEZE = P.SQL + "," + _look_sql("N", slot="WHEN s_status = 255 THEN 4 WHEN s_status = 1 THEN 3 WHEN s_status = 2 THEN 6")
_UNFREEZE = P.SQL + "," + _look_sql("N", slot="WHEN s_status <> 255 THEN 5")
_REASSIGN = P.SQL + "," + _look_sql("N", order_first="WHEN i.vout >= t.utxo_count THEN 11", conflicting=_CONFLICTING, locked=_LOCKED, coinbase=_COINBASE, slot="WHEN s_status <> 255 THEN 5") + """,
judged AS (SELECT *, gate = 0 AND w_seq = seq AS changed,
  CASE WHEN record_gate = 0 AND w_seq < seq THEN CASE WHEN hash <> w_new_hash THEN 2 ELSE 5 END ELSE gate END AS code FROM won)"""


def set_mined_state(s, d):
    return _state(records.set_mined(P.state(s, d), P.tx_items(s, d), BLOCK_ID, BLOCK_HEIGHT, HEIGHTS, now_ms=NOW), "unmined_since", *_AFTER)


def set_mined_blocks(s, d):
    r = records.set_mined(P.state(s, d), P.tx_items(s, d), BLOCK_ID, BLOCK_HEIGHT, HEIGHTS, now_ms=NOW)
    return r.state.block.select(hex_of("txid").alias("txid"), "block_id", "block_height")


def unset_mined_state(s, d):
    return _state(records.unset_mined(P.state(s, d), P.tx_items(s, d), BLOCK_ID, HEIGHTS, NOW), "unmined_since", *_AFTER)


def set_conflicting_state(s, d):
    return _state(records.set_conflicting(P.state(s, d), P.tx_items(s, d), True, HEIGHTS, NOW), *_AFTER)


def _children(r: Result) -> DataFrame:
    return r.state.children.select(hex_of("parent").alias("parent"), hex_of("child").alias("child"), "kind")


def set_conflicting_children(s, d):
    """The lists of the parents of records that become conflicting."""
    return _children(records.set_conflicting(P.state(s, d), P.tx_items(s, d), True, HEIGHTS, NOW))


def create_conflicting_children(s, d):
    """The lists of the parents that create requests name; each request names the record of its customer's number."""
    items, hashes = create_items(s, d)
    return _children(records.create(P.state(s, d), items, hashes, _asked(s, d).select("txid", "seq", P._sha(F.col("o_custkey")).alias("parent"))))


def set_locked_state(s, d):
    return _state(records.set_locked(P.state(s, d), P.tx_items(s, d), True, NOW), "updated_at", "generation", "flags", "delete_at_height")


def preserve_until_state(s, d):
    return _state(records.preserve_until(P.state(s, d), P.tx_items(s, d), 2600, NOW), "updated_at", "generation", "preserve_until", "delete_at_height", "signal")


def mark_longest_chain_state(s, d):
    return _state(records.mark_longest_chain(P.state(s, d), P.tx_items(s, d), True, HEIGHTS, NOW), "unmined_since", *_AFTER)


def tx_batch_outcomes(s, d):
    """The answers of a batch that names records, some of them unknown."""
    return _told(records.set_locked(P.state(s, d), P.tx_items(s, d), True, NOW).items, "was_locked")


def increment_spent_extra(s, d):
    return _told(records.increment_spent_extra(P.tx_items(s, d)))


def _delete(s, d):
    return records.delete(P.state(s, d), P.tx_items(s, d), height=2000, now_ms=NOW)


def delete_batch_state(s, d):
    return _state(_delete(s, d), "updated_at", "spent_utxos", "pruned_utxos", "generation")


def delete_batch_slots(s, d):
    u = _delete(s, d).state.utxo
    return u.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def delete_batch_tombstones(s, d):
    return _delete(s, d).audit.select(hex_of("txid").alias("txid"), "generation", "deletion_height", "cause")


def delete_batch_children(s, d):
    return _children(_delete(s, d))


def remove_conflicting_child(s, d):
    st = P.state(s, d)
    pairs = P.items(s, d, "A").select("k", "seq", F.col("txid").alias("parent"), F.col("spender").alias("child"))
    return _children(records.remove_children(st, pairs))


def append_children(s, d):
    st = P.state(s, d)
    pairs = P.items(s, d, "A").select(F.col("txid").alias("parent"), F.col("spender").alias("child"), "seq")
    return records.add_children(st, pairs, "conflicting").children.groupBy(hex_of("parent").alias("parent"), "kind").agg(F.count(F.lit(1)).alias("n"))


def append_children_full(s, d):
    """What full lists take and refuse: every line's part is a child of its supplier's record, in the order of lines."""
    li = P.by_id(P.lines(s, d).select("l_orderkey", "l_suppkey", "vout"), "child", P._sha(F.concat_ws("-", "l_orderkey", "vout")), P.parts_of(s, d))
    pairs = li.select(P._sha(F.col("l_suppkey") % 10).alias("parent"), "child", (F.col("l_orderkey") * 1000 + F.col("vout")).alias("seq"))
    r = records.append_children(P.state(s, d), pairs, "conflicting")
    last = r.state.children.where("kind = 'conflicting'").groupBy("parent").agg(F.bit_xor(F.conv(F.substring(F.hex("child"), 1, 15), 16, 10).cast("long")).alias("x"))
    return r.items.join(last, "parent").select(hex_of("parent").alias("parent"), "n_added", "n_dropped", "x")


def _thrice(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Rows of an order under the three requests that name it: txid and seq."""
    three = df.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"))
    name = F.when(F.col("copy") == 0, F.col(key).cast("string")).otherwise(F.concat(F.lit("n"), key))
    return P.by_id(three, "txid", P._sha(name), parts).withColumn("seq", (F.col(key) * 3 + F.col("copy")).cast("long"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return _thrice(P.read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", P._height().alias("h")), "o_orderkey", P.parts_of(s, d))


def create_items(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Create requests: each order again (exists), and a copy under a new id, twice; orders without lines have no hashes."""
    zero = F.lit(0).cast("long")
    items = _asked(s, d).select(
        F.col("o_orderkey").alias("k"), "txid", "seq",
        (F.when(F.col("o_orderkey") % 2 == 0, 4).otherwise(0) + F.when(F.col("o_orderkey") % 3 == 0, 8).otherwise(0) + F.when(F.col("o_orderkey") % 5 == 0, 3).otherwise(0)).cast("long").alias("request_flags"),
        (F.col("o_orderkey") % 10 == 0).alias("is_coinbase"), (F.col("o_custkey") % 2 == 0).alias("has_blob"), F.col("h").alias("block_height"),
        F.when(F.col("o_orderstatus") == "F", F.lit(100)).cast("long").alias("mined_block"), F.lit(1).cast("long").alias("tx_version"), zero.alias("locktime"),
        F.lit(500).cast("long").alias("fee"), F.lit(250).cast("long").alias("size_in_bytes"), zero.alias("spending_height"), F.lit(1710000000000).alias("created_at"), "copy",
    )
    li = _thrice(P.lines(s, d).select("l_orderkey", "vout"), "l_orderkey", P.parts_of(s, d))
    hashes = li.select("txid", "seq", "vout", P._sha(F.concat_ws(":", "l_orderkey", "vout")).alias("hash"))
    return items, hashes


def create_batch_outcomes(s, d):
    return _told(records.create(P.state(s, d), *create_items(s, d)).items)


def create_batch_state(s, d):
    r = records.create(P.state(s, d), *create_items(s, d))
    counts = r.state.utxo.groupBy("txid").agg(F.sum((F.col("status") == 255).cast("long")).alias("n_frozen"))
    return r.state.tx.join(counts, "txid", "left").select(hex_of("txid").alias("txid"), "flags", "utxo_count", "unmined_since", "n_frozen")


_CREATE = P.SQL + """,
asked AS (
  SELECT o_orderkey AS k, sha256(CASE WHEN copy = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'n' || o_orderkey END) AS txid, o_orderkey * 3 + copy AS seq,
    o_orderkey % 2 = 0 AS frozen, o_orderkey % 3 = 0 AS external, o_orderkey % 5 = 0 AS both_flags, o_orderkey % 10 = 0 AS coinbase, o_custkey % 2 = 0 AS has_blob,
    h, o_orderstatus = 'F' AS mined, coalesce(n, 0) AS n
  FROM o CROSS JOIN (VALUES (0), (1), (2)) v(copy) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
own AS (SELECT a.*, CASE WHEN t.txid IS NOT NULL THEN 12 WHEN a.n = 0 THEN 28 WHEN external AND NOT has_blob THEN 17 ELSE 0 END AS own FROM asked a LEFT JOIN tx t ON t.txid = a.txid),
made AS (SELECT *, CASE WHEN min(CASE WHEN own = 0 THEN seq END) OVER (PARTITION BY txid) < seq THEN 12 ELSE own END AS code FROM own)"""


#: Operations on whole records that answer alike: an unknown record is an error, all else succeeds.
RECORD_OPERATIONS = ("set_mined", "set_conflicting", "set_locked", "preserve_until", "delete", "mark_longest_chain")


def answers(s, d) -> DataFrame:
    """op, code and idempotent of the items of one batch of every operation that answers by item."""
    st, named = P.state(s, d), P.tx_items(s, d)
    told = {
        "spend": _spend(s, d).items, "unspend": slots.unspend(st, _owned(s, d), HEIGHTS, NOW).items, "freeze": slots.freeze(st, P.items(s, d, "N")).items,
        "unfreeze": slots.unfreeze(st, P.items(s, d, "N")).items, "reassign": _reassign(s, d).items, "create": records.create(st, *create_items(s, d)).items,
        "set_mined": records.set_mined(st, named, BLOCK_ID, BLOCK_HEIGHT, HEIGHTS, now_ms=NOW).items, "set_conflicting": records.set_conflicting(st, named, True, HEIGHTS).items,
        "set_locked": records.set_locked(st, named, True).items, "preserve_until": records.preserve_until(st, named, 2600).items, "delete": _delete(s, d).items,
        "mark_longest_chain": records.mark_longest_chain(st, named, True, HEIGHTS).items,
        "get": reads.get(st, named, 1).withColumnRenamed("status", "code"), "get_spend": reads.get_spend(st, P.items(s, d, "A")), "process_expired": pruner.sweep(st, 2200).items,
    }
    out = None
    for op, items in told.items():
        one = items.select(F.lit(op).alias("op"), F.col("code").cast("long").alias("code"), (F.col("idempotent") if "idempotent" in items.columns else F.lit(False)).alias("idempotent"))
        out = one if out is None else out.unionByName(one)
    return out


def spend_outcome_matrix(s, d):
    """Counts by operation and outcome class of two batches, with a cell for every pair."""
    r = _spend(s, d).items.select(F.lit("spend").alias("op"), "code", "idempotent")
    f = slots.freeze(P.state(s, d), P.items(s, d, "N")).items.select(F.lit("freeze").alias("op"), "code", "idempotent")
    return inventory.outcome_matrix(s, r.unionByName(f))


CLASS_SQL = """CASE WHEN code = 0 THEN CASE WHEN idem THEN 'idempotent' ELSE 'ok' END WHEN code = 1 THEN 'err_not_found' WHEN code IN (3, 8, 6, 12, 35) THEN 'err_conflicting'
  WHEN code IN (4, 7, 9, 13) THEN 'err_frozen' WHEN code = 30 THEN 'err_storage' WHEN code = 14 THEN 'redirect' ELSE 'other' END"""
_FREEZE_JUDGED = """, judged_f AS (SELECT *, CASE WHEN gate <> 0 THEN gate WHEN w_seq = seq THEN 0 ELSE 4 END AS code FROM won_f)"""


def _matrix_sql() -> str:
    freeze = _look_sql("N", slot="WHEN s_status = 255 THEN 4 WHEN s_status = 1 THEN 3 WHEN s_status = 2 THEN 6")
    for n in ("look", "gated", "won"):
        freeze = freeze.replace(f"{n} AS (", f"{n}_f AS (").replace(f"FROM {n})", f"FROM {n}_f)").replace(f"FROM {n} ", f"FROM {n}_f ").replace(f"FROM {n}\n", f"FROM {n}_f\n")
    freeze = freeze.replace("FROM gated)", "FROM gated_f)")
    return _with(_spend_sql(False) + "," + freeze + _FREEZE_JUDGED, f"""
, counted AS (SELECT op, {CLASS_SQL} AS outcome, count(*) AS n FROM (
    SELECT 'spend' AS op, code, code = 0 AND NOT changed AS idem FROM judged UNION ALL SELECT 'freeze', code, false FROM judged_f) GROUP BY 1, 2)
SELECT op, outcome, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT unnest({list(OPERATIONS)}) AS op) CROSS JOIN (SELECT unnest({list(OUTCOMES)}) AS outcome) LEFT JOIN counted USING (op, outcome)""")


_HIT = """,
named AS (SELECT DISTINCT txid FROM tx_items),
hit AS (SELECT tx.*, n.txid IS NOT NULL AS hit, b.txid IS NOT NULL AS has FROM tx LEFT JOIN named n ON n.txid = tx.txid LEFT JOIN (SELECT txid FROM block WHERE block_id = 103) b ON b.txid = tx.txid)"""


def _tx_sql(replace: str, changed: str, has_blocks: str, columns: tuple[str, ...], evaluate: bool = True, more: str = "") -> str:
    after = f""",
after AS (SELECT * REPLACE ({replace}, CASE WHEN {changed} THEN 1 ELSE 0 END AS generation){more} FROM hit)"""
    source = P.dah_sql("after", 2000, 288, "hit", has_blocks) if evaluate else "SELECT * FROM after"
    return _with(P.SQL + _HIT + after, _after_sql(columns, source))


_DELETED = P.SQL + """,
dead AS (SELECT DISTINCT txid FROM tx WHERE txid IN (SELECT txid FROM tx_items)),
slots AS (SELECT u.*, u.status = 1 AND u.spender IN (SELECT txid FROM dead) AS hit FROM utxo u),
kept AS (SELECT * FROM slots WHERE txid NOT IN (SELECT txid FROM dead)),
pruned AS (SELECT txid, count(*) FILTER (hit) AS p FROM slots GROUP BY txid)"""

QUERIES = {
    k: globals()[k]
    for k in (
        "spend_batch_outcomes", "spend_batch_state", "spend_ignoring_gates", "unspend_batch_outcomes", "unspend_batch_state", "freeze_batch_outcomes",
        "unfreeze_batch_outcomes", "reassign_batch_outcomes", "reassign_audit", "reassign_state", "set_mined_state", "set_mined_blocks", "unset_mined_state",
        "set_conflicting_state", "set_conflicting_children", "create_conflicting_children", "append_children_full", "set_locked_state", "preserve_until_state", "mark_longest_chain_state", "tx_batch_outcomes", "increment_spent_extra",
        "delete_batch_state", "delete_batch_slots", "delete_batch_tombstones", "delete_batch_children", "remove_conflicting_child", "append_children",
        "create_batch_outcomes", "create_batch_state", "spend_outcome_matrix",
    )
}

ORACLES = {
    "spend_batch_outcomes": _with(_spend_sql(False), _SPEND_OUT),
    "spend_ignoring_gates": _with(_spend_sql(True), _SPEND_OUT),
    "spend_batch_state": _with(_spend_sql(False) + _settled_sql(1), _after_sql(_AFTER, P.dah_sql("after", 2000, 288, "hit", "(n_blocks > 0)"))),
    "unspend_batch_outcomes": _with(_UNSPEND, "SELECT k, seq, CAST(code AS BIGINT) AS code, code = 0 AND NOT changed AS idempotent FROM judged"),
    "unspend_batch_state": _with(_UNSPEND + _settled_sql(-1), _after_sql(_AFTER, P.dah_sql("after", 2000, 288, "hit", "(n_blocks > 0)"))),
    "freeze_batch_outcomes": _with(_FREEZE, """
      SELECT k, seq, CAST(code AS BIGINT) AS code, CASE WHEN code = 3 THEN s_spender ELSE '' END AS by_spender, CAST(CASE WHEN code = 3 THEN s_vin ELSE -1 END AS BIGINT) AS by_vin
      FROM (SELECT *, CASE WHEN gate <> 0 THEN gate WHEN w_seq = seq THEN 0 ELSE 4 END AS code FROM won)"""),
    "unfreeze_batch_outcomes": _with(_UNFREEZE, "SELECT k, seq, CAST(CASE WHEN gate <> 0 THEN gate WHEN w_seq = seq THEN 0 ELSE 5 END AS BIGINT) AS code FROM won"),
    "reassign_batch_outcomes": _with(_REASSIGN, "SELECT k, seq, CAST(code AS BIGINT) AS code FROM judged"),
    "reassign_audit": _with(_REASSIGN, "SELECT txid, hash AS old_hash, new_hash, CAST(vout AS BIGINT) AS vout, CAST(2000 AS BIGINT) AS block_height FROM judged WHERE changed"),
    "reassign_state": _with(_REASSIGN, """
      SELECT txid, CAST(CASE WHEN coalesce(c, 0) > 0 THEN 1720000000000 ELSE 1710000000000 END AS BIGINT) AS updated_at, CAST(CASE WHEN coalesce(c, 0) > 0 THEN 1 ELSE 0 END AS BIGINT) AS generation, CAST(CASE WHEN coalesce(c, 0) > 0 THEN flags | 64 ELSE flags END AS BIGINT) AS flags,
        CAST(coalesce(c, 0) AS BIGINT) AS reassignment_count
      FROM tx LEFT JOIN (SELECT txid, count(*) FILTER (changed) AS c FROM judged GROUP BY txid) USING (txid)"""),
    "set_mined_state": _tx_sql("CASE WHEN hit THEN 0 ELSE unmined_since END AS unmined_since", "hit AND (NOT has OR unmined_since <> 0)", "(n_blocks > 0 OR hit)", ("unmined_since", *_AFTER)),
    "set_mined_blocks": _with(P.SQL + _HIT, "SELECT txid, CAST(block_id AS BIGINT) AS block_id, CAST(block_height AS BIGINT) AS block_height FROM block UNION ALL SELECT txid, 103, 2000 FROM hit WHERE hit AND NOT has"),
    "unset_mined_state": _tx_sql("CASE WHEN hit AND has THEN 2000 ELSE unmined_since END AS unmined_since", "hit AND has", "(n_blocks > 0 AND NOT has)", ("unmined_since", *_AFTER)),
    "set_conflicting_state": _tx_sql("CASE WHEN hit THEN flags | 2 ELSE flags END AS flags", "hit AND flags & 2 = 0", "(n_blocks > 0)", _AFTER),
    "set_conflicting_children": _with(P.SQL, """
      SELECT * FROM children UNION SELECT txid, spender, 'conflicting' FROM utxo WHERE status = 1 AND spender IN (SELECT i.txid FROM tx_items i JOIN tx ON tx.txid = i.txid)"""),
    "create_conflicting_children": _with(_CREATE, """
      SELECT * FROM children UNION SELECT sha256(CAST(o_custkey AS VARCHAR)), m.txid, 'conflicting' FROM made m JOIN o ON o.o_orderkey = m.k
      WHERE code = 0 AND both_flags AND sha256(CAST(o_custkey AS VARCHAR)) IN (SELECT txid FROM tx UNION ALL SELECT txid FROM made WHERE code = 0)"""),
    "append_children_full": _with(P.SQL, """, offered AS (
        SELECT sha256(CAST(l_suppkey % 10 AS VARCHAR)) AS parent, sha256(l_orderkey || '-' || vout) AS child, min(l_orderkey * 1000 + vout) AS seq FROM li GROUP BY 1, 2),
      fresh AS (SELECT * FROM offered WHERE parent IN (SELECT txid FROM tx) AND NOT EXISTS (SELECT 1 FROM children c WHERE c.parent = offered.parent AND c.child = offered.child AND kind = 'conflicting')),
      had AS (SELECT parent, count(*) AS have FROM children WHERE kind = 'conflicting' GROUP BY 1),
      placed AS (SELECT f.*, row_number() OVER (PARTITION BY f.parent ORDER BY seq, child) + coalesce(have, 0) <= 255 AS fits FROM fresh f LEFT JOIN had USING (parent)),
      lists AS (SELECT parent, child FROM children WHERE kind = 'conflicting' UNION ALL SELECT parent, child FROM placed WHERE fits)
      SELECT parent, n_added, n_dropped, x FROM (SELECT parent, count(*) FILTER (fits) AS n_added, count(*) FILTER (NOT fits) AS n_dropped FROM placed GROUP BY 1)
        JOIN (SELECT parent, bit_xor(CAST('0x' || child[1:15] AS BIGINT)) AS x FROM lists GROUP BY 1) USING (parent)"""),
    "set_locked_state": _tx_sql("CASE WHEN hit THEN flags | 4 ELSE flags END AS flags, CASE WHEN hit THEN 0 ELSE delete_at_height END AS delete_at_height", "hit", "", ("updated_at", "generation", "flags", "delete_at_height"), False),
    "preserve_until_state": _tx_sql("CASE WHEN hit THEN 2600 ELSE preserve_until END AS preserve_until, CASE WHEN hit THEN 0 ELSE delete_at_height END AS delete_at_height", "hit", "", ("updated_at", "generation", "preserve_until", "delete_at_height", "signal"), False, ", CASE WHEN hit AND flags & 8 <> 0 THEN 5 ELSE 0 END AS signal"),
    "mark_longest_chain_state": _tx_sql("CASE WHEN hit THEN 0 ELSE unmined_since END AS unmined_since", "hit", "(n_blocks > 0)", ("unmined_since", *_AFTER)),
    "tx_batch_outcomes": _with(P.SQL, "SELECT i.k, i.seq, CAST(CASE WHEN t.txid IS NULL THEN 1 ELSE 0 END AS BIGINT) AS code, coalesce(t.flags & 4 <> 0, false) AS was_locked FROM tx_items i LEFT JOIN tx t ON t.txid = i.txid"),
    "increment_spent_extra": _with(P.SQL, "SELECT k, seq, CAST(0 AS BIGINT) AS code FROM tx_items"),
    "delete_batch_state": _with(_DELETED, """
      SELECT txid, CAST(CASE WHEN coalesce(p, 0) > 0 THEN 1720000000000 ELSE 1710000000000 END AS BIGINT) AS updated_at, CAST(spent_utxos - coalesce(p, 0) AS BIGINT) AS spent_utxos, CAST(pruned_utxos + coalesce(p, 0) AS BIGINT) AS pruned_utxos, CAST(coalesce(p, 0) AS BIGINT) AS generation
      FROM tx LEFT JOIN pruned USING (txid) WHERE txid NOT IN (SELECT txid FROM dead)"""),
    "delete_batch_slots": _with(_DELETED, "SELECT CAST(CASE WHEN hit THEN 2 ELSE status END AS BIGINT) AS status, count(*) AS n FROM kept GROUP BY 1"),
    "delete_batch_tombstones": _with(_DELETED, "SELECT txid, CAST(0 AS BIGINT) AS generation, CAST(2000 AS BIGINT) AS deletion_height, CAST(1 AS BIGINT) AS cause FROM dead"),
    "delete_batch_children": _with(_DELETED, """
      SELECT parent, child, kind FROM children WHERE parent NOT IN (SELECT txid FROM dead) UNION SELECT txid, spender, 'deleted' FROM kept WHERE hit"""),
    "remove_conflicting_child": _with(P.SQL, """
      SELECT c.* FROM children c WHERE NOT (kind = 'conflicting' AND EXISTS (SELECT 1 FROM items i WHERE i.l_returnflag = 'A' AND i.txid = c.parent AND i.spender = c.child))"""),
    "append_children": _with(P.SQL, """
      SELECT parent, kind, count(*) AS n FROM (
        SELECT * FROM children UNION SELECT txid, spender, 'conflicting' FROM items WHERE l_returnflag = 'A' AND txid IN (SELECT txid FROM tx)) GROUP BY 1, 2"""),
    "create_batch_outcomes": _with(_CREATE, "SELECT k, CAST(seq AS BIGINT) AS seq, CAST(code AS BIGINT) AS code FROM made"),
    "create_batch_state": _with(_CREATE, """
      SELECT txid, CAST(flags AS BIGINT) AS flags, CAST(utxo_count AS BIGINT) AS utxo_count, CAST(unmined_since AS BIGINT) AS unmined_since, CAST(f AS BIGINT) AS n_frozen
      FROM tx JOIN (SELECT txid, count(*) FILTER (status = 255) AS f FROM utxo GROUP BY 1) USING (txid)
      UNION ALL SELECT txid, CASE WHEN coinbase THEN 1 ELSE 0 END + CASE WHEN both_flags THEN 6 ELSE 0 END + CASE WHEN external THEN 8 ELSE 0 END, n,
        CASE WHEN mined THEN 0 ELSE h END, CASE WHEN frozen THEN n ELSE 0 END FROM made WHERE code = 0"""),
    "spend_outcome_matrix": _matrix_sql(),
}
