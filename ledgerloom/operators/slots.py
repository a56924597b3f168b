"""Spend, unspend, freeze, unfreeze and reassign as closed forms.

Within a batch of one operation the record-level gates are constant, so only the
slot's own state evolves, and the first item that gets through decides what the
later ones see. That is a minimum over the slot's items, not a loop: join, window
on the join's own partitioning, CASE. Items carry ``seq``, unique within a record.

An item has txid, vout, hash, seq and, by operation, spender and vin or new_hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import effectively_locked, has_flag, is_reserved, le_bytes, next_generation, set_flag
from .lifecycle import with_evaluation
from .state import Heights, Result, State, stamp

E = C.ERRORS


@dataclass(frozen=True)
class Gates:
    """Which record-level checks an operation makes, and which a request may waive."""

    conflicting: bool = False
    locked: bool = False
    coinbase: bool = False


def block_counts(state: State) -> DataFrame:
    return state.block.groupBy("txid").agg(F.countDistinct("block_id").alias("n_blocks"))


def tx_with_blocks(state: State) -> DataFrame:
    return state.tx.join(block_counts(state), "txid", "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))


def _looked_up(state: State, items: DataFrame) -> DataFrame:
    """Items with their record (t_*) and slot (s_*), null where there is none."""
    tx = tx_with_blocks(state).select("txid", *[F.col(c).alias(f"t_{c}") for c in ("flags", "spending_height", "utxo_count", "n_blocks")])
    slot = state.utxo.select("txid", "vout", *[F.col(c).alias(f"s_{c}") for c in ("hash", "status", "spender", "vin", "cooldown")])
    return items.join(tx, "txid", "left").join(slot, ["txid", "vout"], "left")


def _gate(gates: Gates, height: int, before: Column | None = None) -> Column:
    """0, or the code of the first check that fails, in the order of the checks."""
    checks: list[tuple[Column, str]] = [(F.col("t_utxo_count").isNull(), "TX_NOT_FOUND")]
    if gates.conflicting:
        checks.append((has_flag("t_flags", C.CONFLICTING), "CONFLICTING"))
    if gates.locked:
        checks.append((effectively_locked(F.col("t_flags"), F.col("t_n_blocks")), "LOCKED"))
    if gates.coinbase:
        checks.append(((F.col("t_spending_height") > 0) & (F.col("t_spending_height") > height), "COINBASE_IMMATURE"))
    checks.append((F.col("vout") >= F.col("t_utxo_count"), "VOUT_OUT_OF_RANGE"))
    return _chain(checks, before)


def _chain(checks: list[tuple[Column, str]], before: Column | None = None, last: Column | None = None) -> Column:
    out = before
    for when, name in checks:
        out = F.when(when, E[name]) if out is None else out.when(when, E[name])
    return out.otherwise(F.lit(0) if last is None else last)


def _first(value: Column) -> Column:
    """The value of the first item of the slot that passes the gates."""
    return F.min(F.when(F.col("gate") == 0, F.struct("seq", value.alias("v")))).over(Window.partitionBy("txid", "vout"))


def _same(spender: str, vin: str) -> Column:
    return (F.col("spender") == F.col(spender)) & (F.col("vin") == F.col(vin))


def _settle(state: State, judged: DataFrame, slot_changes: DataFrame, spent_change: int, heights: Heights | None, now_ms: int | None) -> State:
    """Puts the changed slots in place and brings the records' counters, generation and lifecycle up to date.

    slot_changes: txid, vout and the new values n_* of changed slots, a row a slot.
    """
    utxo = state.utxo.join(slot_changes, ["txid", "vout"], "left").select(
        "txid", "vout",
        *[F.when(F.col("n_status").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("hash", "status", "spender", "vin", "cooldown")],
    )
    per_tx = judged.where("gate = 0 OR changed").groupBy("txid").agg(F.sum(F.col("changed").cast("long")).alias("n_changed"))
    tx = tx_with_blocks(state).join(per_tx, "txid", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)))
    hit = F.col("n_changed") > 0
    tx = tx.withColumns({
        "spent_utxos": F.col("spent_utxos") + F.col("n_changed") * spent_change,
        "generation": F.when(hit, next_generation(F.col("generation"))).otherwise(F.col("generation")),
        "updated_at": F.when(hit, stamp(now_ms)).otherwise(F.col("updated_at")),
    })
    if heights:
        tx = with_evaluation(tx, heights, hit, F.col("n_blocks") > 0)
    return state.but(tx=tx.select(*state.tx.columns, *[c for c in ("signal", "overflow") if c in tx.columns]), utxo=utxo)


def spend(state: State, items: DataFrame, heights: Heights, ignore_conflicting: bool = False, ignore_locked: bool = False, now_ms: int | None = None) -> Result:
    """Spends slots; the answer of a failed item carries what the slot holds (by_spender, by_vin)."""
    # Spending data of FF bytes alone mark a frozen slot and cannot be a spender's.
    reserved = F.coalesce(is_reserved(F.concat("spender", le_bytes(F.col("vin"), 4))), F.lit(False))
    if "reserved" in items.columns:
        reserved |= F.coalesce(F.col("reserved"), F.lit(False))
    gates = Gates(not ignore_conflicting, not ignore_locked, True)
    df = _looked_up(state, items)
    gate = _gate(gates, heights.current, F.when(reserved, E["INVALID_SPEND"]))
    gate = F.when(gate != 0, gate).when(F.col("hash") != F.col("s_hash"), E["UTXO_HASH_MISMATCH"]).otherwise(0)
    gone = state.children.where("kind = 'deleted'").select(F.col("parent").alias("txid"), F.col("child").alias("spender"), F.lit(True).alias("gone")).distinct()
    df = df.withColumn("gate", gate).join(gone, ["txid", "spender"], "left")
    df = df.withColumn("won", _first(F.struct("spender", "vin")))
    first = (F.col("gate") == 0) & (F.col("won.seq") == F.col("seq"))
    df = df.withColumns({"w_spender": F.col("won.v.spender"), "w_vin": F.col("won.v.vin")})
    status = F.col("s_status")
    open_ = (status == C.UNSPENT) & (F.col("s_cooldown") <= heights.current)
    code = (
        F.when(F.col("gate") != 0, F.col("gate"))
        .when((status == C.UNSPENT) & ~open_, E["FROZEN_UNTIL"])
        .when(open_, F.when(first | _same("w_spender", "w_vin"), F.when(~first & F.col("gone").isNotNull(), E["DELETED_CHILDREN"]).otherwise(0)).otherwise(E["ALREADY_SPENT"]))
        .when(status == C.SPENT, F.when(_same("s_spender", "s_vin"), F.when(F.col("gone").isNotNull(), E["DELETED_CHILDREN"]).otherwise(0)).otherwise(E["ALREADY_SPENT"]))
        .when(status == C.FROZEN, E["FROZEN"])
        .otherwise(E["INVALID_SPEND"])
    )
    changed = first & open_
    df = df.withColumns({"code": code.cast("long"), "changed": F.coalesce(changed, F.lit(False))})
    told = F.col("code").isin(E["ALREADY_SPENT"], E["INVALID_SPEND"]) & (F.col("gate") == 0)
    df = df.withColumns({
        "idempotent": (F.col("code") == 0) & ~F.col("changed"),
        "by_spender": F.when(told, F.when(open_, F.col("w_spender")).otherwise(F.col("s_spender"))),
        "by_vin": F.when(told, F.when(open_, F.col("w_vin")).otherwise(F.col("s_vin"))),
    })
    slots = df.where("changed").select("txid", "vout", F.col("s_hash").alias("n_hash"), F.lit(C.SPENT).cast("long").alias("n_status"), F.col("spender").alias("n_spender"), F.col("vin").alias("n_vin"), F.lit(0).cast("long").alias("n_cooldown"))
    return Result(_settle(state, df, slots, 1, heights, now_ms), df.select(*items.columns, "code", "idempotent", "by_spender", "by_vin"))


def unspend(state: State, items: DataFrame, heights: Heights, now_ms: int | None = None) -> Result:
    """Clears slots that the named spender holds; anything else than a wrong hash or a pruned slot is no error."""
    df = _looked_up(state, items)
    gate = _gate(Gates(), heights.current)
    gate = F.when(gate != 0, gate).when(F.col("hash") != F.col("s_hash"), E["UTXO_HASH_MISMATCH"]).when(F.col("s_status") == C.PRUNED, E["INVALID_SPEND"])
    df = df.withColumn("gate", gate.when((F.col("s_status") == C.SPENT) & _same("s_spender", "s_vin"), 0).otherwise(-1))
    df = df.withColumn("won", _first(F.lit(True)))
    changed = (F.col("gate") == 0) & (F.col("won.seq") == F.col("seq"))
    df = df.withColumns({"changed": changed, "code": F.greatest("gate", F.lit(0)).cast("long")})
    df = df.withColumn("idempotent", (F.col("code") == 0) & ~F.col("changed"))
    nothing = F.lit(None)
    slots = df.where("changed").select("txid", "vout", F.col("s_hash").alias("n_hash"), F.lit(C.UNSPENT).cast("long").alias("n_status"), nothing.cast("binary").alias("n_spender"), nothing.cast("long").alias("n_vin"), F.lit(0).cast("long").alias("n_cooldown"))
    return Result(_settle(state, df, slots, -1, heights, now_ms), df.select(*items.columns, "code", "idempotent"))


def _freezing(state: State, items: DataFrame, on: bool, now_ms: int | None) -> Result:
    df = _looked_up(state, items)
    gate = _gate(Gates(), 0)
    gate = F.when(gate != 0, gate).when(F.col("hash") != F.col("s_hash"), E["UTXO_HASH_MISMATCH"])
    if on:
        gate = gate.when(F.col("s_status") == C.FROZEN, E["ALREADY_FROZEN"]).when(F.col("s_status") == C.SPENT, E["ALREADY_SPENT"]).when(F.col("s_status") == C.PRUNED, E["INVALID_SPEND"])
    else:
        gate = gate.when(F.col("s_status") != C.FROZEN, E["UTXO_NOT_FROZEN"])
    df = df.withColumn("gate", gate.otherwise(0)).withColumn("won", _first(F.lit(True)))
    df = df.withColumn("changed", (F.col("gate") == 0) & (F.col("won.seq") == F.col("seq")))
    later = E["ALREADY_FROZEN" if on else "UTXO_NOT_FROZEN"]
    df = df.withColumn("code", F.when(F.col("gate") != 0, F.col("gate")).when(F.col("changed"), 0).otherwise(later).cast("long"))
    told = F.col("code") == E["ALREADY_SPENT"]
    df = df.withColumns({"by_spender": F.when(told, F.col("s_spender")), "by_vin": F.when(told, F.col("s_vin"))})
    slots = df.where("changed").select("txid", "vout", F.col("s_hash").alias("n_hash"), F.lit(C.FROZEN if on else C.UNSPENT).cast("long").alias("n_status"), F.col("s_spender").alias("n_spender"), F.col("s_vin").alias("n_vin"), F.col("s_cooldown").alias("n_cooldown"))
    out = _settle(state, df, slots, 0, None, now_ms)
    return Result(out, df.select(*items.columns, "code", F.lit(False).alias("idempotent"), *(["by_spender", "by_vin"] if on else [])))


def freeze(state: State, items: DataFrame, now_ms: int | None = None) -> Result:
    """Freezes unspent slots; the cooldown is kept."""
    return _freezing(state, items, True, now_ms)


def unfreeze(state: State, items: DataFrame, now_ms: int | None = None) -> Result:
    """Frozen slots become unspent again with the cooldown they had."""
    return _freezing(state, items, False, now_ms)


def reassign(state: State, items: DataFrame, block_height: int, spendable_after: int, now_ms: int | None = None) -> Result:
    """Gives frozen slots a new hash and a cooldown; the record is never all spent again.

    A later item on the same slot meets the new hash and a slot that is no longer
    frozen. The audit gets a row for each change.
    """
    until = block_height + spendable_after
    df = _looked_up(state, items)
    # The slot's place is checked before the record's flags here.
    gate = _chain([
        (F.col("t_utxo_count").isNull(), "TX_NOT_FOUND"),
        (F.col("vout") >= F.col("t_utxo_count"), "VOUT_OUT_OF_RANGE"),
        (has_flag("t_flags", C.CONFLICTING), "CONFLICTING"),
        (effectively_locked(F.col("t_flags"), F.col("t_n_blocks")), "LOCKED"),
        ((F.col("t_spending_height") > 0) & (F.col("t_spending_height") > block_height), "COINBASE_IMMATURE"),
    ])
    if until > C.U32_MAX:
        gate = F.when(gate == 0, E["STORAGE_IO"]).otherwise(gate)
    df = df.withColumn("record_gate", gate)
    slot_gate = F.when(F.col("hash") != F.col("s_hash"), E["UTXO_HASH_MISMATCH"]).when(F.col("s_status") != C.FROZEN, E["UTXO_NOT_FROZEN"]).otherwise(0)
    df = df.withColumn("gate", F.when(F.col("record_gate") != 0, F.col("record_gate")).otherwise(slot_gate))
    df = df.withColumn("won", _first(F.col("new_hash")))
    df = df.withColumn("changed", (F.col("gate") == 0) & (F.col("won.seq") == F.col("seq")))
    after = (F.col("record_gate") == 0) & (F.col("won.seq") < F.col("seq"))
    code = (
        F.when(F.coalesce(after, F.lit(False)), F.when(F.col("hash") != F.col("won.v"), E["UTXO_HASH_MISMATCH"]).otherwise(E["UTXO_NOT_FROZEN"]))
        .when(F.col("gate") != 0, F.col("gate")).otherwise(0)
    )
    df = df.withColumn("code", code.cast("long"))
    nothing = F.lit(None)
    slots = df.where("changed").select("txid", "vout", F.col("new_hash").alias("n_hash"), F.lit(C.UNSPENT).cast("long").alias("n_status"), nothing.cast("binary").alias("n_spender"), nothing.cast("long").alias("n_vin"), F.lit(until).cast("long").alias("n_cooldown"))
    out = _settle(state, df, slots, 0, None, now_ms)
    touched = df.where("changed").groupBy("txid").agg(F.count(F.lit(1)).alias("n_new"))
    tx = out.tx.join(touched, "txid", "left").withColumns({
        "flags": F.when(F.col("n_new") > 0, set_flag(F.col("flags"), C.REASSIGNED, F.lit(True))).otherwise(F.col("flags")),
        "reassignment_count": F.col("reassignment_count") + F.coalesce("n_new", F.lit(0)),
    }).drop("n_new")
    audit = df.where("changed").select("txid", "vout", F.col("hash").alias("old_hash"), "new_hash", F.lit(block_height).cast("long").alias("block_height"))
    return Result(out.but(tx=tx), df.select(*items.columns, "code", F.lit(False).alias("idempotent")), audit)
