"""Operations on whole records: create, mine, flag, preserve, mark, delete, and the lists of children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import has_flag, next_generation, set_flag
from .lifecycle import with_evaluation
from .slots import tx_with_blocks
from .state import Heights, Result, State, stamp

E = C.ERRORS


def _answered(state: State, items: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    known = state.tx.select("txid", F.lit(True).alias("known"))
    out = items.join(known, "txid", "left").withColumn("code", F.when(F.col("known").isNull(), E["TX_NOT_FOUND"]).otherwise(0).cast("long"))
    return out.drop("known").withColumns(also or {})


def _touched(state: State, items: DataFrame) -> DataFrame:
    """tx with n_blocks and hit: whether any item names the record."""
    named = items.select("txid").distinct().withColumn("hit", F.lit(True))
    return tx_with_blocks(state).join(named, "txid", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _change(tx: DataFrame, changed: Column, values: dict[str, Column], now_ms: int | None) -> DataFrame:
    """Changed records get the values, the next generation and the time."""
    values = values | {"generation": next_generation(F.col("generation")), "updated_at": stamp(now_ms)}
    return tx.withColumns({k: F.when(changed, v).otherwise(F.col(k)) for k, v in values.items()})


def _columns(state: State, tx: DataFrame) -> DataFrame:
    return tx.select(*state.tx.columns, *[c for c in ("signal", "overflow") if c in tx.columns and c not in state.tx.columns])


def create(state: State, items: DataFrame, hashes: DataFrame, parents: DataFrame | None = None) -> Result:
    """New records. items: txid, seq, request_flags, is_coinbase, has_blob, block_height, mined_block (null if none), fields of tx;
    hashes: txid, seq, vout, hash; parents: txid, seq, parent; the first item of a txid that may be created wins, later ones exist already.
    A record that is created conflicting is put on the lists of its parents."""
    counts = hashes.groupBy("txid", "seq").agg(F.count(F.lit(1)).alias("n"))
    df = items.join(counts, ["txid", "seq"], "left").join(state.tx.select("txid", F.lit(True).alias("known")), "txid", "left")
    too_many = F.col("n") > C.MAX_HASHES
    if parents is not None:
        df = df.join(parents.groupBy("txid", "seq").agg(F.count(F.lit(1)).alias("n_parents")), ["txid", "seq"], "left")
        too_many |= F.coalesce("n_parents", F.lit(0)) > C.MAX_PARENTS
    external = has_flag("request_flags", C.CREATE_EXTERNAL)
    own = (
        F.when(F.col("known"), E["ALREADY_EXISTS"]).when((F.coalesce("n", F.lit(0)) == 0) | too_many, E["PAYLOAD_MALFORMED"])
        .when(external & ~F.col("has_blob"), E["BLOB_NOT_FOUND"]).otherwise(0)
    )
    first = F.min(F.when(F.col("own") == 0, F.col("seq"))).over(Window.partitionBy("txid"))
    df = df.withColumn("own", own).withColumn("first", first)
    df = df.withColumn("code", F.when(F.col("first") < F.col("seq"), E["ALREADY_EXISTS"]).otherwise(F.col("own")).cast("long"))
    made = df.where("code = 0")
    r = lambda bit: has_flag("request_flags", bit)
    flag = lambda when, bit: F.when(when, bit).otherwise(0)
    zero = F.lit(0).cast("long")
    flags = (
        flag(F.col("is_coinbase"), C.IS_COINBASE) + flag(r(C.CREATE_CONFLICTING), C.CONFLICTING) + flag(r(C.CREATE_LOCKED), C.LOCKED)
        + flag(external, C.EXTERNAL) + flag(r(C.CREATE_REASSIGNED), C.REASSIGNED)
    )
    tx = made.select(
        "txid", "tx_version", "locktime", "fee", "size_in_bytes", flags.cast("long").alias("flags"), "spending_height", "created_at",
        F.col("n").alias("utxo_count"), zero.alias("spent_utxos"), zero.alias("pruned_utxos"), zero.alias("generation"), F.col("created_at").alias("updated_at"),
        zero.alias("reassignment_count"), F.when(F.col("mined_block").isNull(), F.col("block_height")).otherwise(0).cast("long").alias("unmined_since"),
        zero.alias("delete_at_height"), zero.alias("preserve_until"),
    )
    frozen = F.when(r(C.CREATE_FROZEN), C.FROZEN).otherwise(C.UNSPENT).cast("long")
    utxo = hashes.join(made.select("txid", "seq", frozen.alias("status")), ["txid", "seq"]).select(
        "txid", "vout", "hash", "status", F.lit(None).cast("binary").alias("spender"), F.lit(None).cast("long").alias("vin"), zero.alias("cooldown")
    )
    block = made.where("mined_block IS NOT NULL").select("txid", F.col("mined_block").alias("block_id"), "block_height", zero.alias("subtree_idx"))
    after = state.but(tx=state.tx.unionByName(tx), utxo=state.utxo.unionByName(utxo), block=state.block.unionByName(block))
    if parents is not None:
        child = made.where(r(C.CREATE_CONFLICTING)).select("txid", "seq")
        after = add_children(after, parents.join(child, ["txid", "seq"], "left_semi").select("parent", F.col("txid").alias("child"), "seq"), "conflicting")
    return Result(after, df.select(*items.columns, "code"))


def append_children(state: State, pairs: DataFrame, kind: str) -> Result:
    """Appends (parent, child) to the lists in the order of seq, each once and at most 255 a parent.

    Answers are a row for each parent that is offered children: n_added, n_dropped, so
    that what a full list refuses is seen. Only the first 255 of a parent leave a task,
    and parents are looked up after that: pairs meet the lists as they lie by child or parent.
    """
    known = state.tx.select(F.col("txid").alias("parent"))
    listed = state.children.where(F.col("kind") == kind).select("parent", "child")
    new = pairs.groupBy("parent", "child").agg(F.min("seq").alias("seq")).join(listed, ["parent", "child"], "left_anti")
    have = listed.groupBy("parent").agg(F.count(F.lit(1)).alias("have"))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("seq", "child"))
    kept = new.withColumn("place", place).where(F.col("place") <= C.MAX_CHILDREN).join(known, "parent", "left_semi").join(have, "parent", "left")
    kept = kept.where(F.col("place") + F.coalesce("have", F.lit(0)) <= C.MAX_CHILDREN).withColumn("kind", F.lit(kind))
    told = new.groupBy("parent").agg(F.count(F.lit(1)).alias("n_new")).join(known, "parent", "left_semi").join(have, "parent", "left")
    added = F.least(F.col("n_new"), F.greatest(F.lit(0), F.lit(C.MAX_CHILDREN) - F.coalesce("have", F.lit(0))))
    return Result(state.but(children=state.children.unionByName(kept.select("parent", "child", "kind"))), told.select("parent", added.alias("n_added"), (F.col("n_new") - added).alias("n_dropped")))


def add_children(state: State, pairs: DataFrame, kind: str) -> State:
    return append_children(state, pairs, kind).state


def spent_slots(state: State, spenders: DataFrame) -> DataFrame:
    """txid, vout, spender of the slots that the named records (txid) hold as spent. Slots without a spender never meet the join."""
    named = spenders.select(F.col("txid").alias("spender")).distinct()
    return state.utxo.where((F.col("status") == C.SPENT) & F.col("spender").isNotNull()).select("txid", "vout", "spender").join(named, "spender", "left_semi")


def remove_children(state: State, pairs: DataFrame, kind: str = "conflicting") -> Result:
    """Takes pairs off the lists; absent pairs are no error, absent parents are."""
    gone = pairs.select("parent", "child", F.lit(kind).alias("kind")).distinct()
    items = pairs.join(state.tx.select(F.col("txid").alias("parent"), F.lit(True).alias("known")), "parent", "left")
    items = items.withColumn("code", F.when(F.col("known").isNull(), E["TX_NOT_FOUND"]).otherwise(0).cast("long")).drop("known")
    return Result(state.but(children=state.children.join(gone, ["parent", "child", "kind"], "left_anti")), items)


def set_mined(state: State, items: DataFrame, block_id: int, block_height: int, heights: Heights, on_longest_chain: bool = True, subtree_idx: int = 0, now_ms: int | None = None) -> Result:
    """Adds the block to the records once; a 256th block is refused."""
    tx = _touched(state, items).join(state.block.where(F.col("block_id") == block_id).select("txid", F.lit(True).alias("has")).distinct(), "txid", "left")
    full = F.col("has").isNull() & (F.col("n_blocks") >= C.MAX_BLOCK_ENTRIES)
    new = F.col("hit") & F.col("has").isNull() & ~full
    marks = F.col("hit") & ~full & F.lit(on_longest_chain) & (F.col("unmined_since") != 0)
    block = tx.where(new).select("txid", F.lit(block_id).cast("long").alias("block_id"), F.lit(block_height).cast("long").alias("block_height"), F.lit(subtree_idx).cast("long").alias("subtree_idx"))
    refused = tx.where(F.col("hit") & full).select("txid", F.lit(True).alias("full"))
    answers = _answered(state, items).join(refused, "txid", "left").withColumn("code", F.when(F.col("full"), E["INVARIANT_VIOLATION"]).otherwise(F.col("code")).cast("long")).drop("full")
    tx = _change(tx, new | marks, {"unmined_since": F.lit(0).cast("long") if on_longest_chain else F.col("unmined_since")}, now_ms)
    tx = with_evaluation(tx, heights, F.col("hit") & ~full, (F.col("n_blocks") > 0) | new)
    return Result(state.but(tx=_columns(state, tx), block=state.block.unionByName(block)), answers)


def unset_mined(state: State, items: DataFrame, block_id: int, heights: Heights, now_ms: int | None = None) -> Result:
    """Takes the block off; a record without blocks is unmined since the current height."""
    gone = items.select("txid").distinct().withColumn("block_id", F.lit(block_id).cast("long"))
    block = state.block.join(gone, ["txid", "block_id"], "left_anti")
    had = state.block.join(gone, ["txid", "block_id"], "left_semi").select("txid", F.lit(True).alias("had")).distinct()
    left = block.groupBy("txid").agg(F.countDistinct("block_id").alias("n_left"))
    tx = _touched(state, items).join(had, "txid", "left").join(left, "txid", "left").withColumn("n_left", F.coalesce("n_left", F.lit(0)))
    changed = F.coalesce("had", F.lit(False))
    tx = _change(tx, changed, {"unmined_since": F.when(F.col("n_left") == 0, F.lit(heights.current).cast("long")).otherwise(F.col("unmined_since"))}, now_ms)
    tx = with_evaluation(tx, heights, F.col("hit"), F.col("n_left") > 0)
    return Result(state.but(tx=_columns(state, tx), block=block), _answered(state, items))


def set_conflicting(state: State, items: DataFrame, value: bool, heights: Heights, now_ms: int | None = None) -> Result:
    """The stored bit. A record that becomes or is conflicting is put on the lists of its parents, those whose slots it has spent."""
    tx = _touched(state, items)
    tx = _change(tx, F.col("hit") & (has_flag("flags", C.CONFLICTING) != value), {"flags": set_flag(F.col("flags"), C.CONFLICTING, F.lit(value))}, now_ms)
    tx = with_evaluation(tx, heights, F.col("hit"), F.col("n_blocks") > 0)
    after = state.but(tx=_columns(state, tx))
    if value:
        known = items.select("txid").distinct().join(state.tx.select("txid"), "txid", "left_semi")
        pairs = spent_slots(state, known).select(F.col("txid").alias("parent"), F.col("spender").alias("child"), F.col("vout").alias("seq"))
        after = after.but(children=add_children(state, pairs, "conflicting").children)
    return Result(after, _answered(state, items))


def set_locked(state: State, items: DataFrame, value: bool, now_ms: int | None = None) -> Result:
    """The stored bit; locking clears the height of deletion. Answers tell whether the bit was set before."""
    tx = _touched(state, items)
    before = tx.select("txid", has_flag("flags", C.LOCKED).alias("was_locked"))
    values = {"flags": set_flag(F.col("flags"), C.LOCKED, F.lit(value))}
    if value:
        values["delete_at_height"] = F.lit(0).cast("long")
    tx = _change(tx, F.col("hit"), values, now_ms)
    return Result(state.but(tx=_columns(state, tx)), _answered(state, items).join(before, "txid", "left"))


def preserve_until(state: State, items: DataFrame, height: int, now_ms: int | None = None) -> Result:
    """Keeps records until a height; 0 lifts it. External records signal it."""
    tx = _touched(state, items)
    tx = _change(tx, F.col("hit"), {"preserve_until": F.lit(height).cast("long"), "delete_at_height": F.lit(0).cast("long")}, now_ms)
    tx = tx.withColumn("signal", F.when(F.col("hit") & has_flag("flags", C.EXTERNAL), C.SIGNAL_PRESERVE).otherwise(0).cast("long"))
    return Result(state.but(tx=_columns(state, tx)), _answered(state, items))


def mark_longest_chain(state: State, items: DataFrame, on: bool, heights: Heights, now_ms: int | None = None) -> Result:
    tx = _touched(state, items)
    tx = _change(tx, F.col("hit"), {"unmined_since": F.lit(0 if on else heights.current).cast("long")}, now_ms)
    tx = with_evaluation(tx, heights, F.col("hit"), F.col("n_blocks") > 0)
    return Result(state.but(tx=_columns(state, tx)), _answered(state, items))


def increment_spent_extra(items: DataFrame) -> DataFrame:
    """Kept for old clients: every item succeeds and nothing changes."""
    return items.withColumn("code", F.lit(0).cast("long"))


def prune_slots(state: State, children: DataFrame, now_ms: int | None = None) -> State:
    """Slots that the named children (txid) have spent become pruned, and the parents remember the child.

    The few slots hit are found among the spent ones and joined back by their place, so
    the many slots without a spender are no hot key.
    """
    hits = spent_slots(state, children)
    per_tx = hits.groupBy("txid").agg(F.count(F.lit(1)).alias("n_pruned"))
    tx = state.tx.join(per_tx, "txid", "left").withColumn("n_pruned", F.coalesce("n_pruned", F.lit(0)))
    tx = tx.withColumns({
        "spent_utxos": F.col("spent_utxos") - F.col("n_pruned"),
        "pruned_utxos": F.col("pruned_utxos") + F.col("n_pruned"),
        "generation": F.pmod(F.col("generation") + F.col("n_pruned"), F.lit(C.U32_MAX + 1)),
        "updated_at": F.when(F.col("n_pruned") > 0, stamp(now_ms)).otherwise(F.col("updated_at")),
    })
    utxo = state.utxo.join(hits.select("txid", "vout", F.lit(True).alias("hit")), ["txid", "vout"], "left")
    utxo = utxo.withColumn("status", F.when(F.col("hit"), C.PRUNED).otherwise(F.col("status")).cast("long")).select(*state.utxo.columns)
    pairs = hits.select(F.col("txid").alias("parent"), F.col("spender").alias("child"), F.col("vout").alias("seq"))
    return add_children(state.but(tx=tx.select(*state.tx.columns), utxo=utxo), pairs, "deleted")


def delete(state: State, items: DataFrame, height: int = 0, cause: int = 1, now_ms: int | None = None) -> Result:
    """Removes records with their slots, blocks and lists; prunes the slots that they had spent; writes tombstones (audit)."""
    found = items.select("txid").distinct().join(state.tx.select("txid", "generation", "flags"), "txid")
    pruned = prune_slots(state, found, now_ms)
    keep = lambda df, key="txid": df.join(found.select(F.col("txid").alias(key)), key, "left_anti")
    after = State(keep(pruned.tx), keep(pruned.utxo), keep(pruned.block), keep(pruned.children, "parent"))
    tombstones = found.select("txid", "generation", F.lit(height).cast("long").alias("deletion_height"), F.lit(cause).cast("long").alias("cause"))
    return Result(after, _answered(state, items), tombstones)


def rebuild_counters(state: State) -> State:
    """Counts recomputed from slots, as after a crash, instead of trusted."""
    n = state.utxo.groupBy("txid").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("status") == C.SPENT).cast("long")).alias("s"), F.sum((F.col("status") == C.PRUNED).cast("long")).alias("p")
    )
    tx = state.tx.join(n, "txid", "left").withColumns({"utxo_count": F.coalesce("c", F.lit(0)), "spent_utxos": F.coalesce("s", F.lit(0)), "pruned_utxos": F.coalesce("p", F.lit(0))})
    return state.but(tx=tx.select(*state.tx.columns))


def rebuild(headers: DataFrame, slots: DataFrame, block: DataFrame, children: DataFrame, tombstones: DataFrame) -> tuple[State, DataFrame]:
    """The state from what a scan finds, and what was skipped (txid, why).

    headers: columns of tx; slots: columns of utxo and intact. A record under a tombstone of
    its generation or a later one is gone ("tombstone"); one with a damaged slot, or with
    other slots than its header counts, is malformed ("slots"). Counters come from the slots.
    """
    n = slots.groupBy("txid").agg(
        F.count(F.lit(1)).alias("c"), F.bool_and("intact").alias("ok"), F.max("vout").alias("last"),
        F.sum((F.col("status") == C.SPENT).cast("long")).alias("s"), F.sum((F.col("status") == C.PRUNED).cast("long")).alias("p"),
    )
    dead = tombstones.groupBy("txid").agg(F.max("generation").alias("dead"))
    seen = headers.join(n, "txid", "left").join(dead, "txid", "left")
    whole = F.coalesce(F.col("ok") & (F.col("c") == F.col("utxo_count")) & (F.col("last") == F.col("utxo_count") - 1), F.lit(False))
    why = F.when(F.col("dead") >= F.col("generation"), "tombstone").when(~whole, "slots")
    seen = seen.withColumn("why", why)
    tx = seen.where("why IS NULL").withColumns({"spent_utxos": F.col("s"), "pruned_utxos": F.col("p")}).select(*headers.columns)
    live = tx.select("txid")
    utxo = slots.select(*[c for c in slots.columns if c != "intact"]).join(live, "txid", "left_semi")
    kept = State(tx, utxo, block.join(live, "txid", "left_semi"), children.join(live.withColumnRenamed("txid", "parent"), "parent", "left_semi"))
    return kept, seen.where("why IS NOT NULL").select("txid", "why")


__all__ = [
    "add_children", "append_children", "create", "delete", "increment_spent_extra", "mark_longest_chain", "preserve_until", "prune_slots",
    "rebuild", "rebuild_counters", "remove_children", "set_conflicting", "set_locked", "set_mined", "spent_slots", "unset_mined",
]
