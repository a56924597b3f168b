"""Reads: point lookups with a field mask, slot reads, keyset pages, and the response budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from .state import State

E = C.ERRORS


def fields_of(mask: int) -> list[str]:
    return [f for i, f in enumerate(C.FIELDS) if mask >> i & 1]


def get(state: State, items: DataFrame, mask: int = C.ALL_METADATA) -> DataFrame:
    """A row for each item (txid, seq): status and the columns that the mask asks for, null where there is no record.

    Only the sections asked for are read: slots, blocks and children are joined on demand.
    """
    wanted = fields_of(mask)
    own = [c for c in wanted if c in state.tx.columns]
    out = items.join(state.tx.select("txid", *own, F.lit(True).alias("__known")), "txid", "left")
    out = out.withColumn("status", F.when(F.col("__known"), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    ids = items.select("txid").distinct()
    if {"block_entry_count", "block_entries", "block_entries_all"} & set(wanted):
        blocks = state.block.join(ids, "txid", "left_semi").groupBy("txid").agg(F.sort_array(F.collect_list(F.struct("block_id", "block_height", "subtree_idx"))).alias("__b"))
        out = out.join(blocks, "txid", "left")
        known = F.col("__known")
        out = out.withColumns({
            "block_entry_count": F.when(known, F.coalesce(F.size("__b"), F.lit(0)).cast("long")),
            "block_entries": F.slice(F.col("__b"), 1, 3),
            "block_entries_all": F.col("__b"),
        }).drop("__b")
        own += [c for c in ("block_entry_count", "block_entries", "block_entries_all") if c in wanted]
    if "utxo_slots" in wanted:
        slots = state.utxo.join(ids, "txid", "left_semi").groupBy("txid").agg(F.sort_array(F.collect_list(F.struct("vout", "hash", "status", "spender", "vin", "cooldown"))).alias("utxo_slots"))
        out, own = out.join(slots, "txid", "left"), [*own, "utxo_slots"]
    if "conflicting_children" in wanted:
        children = state.children.where("kind = 'conflicting'").join(ids.withColumnRenamed("txid", "parent"), "parent", "left_semi")
        children = children.groupBy(F.col("parent").alias("txid")).agg(F.sort_array(F.collect_set("child")).alias("conflicting_children"))
        out, own = out.join(children, "txid", "left"), [*own, "conflicting_children"]
    return out.select(*items.columns, "status", *own)


def get_spend(state: State, items: DataFrame) -> DataFrame:
    """A row for each slot item: code, the slot's status and who spent it."""
    known = state.tx.select("txid", "utxo_count")
    slot = state.utxo.select("txid", "vout", F.col("hash").alias("s_hash"), F.col("status").alias("slot_status"), F.col("spender").alias("s_spender"), F.col("vin").alias("s_vin"))
    df = items.join(known, "txid", "left").join(slot, ["txid", "vout"], "left")
    code = (
        F.when(F.col("utxo_count").isNull(), E["TX_NOT_FOUND"]).when(F.col("vout") >= F.col("utxo_count"), E["VOUT_OUT_OF_RANGE"])
        .when(F.col("hash") != F.col("s_hash"), E["UTXO_HASH_MISMATCH"]).otherwise(0).cast("long")
    )
    fine = F.col("code") == 0
    return df.withColumn("code", code).select(
        *items.columns, "code", F.when(fine, F.col("slot_status")).alias("slot_status"), F.when(fine, F.col("s_spender")).alias("by_spender"), F.when(fine, F.col("s_vin")).alias("by_vin")
    )


def within_budget(items: DataFrame, batch: str, seq: str, size: str, budget: int = C.MAX_FRAME_BYTES) -> DataFrame:
    """Which answers of a response fit: in order, an item that does not fit is refused and costs its header only, smaller ones after it may fit.

    The decision for an item depends on all decisions before it, so each response
    (at most 8192 items, more are an error) is folded in order to the refused ones. Adds ``fits``.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))))
    start = F.struct(F.lit(C.FRAME_OVERHEAD).cast("long").alias("used"), F.array().cast("array<bigint>").alias("refused"))

    def step(a: Column, x: Column) -> Column:
        cost = x["size"] + C.ITEM_OVERHEAD
        fits = a["used"] + cost <= budget
        return F.struct(
            (a["used"] + F.when(fits, cost).otherwise(C.ITEM_OVERHEAD)).cast("long").alias("used"),
            F.when(fits, a["refused"]).otherwise(F.array_append(a["refused"], x["seq"])).alias("refused"),
        )

    bounded = F.when(F.size("l") > C.MAX_BATCH, F.raise_error(F.lit(f"a batch has more than {C.MAX_BATCH} items")).cast("array<struct<seq:bigint,size:bigint>>")).otherwise(F.col("l"))
    folded = items.groupBy(batch).agg(ordered.alias("l")).select(batch, F.aggregate(bounded, start, step, lambda a: a["refused"]).alias("refused"))
    refused = folded.select(batch, F.explode("refused").alias(seq), F.lit(False).alias("fits"))
    return items.join(refused, [batch, seq], "left").withColumn("fits", F.coalesce("fits", F.lit(True)))


def keyset_page(found: DataFrame, cursor: bytes | None, page: int) -> DataFrame:
    """One page of txids in order after the cursor; ``truncated`` says whether more follow. A top-k: only page + 1 rows leave each task."""
    after = found if cursor is None else found.where(F.col("txid") > F.lit(cursor))
    rows = after.select("txid").orderBy("txid").limit(page + 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("txid"))
    return rows.select("txid", (n > page).alias("truncated"), place.alias("place")).where(F.col("place") <= page).drop("place")


def old_unmined(state: State, cutoff: int) -> DataFrame:
    return state.tx.where(F.col("unmined_since").between(1, cutoff)).select("txid")


def conflicting(state: State) -> DataFrame:
    return state.tx.where(F.col("flags").bitwiseAND(F.lit(C.CONFLICTING)) != 0).select("txid")


def union_of_nodes(*found: DataFrame) -> DataFrame:
    """What several nodes answer, each txid once."""
    out = found[0].select("txid")
    for f in found[1:]:
        out = out.unionByName(f.select("txid"))
    return out.distinct()
