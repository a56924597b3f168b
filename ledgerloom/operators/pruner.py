"""The height-driven pruner: preserving parents, due records, expired preservations, blobs and tombstones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import all_spent, has_flag, next_generation
from . import records
from .reads import old_unmined
from .slots import tx_with_blocks
from .state import Result, State, stamp


def due_in_order(state: State, height: int, limit: int | None = None) -> DataFrame:
    """Records whose height of deletion has come, by height and txid."""
    out = state.tx.where(F.col("delete_at_height").between(1, height)).select("txid", "delete_at_height").orderBy("delete_at_height", "txid")
    return out.limit(limit) if limit is not None else out


def is_due(height: int) -> Column:
    """The check that a sweep makes again; on tx with n_blocks."""
    finished = all_spent(F.col("spent_utxos"), F.col("utxo_count"), F.col("flags"), C.REASSIGNED) & (F.col("n_blocks") > 0) & (F.col("unmined_since") == 0)
    return (F.col("preserve_until") == 0) & F.col("delete_at_height").between(1, height) & (has_flag("flags", C.CONFLICTING) | finished)


def sweep(state: State, height: int, now_ms: int | None = None) -> Result:
    """Deletes what is due; answers are the candidates with code 0 or NOT_DUE."""
    seen = tx_with_blocks(state).where(F.col("delete_at_height").between(1, height)).select("txid", F.when(is_due(height), 0).otherwise(C.ERRORS["NOT_DUE"]).cast("long").alias("code"))
    done = records.delete(state, seen.where("code = 0").select("txid"), height, cause=0, now_ms=now_ms)
    return Result(done.state, seen, done.audit)


def expire_preservations(state: State, height: int, retention: int = C.RETENTION, now_ms: int | None = None) -> State:
    """Preservations that have run out end; a record that is finished gets a height of deletion, others none."""
    tx = tx_with_blocks(state)
    over = F.col("preserve_until").between(1, height)
    finished = all_spent(F.col("spent_utxos"), F.col("utxo_count"), F.col("flags"), C.REASSIGNED) & (F.col("n_blocks") > 0) & (F.col("unmined_since") == 0)
    at = F.when(has_flag("flags", C.CONFLICTING) | finished, height + retention).otherwise(0).cast("long")
    tx = tx.withColumn("__over", over).withColumns({
        "delete_at_height": F.when(F.col("__over"), at).otherwise(F.col("delete_at_height")),
        "preserve_until": F.when(F.col("__over"), 0).otherwise(F.col("preserve_until")).cast("long"),
        "generation": F.when(F.col("__over"), next_generation(F.col("generation"))).otherwise(F.col("generation")),
        "updated_at": F.when(F.col("__over"), stamp(now_ms)).otherwise(F.col("updated_at")),
    })
    return state.but(tx=tx.select(*state.tx.columns))


def process_expired(state: State, height: int, retention: int | None = C.RETENTION, now_ms: int | None = None) -> Result:
    """Expires preservations (unless an old client gives no retention), then sweeps."""
    return sweep(state if retention is None else expire_preservations(state, height, retention, now_ms), height, now_ms)


def parents_of(state: State, children: DataFrame) -> DataFrame:
    """The records that have a slot spent by one of the children."""
    return records.spent_slots(state, children).select("txid").distinct()


def preserve_parents(state: State, cutoff: int, until: int, now_ms: int | None = None) -> Result:
    """Parents of old unmined records are kept until a height."""
    return records.preserve_until(state, parents_of(state, old_unmined(state, cutoff)), until, now_ms)


@dataclass(frozen=True)
class Pruned:
    state: State
    preserved: DataFrame
    swept: DataFrame
    tombstones: DataFrame


def prune(state: State, height: int, retention: int = C.RETENTION, unmined: int = C.UNMINED_RETENTION, parents: int = C.PARENT_RETENTION, now_ms: int | None = None) -> Pruned:
    """The phases in order: preserve parents, expire preservations, sweep."""
    first = preserve_parents(state, height - unmined, height + parents, now_ms)
    last = process_expired(first.state.but(tx=first.state.tx.drop("signal")), height, retention, now_ms)
    return Pruned(last.state, first.items, last.items, last.audit)


def blob_verdicts(blobs: DataFrame, state: State, now_ms: int, grace_ms: int = 60_000) -> DataFrame:
    """A verdict for each blob (txid, mtime_ms, pinned): skipped, kept, deleted_no_index or deleted_not_external."""
    known = state.tx.select("txid", has_flag("flags", C.EXTERNAL).alias("external"))
    young = F.col("mtime_ms") > now_ms - grace_ms
    verdict = (
        F.when(F.col("pinned") | young, "skipped").when(F.col("external").isNull(), "deleted_no_index")
        .when(~F.col("external"), "deleted_not_external").otherwise("kept")
    )
    return blobs.join(known, "txid", "left").withColumn("verdict", verdict).drop("external")


def heals(tombstones: DataFrame, incoming: DataFrame) -> DataFrame:
    """Whether an incoming record (txid, generation) may take the place of a tombstone: none there, or one of a sweep with an older generation."""
    t = tombstones.select("txid", F.col("generation").alias("t_generation"), "cause")
    may = F.col("t_generation").isNull() | ((F.col("cause") == 0) & (F.col("generation") > F.col("t_generation")))
    return incoming.join(t, "txid", "left").withColumn("may", may).drop("t_generation", "cause")


def collect_tombstones(tombstones: DataFrame, durable_height: int, retention: int, protected: DataFrame) -> DataFrame:
    """Those that stay: not yet old enough, or protected."""
    old = tombstones.where(F.col("deletion_height") + retention <= durable_height)
    free = old.join(protected.select("txid").distinct(), "txid", "left_anti").select("txid")
    return tombstones.join(free, "txid", "left_anti")


def reconcile(tombstones: DataFrame, state: State) -> DataFrame:
    """Tombstones over a live record go."""
    return tombstones.join(state.tx.select("txid"), "txid", "left_anti")
