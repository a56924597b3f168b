"""Mixed operation logs: the ordered fold that batch replay, recovery and the stream share.

A log has key, seq, op (spend, unspend, freeze, unfreeze, read) and spender. One
slot's operations depend on each other in order, so they are folded as one sorted
array by ``aggregate``, inside the JVM. An array holds the operations of one slot
since the last snapshot, which is what bounds it: snapshots are the way to keep a
busy slot short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import FROZEN, SPENT, UNSPENT
from ..functions.scalars import generation_ahead

START = {"status": UNSPENT, "spender": -1, "n_ok": 0, "n_same": 0, "n_failed": 0}


def _struct(**v: Column) -> Column:
    return F.struct(*[c.cast("long").alias(k) for k, c in v.items()])


def step(a: Column, x: Column) -> Column:
    """The state after one operation and what was counted: done, nothing to do, or refused."""
    op, mine = x["op"], a["spender"] == x["spender"]
    free, spent, frozen = a["status"] == UNSPENT, a["status"] == SPENT, a["status"] == FROZEN
    done = ((op == "spend") & free) | ((op == "unspend") & spent & mine) | ((op == "freeze") & free) | ((op == "unfreeze") & frozen)
    same = ((op == "spend") & spent & mine) | (op == "read") | ((op == "unspend") & ~(spent & mine))
    after = F.when(op == "spend", SPENT).when(op == "freeze", FROZEN).otherwise(UNSPENT)
    return _struct(
        status=F.when(done, after).otherwise(a["status"]),
        spender=F.when(done, F.when(op == "spend", x["spender"]).otherwise(-1)).otherwise(a["spender"]),
        n_ok=a["n_ok"] + done.cast("long"), n_same=a["n_same"] + (~done & same).cast("long"), n_failed=a["n_failed"] + (~done & ~same).cast("long"),
    )


def fold(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """State by key after the log, from a base state (key and the columns of START) or from nothing.

    Replaying a log on its own result changes counts of refused and void operations
    only if the base says that they were applied: give only what follows the base.
    """
    ops = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "spender"))).alias("ops"))
    first = _struct(**{k: F.lit(v) for k, v in START.items()})
    if base is not None:
        ops = base.join(ops, "key", "full_outer")
        first = _struct(**{k: F.coalesce(F.col(k), F.lit(v)) for k, v in START.items()})
    empty = F.array().cast("array<struct<seq:bigint,op:string,spender:bigint>>")
    return ops.select("key", F.aggregate(F.coalesce("ops", empty), first, step).alias("s")).select("key", "s.*")


def receive(batches: DataFrame) -> DataFrame:
    """stream, watermark, n_applied, n_duplicate, n_probe and n_gap after batches (stream, arrival, first, last) in the order of arrival.

    A batch without operations (last below first) is a probe. One that ends at or below the
    stream's watermark was applied before; one that begins beyond the next number is
    refused and moves nothing, so that it must be sent again; any other is applied from
    the watermark on. The fold keeps five numbers for each stream.
    """
    start = _struct(watermark=F.lit(0), n_applied=F.lit(0), n_duplicate=F.lit(0), n_probe=F.lit(0), n_gap=F.lit(0))

    def step(a: Column, x: Column) -> Column:
        probe = x["last"] < x["first"]
        duplicate = ~probe & (x["last"] <= a["watermark"])
        gap = ~probe & ~duplicate & (x["first"] > a["watermark"] + 1)
        applied = ~probe & ~duplicate & ~gap
        n = lambda name, when: a[name] + when.cast("long")
        return _struct(
            watermark=F.when(applied, x["last"]).otherwise(a["watermark"]), n_applied=n("n_applied", applied), n_duplicate=n("n_duplicate", duplicate),
            n_probe=n("n_probe", probe), n_gap=n("n_gap", gap),
        )

    ordered = batches.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("arrival", "first", "last")]))).alias("b"))
    return ordered.select("stream", F.aggregate("b", start, step).alias("s")).select("stream", "s.*")


def apply_generations(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """key, generation, value after replicated writes (key, generation, value): on the 32-bit circle the one furthest ahead of the local
    generation wins, and what is not ahead of it is stale and dropped. Ties go to the least value."""
    own = local.select("key", F.col("generation").alias("own"), F.col("value").alias("own_value"))
    far = F.pmod(F.col("generation") - F.coalesce("own", F.lit(0)), F.lit(1 << 32))
    ahead = F.col("own").isNull() | generation_ahead(F.col("generation"), F.col("own"))
    best = incoming.join(own, "key", "left").where(ahead).groupBy("key").agg(F.max_by(F.struct("generation", "value"), F.struct(far, -F.col("value"))).alias("w"))
    both = own.join(best, "key", "full_outer")
    return both.select("key", F.coalesce("w.generation", "own").alias("generation"), F.coalesce("w.value", "own_value").alias("value"))
