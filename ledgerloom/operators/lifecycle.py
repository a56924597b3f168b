"""When a record is due for deletion: one pure expression over its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import all_spent, has_flag, set_flag
from .state import Heights


def evaluate(height: Column, retention: Column, has_blocks: Column) -> Column:
    """struct(signal, dah, last_spent_all, overflow) from the columns of ``tx``; the first rule that applies decides."""
    flags, dah, preserve = F.col("flags"), F.col("delete_at_height"), F.col("preserve_until")
    due = height + retention
    last, external = has_flag(flags, C.LAST_SPENT_ALL), has_flag(flags, C.EXTERNAL)
    every = all_spent(F.col("spent_utxos"), F.col("utxo_count"), flags, C.REASSIGNED)

    def say(signal, at=dah, seen=last, overflow=False):
        signal = F.lit(signal) if isinstance(signal, int) else signal
        return F.struct(signal.cast("long").alias("signal"), at.cast("long").alias("dah"), seen.alias("last_spent_all"), F.lit(overflow).alias("overflow"))

    told = lambda signal: F.when(external, F.lit(signal)).otherwise(F.lit(C.SIGNAL_NONE))
    yes, no = F.lit(True), F.lit(False)
    finished = every & has_blocks & (F.col("unmined_since") == 0)
    return (
        F.when((retention == 0) | (preserve != 0), say(C.SIGNAL_NONE))
        .when(due > C.U32_MAX, say(C.SIGNAL_NONE, overflow=True))
        .when(has_flag(flags, C.CONFLICTING), F.when(dah == 0, say(told(C.SIGNAL_DAH_SET), due)).otherwise(say(C.SIGNAL_NONE)))
        .when(finished & (dah < due), say(told(C.SIGNAL_DAH_SET), due, yes))
        .when(finished, say(C.SIGNAL_NONE, dah, yes))
        .when(dah != 0, say(told(C.SIGNAL_DAH_UNSET), F.lit(0), no))
        .when(every != last, say(F.when(every, C.SIGNAL_ALL_SPENT).otherwise(C.SIGNAL_NOT_ALL_SPENT), dah, every))
        .otherwise(say(C.SIGNAL_NONE))
    )


def with_evaluation(tx: DataFrame, heights: Heights, touched: Column, has_blocks: Column) -> DataFrame:
    """Applies the evaluation to touched records and adds ``signal``; an overflow leaves the record as it is."""
    e = F.when(touched, evaluate(F.lit(heights.current), F.lit(heights.retention), has_blocks))
    out = tx.withColumn("__e", e)
    return out.withColumns({
        "flags": F.when(F.col("__e").isNotNull(), set_flag(F.col("flags"), C.LAST_SPENT_ALL, F.col("__e.last_spent_all"))).otherwise(F.col("flags")),
        "delete_at_height": F.coalesce("__e.dah", "delete_at_height"),
        "signal": F.coalesce("__e.signal", F.lit(0)),
        "overflow": F.coalesce("__e.overflow", F.lit(False)),
    }).drop("__e")
