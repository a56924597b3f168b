"""Operations as a Structured Stream: one state machine for each key, outcomes as they come.

Order is that of ``seq`` within a micro-batch and of micro-batches otherwise.
Operations at or below the last number that a key has seen are dropped, so a
redelivered batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.codes import FROZEN, SPENT, UNSPENT
from ..runtime import ship

LOG = "key bigint, seq bigint, op string, spender bigint"
OUTCOME = "key bigint, seq bigint, outcome string, status bigint, spender bigint"
STATE = "status bigint, spender bigint, last bigint"


def apply_one(status: int, held: int, op: str, spender: int) -> tuple[int, int, str]:
    """State and outcome (ok, same, failed) after one operation."""
    if op == "spend":
        if status == UNSPENT:
            return SPENT, spender, "ok"
        return status, held, "same" if status == SPENT and held == spender else "failed"
    if op == "unspend":
        return (UNSPENT, -1, "ok") if status == SPENT and held == spender else (status, held, "same")
    if op == "freeze":
        return (FROZEN, -1, "ok") if status == UNSPENT else (status, held, "failed")
    if op == "unfreeze":
        return (UNSPENT, -1, "ok") if status == FROZEN else (status, held, "failed")
    return status, held, "same"


def _machine(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, held, last = state.get if state.exists else (UNSPENT, -1, -1)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, op, spender in zip(rows["seq"].tolist(), rows["op"].tolist(), rows["spender"].tolist(), strict=True):
        if seq <= last:
            continue
        status, held, outcome = apply_one(status, held, op, spender)
        last = seq
        out.append((key[0], seq, outcome, status, held))
    state.update((status, held, last))
    yield pd.DataFrame(out, columns=["key", "seq", "outcome", "status", "spender"])


def outcomes(log: DataFrame) -> DataFrame:
    """The outcome of every operation of a streaming log."""
    ship(log.sparkSession)
    return log.groupBy("key").applyInPandasWithState(_machine, OUTCOME, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(log: DataFrame, folder: str, name: str = "outcomes") -> str:
    """Drains a streaming log into Parquet, each micro-batch under its own number so that a repeated one replaces itself; gives the path."""
    path = f"{folder}/{name}"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = outcomes(log).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{folder}/{name}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return path


def totals(told: DataFrame) -> DataFrame:
    """Outcomes summed up as the batch fold gives them."""
    last = F.max(F.struct("seq", "status", "spender"))
    n = lambda o: F.count_if(F.col("outcome") == o)
    return told.groupBy("key").agg(last.alias("l"), n("ok").alias("n_ok"), n("same").alias("n_same"), n("failed").alias("n_failed")).select(
        "key", "l.status", "l.spender", "n_ok", "n_same", "n_failed"
    )
