"""The state as DataFrames.

``tx``: txid (binary), tx_version, locktime, fee, size_in_bytes, flags,
spending_height, created_at, utxo_count, spent_utxos, pruned_utxos, generation,
updated_at, reassignment_count, unmined_since, delete_at_height, preserve_until.
``utxo``: txid, vout, hash, status, spender, vin, cooldown.
``block``: txid, block_id, block_height, subtree_idx.
``children``: parent, child, kind ("conflicting" or "deleted").

Unsigned 32-bit values are LONG. Slots are rows, not arrays, so a record with a
hundred thousand outputs is not a row that every operation rewrites.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TX = (
    "txid binary, tx_version bigint, locktime bigint, fee bigint, size_in_bytes bigint, flags bigint, spending_height bigint, "
    "created_at bigint, utxo_count bigint, spent_utxos bigint, pruned_utxos bigint, generation bigint, updated_at bigint, "
    "reassignment_count bigint, unmined_since bigint, delete_at_height bigint, preserve_until bigint"
)
UTXO = "txid binary, vout bigint, hash binary, status bigint, spender binary, vin bigint, cooldown bigint"
BLOCK = "txid binary, block_id bigint, block_height bigint, subtree_idx bigint"
CHILDREN = "parent binary, child binary, kind string"


@dataclass(frozen=True)
class State:
    tx: DataFrame
    utxo: DataFrame
    block: DataFrame
    children: DataFrame

    def __post_init__(self) -> None:
        self.tx.sparkSession.conf.set(CO_PARTITION_SETTING, "false")

    @staticmethod
    def empty(spark: SparkSession) -> "State":
        return State(*[spark.createDataFrame([], s) for s in (TX, UTXO, BLOCK, CHILDREN)])

    def but(self, **changed: DataFrame) -> "State":
        return replace(self, **changed)


@dataclass(frozen=True)
class Heights:
    """What a request says of time: the current block height and the retention in blocks."""

    current: int
    retention: int = 288


#: Off: a join on a record and more (slot, spender, child) takes its sides as they lie by record, without a shuffle of its own.
CO_PARTITION_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def stamp(now_ms: int | None) -> Column:
    """The time that effective mutations leave in updated_at: what the caller says, else the clock."""
    return F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms).cast("long")


@dataclass(frozen=True)
class Result:
    """The state after a batch, a row for each item (with code and idempotent), and rows for the audit if any."""

    state: State
    items: DataFrame
    audit: DataFrame | None = None
