"""Binary forms: slots with checksum, frames, and blobs in chunks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import is_reserved, le_bytes, le_bytes64, le_uint, le_uint64, lit_hex


def slot_bytes(hash_: Column, status: Column, spender: Column, vin: Column, cooldown: Column) -> Column:
    """hash (32), status (1), data (36), CRC-32 (4): 73 bytes. Data are the spender and its input, or the cooldown and zeros (FF if frozen)."""
    rest = F.when(status == C.FROZEN, lit_hex("FF" * 32)).otherwise(lit_hex("00" * 32))
    data = F.when(status.isin(C.SPENT, C.PRUNED), F.concat(spender, le_bytes(vin, 4))).otherwise(F.concat(le_bytes(cooldown, 4), rest))
    body = F.concat(hash_, le_bytes(status, 1), data)
    return F.concat(body, le_bytes(F.crc32(body), 4))


def parse_slot(raw: Column) -> Column:
    """struct(hash, status, spender, vin, cooldown, intact)."""
    status, data = le_uint(raw, 32, 1), F.substring(raw, 34, 36)
    held = status.isin(C.SPENT, C.PRUNED)
    legacy = is_reserved(data)
    return F.struct(
        F.substring(raw, 1, 32).alias("hash"), status.alias("status"), F.when(held, F.substring(data, 1, 32)).alias("spender"),
        F.when(held, le_uint(data, 32, 4)).alias("vin"), F.when(held | legacy, 0).otherwise(le_uint(data, 0, 4)).cast("long").alias("cooldown"),
        ((F.length(raw) == C.SLOT_BYTES) & (F.crc32(F.substring(raw, 1, 69)) == le_uint(raw, 69, 4))).alias("intact"),
    )


def frame(request_id: Column, op: Column, flags: Column, payload: Column) -> Column:
    """Length (4), request (8), operation (2), flags (2), payload; all little-endian, the length being of what follows."""
    body = F.concat(le_bytes64(request_id), le_bytes(op, 2), le_bytes(flags, 2), payload)
    return F.concat(le_bytes(F.length(body), 4), body)


def parse_frame(raw: Column) -> Column:
    """struct(request_id, op, flags, payload, whole); whole: the length is right and within the bound."""
    n = le_uint(raw, 0, 4)
    return F.struct(
        le_uint64(raw, 4).alias("request_id"), le_uint(raw, 12, 2).alias("op"), le_uint(raw, 14, 2).alias("flags"), F.substring(raw, 17, 1 << 30).alias("payload"),
        ((n == F.length(raw) - 4) & (n <= C.MAX_FRAME_BYTES)).alias("whole"),
    )


def assemble(chunks: DataFrame, key: str = "key") -> DataFrame:
    """Blobs from chunks (key, at, data): code 18 if the offsets leave a gap or overlap, else 0; size and SHA-256.

    A blob is one row in the end, so its chunks meet in one task; its size is bounded by the store.
    """
    parts = F.array_sort(F.collect_list(F.struct("at", "data")))
    df = chunks.groupBy(key).agg(parts.alias("p"))
    whole = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("next"), F.lit(True).alias("ok")), lambda a, x: F.struct((a["next"] + F.length(x["data"])).cast("long").alias("next"), (a["ok"] & (x["at"] == a["next"])).alias("ok")))
    df = df.withColumn("w", whole).withColumn("body", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), "")))
    ok = F.col("w.ok")
    return df.select(key, F.when(ok, 0).otherwise(C.ERRORS["STREAM_OFFSET_MISMATCH"]).cast("long").alias("code"), F.when(ok, F.col("w.next")).otherwise(-1).alias("size"), F.when(ok, F.sha2("body", 256)).otherwise("").alias("sha256"))
