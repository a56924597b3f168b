"""Batch payloads: a count, shared parameters and items of fixed width, little-endian, written and read as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions.scalars import le_bytes, le_uint

# What stands in each batch between its count and its items, then what an item holds; widths in bytes, 32 and 36 being raw.
HEIGHTS = (("current_block_height", 4), ("block_height_retention", 4))
SLOT = (("txid", 32), ("vout", 4), ("hash", 32))
LAYOUTS = {
    "spend": ((("ignore_conflicting", 1), ("ignore_locked", 1), *HEIGHTS), (*SLOT, ("spending_data", 36))),
    "unspend": (HEIGHTS, (*SLOT, ("spending_data", 36))),
    "set_mined": ((("block_id", 4), ("block_height", 4), ("subtree_idx", 4), ("on_longest_chain", 1), ("unset_mined", 1), *HEIGHTS), (("txid", 32),)),
    "reassign": ((("block_height", 4), ("spendable_after", 4)), (*SLOT, ("new_hash", 32))),
    "slots": ((), SLOT),
    "get": ((("field_mask", 4),), (("txid", 32),)),
    "children": ((), (("parent", 32), ("child", 32))),
    "get_spend_response": ((), (("status", 1), ("error_code", 2), ("slot_status", 1), ("spending_data", 36))),
}
RAW = 32  #: fields of this width or more are bytes, others numbers


def _write(value: Column, width: int) -> Column:
    return value if width >= RAW else le_bytes(value.cast("long"), width)


def _read(raw: Column, at: Column | int, width: int) -> Column:
    """The field of a width at an offset (from 0)."""
    part = F.substring(raw, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(width))
    return part if width >= RAW else le_uint(part, 0, width)


def encode(items: DataFrame, kind: str, batch: str, seq: str, header: dict[str, Column] | None = None) -> DataFrame:
    """batch, n_items and payload, a row for each batch; items in the order of seq. More than 8192 items in one are an error."""
    shared, fields = LAYOUTS[kind]
    item = F.concat(*[_write(F.col(n), w) for n, w in fields])
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), item.alias("item"))))
    df = items.groupBy(batch).agg(rows.alias("rows")).withColumn("n_items", F.size("rows"))
    count = F.when(F.col("n_items") > C.MAX_BATCH, F.raise_error(F.lit(f"a batch has more than {C.MAX_BATCH} items")).cast("int")).otherwise(F.col("n_items"))
    body = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["item"])), ""))
    payload = F.concat(le_bytes(count.cast("long"), 4), *[_write(header[n], w) for n, w in shared], body)
    # Through a generator, so that a reader's many looks at the payload do not each put it together again.
    return df.select(batch, F.col("n_items").cast("long").alias("n_items"), F.explode(F.array(payload)).alias("payload"))


def decode(payload: Column, kind: str, most: int = C.MAX_BATCH) -> Column:
    """struct(code, the shared parameters, items): code 28 and no items if the payload is too short for its count or the count beyond the bound."""
    shared, fields = LAYOUTS[kind]
    start, width = 4 + sum(w for _, w in shared), sum(w for _, w in fields)
    count = le_uint(F.substring(payload, F.lit(1), F.lit(4)), 0, 4)
    whole = F.length(payload) >= start
    ok = F.coalesce(whole & (count <= most) & (F.length(payload) - start >= count * width), F.lit(False))

    def item(x: Column) -> Column:
        raw, at, out = F.unhex(x), 0, []
        for n, w in fields:
            out.append(_read(raw, at, w).alias(n))
            at += w
        return F.struct(*out)

    # The items are cut in one pass over the digits; every look into the payload itself would copy it whole.
    digits = F.when(ok & (count > 0), F.hex(F.substring(payload, F.lit(start + 1), (count * width).cast("int")))).otherwise("")
    cut = F.regexp_extract_all(digits, F.lit(f"[0-9A-F]{{{2 * width}}}"), F.lit(0))
    values, at = [], 4
    for n, w in shared:
        values.append(F.when(whole, _read(payload, at, w)).alias(n))
        at += w
    return F.struct(F.when(ok, 0).otherwise(C.ERRORS["PAYLOAD_MALFORMED"]).cast("long").alias("code"), *values, F.transform(cut, item).alias("items"))
