"""Scalar functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import ERRORS, FROZEN, LOCKED, SHARDS, U32_MAX


def lit_hex(x: str) -> Column:
    return F.unhex(F.lit(x))


def hex_of(x: Column | str) -> Column:
    return F.lower(F.hex(x))


def byte_at(x: Column | str, i: int) -> Column:
    """The i-th byte (from 0) as a number."""
    return F.conv(F.hex(F.substring(x, i + 1, 1)), 16, 10).cast("long")


def le_uint(x: Column | str, at: int, width: int) -> Column:
    """The little-endian unsigned number of ``width`` (at most 7) bytes at an offset."""
    out = byte_at(x, at)
    for i in range(1, width):
        out = out + byte_at(x, at + i) * F.lit(256**i)
    return out


def le_bytes(x: Column, width: int) -> Column:
    """A number as little-endian bytes."""
    h = F.lpad(F.hex(x.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * (width - i) - 1, 2) for i in range(width)]))


def _power(n: int) -> Column:
    """2**n as a decimal: an unsigned 64-bit number is beyond BIGINT."""
    return F.lit(str(1 << n)).cast("decimal(20,0)")


def le_uint64(x: Column | str, at: int) -> Column:
    """The little-endian unsigned number of 8 bytes at an offset, as decimal(20,0)."""
    return (byte_at(x, at + 7).cast("decimal(20,0)") * _power(56) + le_uint(x, at, 7).cast("decimal(20,0)")).cast("decimal(20,0)")


def le_bytes64(x: Column) -> Column:
    """An unsigned 64-bit number (any integer type or decimal(20,0)) as 8 little-endian bytes."""
    x = x.cast("decimal(20,0)")
    high = F.floor(x / _power(32)).cast("decimal(20,0)")
    return F.concat(le_bytes((x - high * _power(32)).cast("long"), 4), le_bytes(high.cast("long"), 4))


def shard_of(txid: Column | str) -> Column:
    """The low 12 bits of the first two bytes, little-endian."""
    return le_uint(txid, 0, 2) % F.lit(SHARDS)


def fingerprint(txid: Column | str) -> Column:
    return le_uint(txid, 0, 4)


def generation_ahead(target: Column, local: Column) -> Column:
    """Whether target is ahead of local on the 32-bit circle, by less than half of it."""
    return F.pmod(target - local, F.lit(U32_MAX + 1)).between(1, (1 << 31) - 1)


def next_generation(x: Column) -> Column:
    return F.pmod(x + 1, F.lit(U32_MAX + 1))


def has_flag(flags: Column | str, bit: int) -> Column:
    return F.col(flags).bitwiseAND(F.lit(bit)) != 0 if isinstance(flags, str) else flags.bitwiseAND(F.lit(bit)) != 0


def set_flag(flags: Column, bit: int, on: Column) -> Column:
    return F.when(on, flags.bitwiseOR(F.lit(bit))).otherwise(flags.bitwiseAND(F.lit(~bit)))


def is_reserved(data: Column) -> Column:
    """Spending data of nothing but FF bytes, which mark a frozen slot."""
    return data == lit_hex("FF" * 36)


def frozen_cooldown(data: Column) -> Column:
    """What a frozen slot's 36 bytes keep of its cooldown; an old slot of FF bytes alone keeps none."""
    return F.when(is_reserved(data), F.lit(0)).otherwise(le_uint(data, 0, 4)).cast("long")


def fits_u32(x: Column) -> Column:
    return x.between(0, U32_MAX)


def is_frozen(status: Column) -> Column:
    return status == FROZEN


def effectively_locked(flags: Column, n_blocks: Column) -> Column:
    return has_flag(flags, LOCKED) & (n_blocks == 0)


def all_spent(spent: Column, count: Column, flags: Column, reassigned: int = 64) -> Column:
    return (spent == count) & ~has_flag(flags, reassigned)


def _any(code: Column, *names: str) -> Column:
    return code.isin(*[ERRORS[n] for n in names])


def outcome_of(code: Column, idempotent: Column) -> Column:
    """One of eight outcome classes."""
    return (
        F.when(code == 0, F.when(idempotent, "idempotent").otherwise("ok"))
        .when(_any(code, "TX_NOT_FOUND"), "err_not_found")
        .when(_any(code, "ALREADY_SPENT", "CONFLICTING", "INVALID_SPEND", "ALREADY_EXISTS", "DELETED_CHILDREN"), "err_conflicting")
        .when(_any(code, "ALREADY_FROZEN", "FROZEN", "LOCKED", "FROZEN_UNTIL"), "err_frozen")
        .when(_any(code, "STORAGE_IO"), "err_storage")
        .when(_any(code, "REDIRECT"), "redirect")
        .otherwise("other")
    )


def error_name(code: Column) -> Column:
    pairs = [x for n, c in ERRORS.items() for x in (F.lit(c), F.lit(n))]
    return F.element_at(F.create_map(*pairs), code)


def log2_bucket(ns: Column) -> Column:
    """0 below 256 ns, one more for each doubling, 24 at most; exact, by the length of the binary number."""
    return F.least(F.lit(24), F.greatest(F.lit(0), F.length(F.bin(F.greatest(ns, F.lit(1)))) - 1 - 7)).cast("long")


def bucket_upper(bucket: Column) -> Column:
    return F.when(bucket == 0, F.lit(128)).when(bucket >= 24, F.lit((1 << 63) - 1)).otherwise(F.lit(128) * F.pow(F.lit(2.0), bucket).cast("long"))


def size_class(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 16, "5-16").otherwise("17+")
