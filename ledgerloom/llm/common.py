"""What the corpus operators share: tables, words, hashes and checkpoints.

A word is a run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. ``bytes.split()`` cuts UTF-8 at exactly these
six bytes, so words come out of one C call, and all later arithmetic on them is
vectorised.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import arrow_map

#: Java/RE2/Python regex for what separates words.
SPACES = r"[\x20\x09-\x0D]+"

#: Text is handed to numpy in pieces of about this many bytes, whatever the
#: size of an Arrow batch, so a worker's memory does not follow the batch.
PIECE_BYTES = 1 << 21

U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised (wraps mod 2**64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    """64-bit hashes of words, remembered up to a bound (word frequencies are steep)."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, get = self.known, self.known.get
        out = [get(w) for w in words]
        if None in out:
            if len(known) > self.keep:
                known.clear()
            digest = xxhash.xxh3_64_intdigest
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    h = out[i] = known[w] = digest(w)
        return np.array(out, dtype=U64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: An odd base, its inverse mod 2**64, and how long a text may be for their tables of powers.
_BASE = 0x9E3779B97F4A7C15
_POWERS = 1 << 18


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.concatenate([[U64(1)], np.full(_POWERS - 1, b, U64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def text_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words from running sums over its bytes, without making the words.

    A word's hash is a polynomial of its bytes, mixed with its length. Long texts
    are taken in pieces that end between words.
    """
    if not text:
        return np.empty(0, U64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) < _POWERS:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _POWERS - 1, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if not len(gaps):  # a word longer than the tables: go on to its end and hash it alone
                rest = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(rest[0]) if len(rest) else len(raw)
                out.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end].tobytes())], U64))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def many_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in one array, and the number of words of each; short texts share one pass."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    first = size = 0

    def out():
        joined = b"\n".join(held)
        raw = np.frombuffer(joined, np.uint8)
        hashes.append(_piece_hashes(raw))
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        gap = np.ones(len(raw) + 1, bool)
        gap[1:] = _SPACE[raw]
        begin = np.flatnonzero(gap[:-1] & ~gap[1:])
        counts[first : first + len(held)] = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))

    for i, t in enumerate(texts):
        x = t.encode("utf-8", "surrogatepass") if t else b""
        if size + len(x) + 1 >= _POWERS // 2:
            if held:
                out()
            held, size = [], 0
        if len(x) + 1 >= _POWERS // 2:
            h = text_hashes(t)
            hashes.append(h)
            counts[i] = len(h)
            continue
        if not held:
            first = i
        held.append(x)
        size += len(x) + 1
    if held:
        out()
    return (np.concatenate(hashes) if hashes else np.empty(0, U64)), counts


def _piece_hashes(raw: np.ndarray) -> np.ndarray:
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * MIX)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` consecutive hashes, order-sensitive."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * MIX + h[j : j + n]
        return mix64(out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; on one machine it is filled in where it is unset, as in tests, on a cluster that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/ledgerloom-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so a lost executor costs a read, not a rebuild."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content, defined for null in any column."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns])


def rework(docs: DataFrame, text: str, make: Callable[[], Callable[[list], tuple[list | None, dict[str, pa.Array]]]]) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, some of them new; no join, no shuffle.

    ``make()`` gives, once a task, the function from texts to which rows to keep (None:
    all) and new columns by name. Nothing is added, so no column's name can clash.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)

    def run(batches):
        each = make()
        for b in batches:
            keep, new = each(b.column(at).to_pylist())
            out = pa.RecordBatch.from_arrays([new.get(n, c) for n, c in zip(names, b.columns, strict=True)], b.schema.names)
            yield out if keep is None else out.filter(pa.array(keep, pa.bool_()))

    return arrow_map(plain, run, plain.schema).toDF(*names)
