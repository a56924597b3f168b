"""Op 4: variable-capacity best-fit packing.

Training sequences may have any of several permitted lengths. A document becomes
one piece, or, if it is longer than the largest length, as many full pieces as fit
and a rest; nothing is cut off. Pieces go, longest first, into the open bin that
they fill best; if none can take a piece, a new bin of the least-cost length is
opened, and at the end every bin is downsized to the smallest permitted length
that holds its contents.

The lengths are optimised jointly: opening a bin of capacity ``c`` for a piece of
length ``n`` costs ``(fixed + c) / value`` where value is what the bin can still
be expected to take, from the group's own length histogram: capacity that the
remaining shorter pieces can fill is not waste.

Packing is sequential by nature, so pieces are dealt into groups of about
``pieces_per_group`` by a hash and each group is packed by itself; what is lost is
at most a few partly filled bins a group. Only ids and lengths are shuffled. A hot
id cannot gather: the group is drawn from id, text and piece, so it is the same
when a lost executor's work is done again. A task packs several groups one after
the other, so the number of tasks is the session's and not the data's.

Defined cases: a null or wordless text has length 0 and gets bin null and no
piece number; repeated rows are packed each by itself; equal lengths are taken in
order of id, piece and content, of open bins with equal room the last one; a very long
text is as many pieces as it fills, and only its length is shuffled; an empty table gives
an empty result; only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import SPACES, row_key


@dataclass(frozen=True)
class PackParams:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)  #: permitted sequence lengths
    fixed_cost: float = 16.0  #: of a bin, in tokens
    separator: int = 1  #: tokens added to each document
    pieces_per_group: int = 20_000


def length_of(text: Column, params: PackParams) -> Column:
    """Words and a separator for each document; 0 for a text without words."""
    n = F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), ""))
    return F.when(n > 0, n + params.separator).otherwise(0)


def opening(sizes: np.ndarray, params: PackParams) -> np.ndarray:
    """The capacity to open for each of the pieces, which are in falling order.

    A bin of capacity c opened for piece i will be filled up from pieces i+1 on.
    What those can add is their total, and at best the room left; the least cost
    for each token placed wins, ties to the larger bin. Of the room, a quarter of the mean
    of the pieces that fit is taken to stay open: best fit leaves gaps between none and
    the least piece that is left, and the gaps shrink as pieces do.
    """
    caps = np.array(sorted(params.capacities))
    after = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]])
    smallest = sizes[-1] if len(sizes) else 0
    room = caps[None, :] - sizes[:, None]
    take = np.minimum(room, after[:, None])
    take = np.where(room < smallest, 0, take)
    # Later pieces no longer than the room are what can fill it; the finer they are the fuller it gets.
    first = np.maximum(np.searchsorted(-sizes, -np.maximum(room, 0), side="left"), np.arange(1, len(sizes) + 1)[:, None])
    fitting = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])[first]
    count = np.maximum(len(sizes) - first, 1)
    mean = fitting / count
    take = np.where(fitting > 0, np.minimum(take, np.maximum(room - mean / 4, 0)), 0)
    placed = sizes[:, None] + np.minimum(take, fitting)
    final = caps[np.minimum(np.searchsorted(caps, placed, side="left"), len(caps) - 1)]
    cost = np.where(room >= 0, (params.fixed_cost + final) / np.maximum(placed, 1), np.inf)
    return caps[len(caps) - 1 - cost[:, ::-1].argmin(1)]


def cost(capacities: np.ndarray, params: PackParams) -> float:
    return params.fixed_cost * len(capacities) + float(capacities.sum())


def pack(sizes: np.ndarray, params: PackParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the bins' capacities after downsizing. Sizes are in falling order.

    The opening rule looks ahead by sums only, so the group is packed with all lengths
    open, then with the shorter ones left out one by one, and the cheapest stays; the
    first of equals. Downsizing may use every length each time.
    """
    caps = sorted(params.capacities)
    best = None
    for k in range(len(caps)):
        opened = opening(sizes, replace(params, capacities=tuple(caps[k:])))
        tried = pack_with(sizes, opened.tolist(), params)
        if best is None or cost(tried[2], params) < cost(best[2], params):
            best = tried
    return best


def pack_with(sizes: np.ndarray, opened: list[int], params: PackParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, a bin for piece i being opened with capacity opened[i] if none takes it."""
    bin_of, offset = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    used: list[int] = []
    cap: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the different rooms that open bins have, sorted: no more than the largest capacity
    for i, n in enumerate(sizes.tolist()):
        k = bisect.bisect_left(rooms, n)
        if k < len(rooms):
            r = rooms[k]
            bins = by_room[r]
            b = bins.pop()
            if not bins:
                del by_room[r], rooms[k]
        else:
            b, r = len(used), opened[i]
            used.append(0)
            cap.append(r)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        r -= n
        if r:
            if r in by_room:
                by_room[r].append(b)
            else:
                by_room[r] = [b]
                bisect.insort(rooms, r)
    caps = np.array(sorted(params.capacities))
    return bin_of, offset, caps[np.searchsorted(caps, used, side="left")] if used else np.empty(0, int)


def best_fit(docs: DataFrame, params: PackParams = PackParams(), key: str = "doc_id", text: str = "text", length: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset.

    ``length`` replaces the count of words by any column of token counts.
    """
    largest = max(params.capacities)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), row_key(key, text).alias("h"), (length if length is not None else length_of(F.col(text), params)).cast("bigint").alias("n"))
    pieces = rows.select(
        "doc_id", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int"))).alias("piece"), "n", "h",
    ).select(
        "doc_id", "piece", "h", (F.col("piece").cast("bigint") * largest).alias("start"),
        F.least(F.col("n") - F.col("piece").cast("bigint") * largest, F.lit(largest)).cast("int").alias("n"),
    )
    count = rows.agg(F.sum(F.ceil(F.coalesce("n", F.lit(0)) / largest)).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(count) // params.pieces_per_group))
    group = F.pmod(F.xxhash64("h", "piece"), F.lit(groups))
    dealt = pieces.withColumn("g", group).repartition("g").sortWithinPartitions("g", F.desc("n"), "doc_id", "piece", "h")

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(waiting).combine_chunks()
            size, g = t["n"].to_numpy().astype(np.int64), t["g"].to_numpy()
            full = int((size > 0).sum())
            b, o, caps = pack(size[:full], params)
            none = len(size) - full
            ids = [f"{g[0]}-{x}" for x in b.tolist()] + [None] * none
            nothing = np.arange(len(size)) >= full
            grow = lambda x: pa.array(np.concatenate([x, np.zeros(none, x.dtype)]).astype(np.int32), mask=nothing)
            yield from pa.Table.from_arrays(
                [t["doc_id"], pa.array(t["piece"].to_numpy(), mask=nothing), t["start"], t["n"], pa.array(ids, pa.string()), grow(caps[b] if full else b), grow(o)],
                ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_capacity", "bin_offset"],
            ).to_batches(max_chunksize=10_000)

        now = None
        for batch in batches:
            at = 0
            g = batch.column(4).to_numpy()
            while at < len(g):
                end = at + int(np.searchsorted(g[at:], g[at], side="right"))
                if waiting and g[at] != now:
                    yield from flush()
                    waiting.clear()
                now = g[at]
                waiting.append(batch.slice(at, end - at))
                at = end
        if waiting:
            yield from flush()

    return dealt.select("doc_id", "piece", "start", F.coalesce("n", F.lit(0)).alias("n"), "g").transform(
        arrow_map, run, f"doc_id {kind}, piece int, start bigint, n_tokens int, bin_id string, bin_capacity int, bin_offset int"
    )
