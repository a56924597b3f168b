"""Op 5: benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words; positions outside the mask are
ignored, so a substituted word under a gap does not hide a match. Hashes of the
masked words are taken at every position of benchmark items and documents and
joined. Around each hit the document and the item are laid on the hit's diagonal
and compared word by word; a match is a stretch of at least ``least_overlap``
words (or the whole item, if shorter) of which at most the tolerated share
differs.

The benchmark side is broadcast only if its texts have at most
``most_broadcast_bytes``, which a sum over the benchmark checks first; a task's tables
then take at most some 20 bytes for each of them. Beyond that the same hashes are
joined by a shuffle, whose hot hashes Spark may split, and hits are reduced to
(document, item, diagonal) before texts are fetched. Both ways give the same rows.

Words are compared in lower case without punctuation at their ends; words of
punctuation only are left out.

Defined cases: null or wordless texts on either side match nothing; items
of up to ``least_overlap`` words match whole, any of their words may differ within the
tolerated share (none of four words or fewer); of an item's overlaps with a document the
longest counts, of equally long ones the first; very long texts are read whole, in
memory of some 30 bytes a word; repeated rows give repeated results; empty tables give an
empty result; only ids and texts are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import MIX, U64, mix64, rework, row_key, words_of

# Masks; 1 compares the word, 0 ignores it.
# With a fifth of the words substituted, a stretch of 6 words or more has 4 equal ones
# in a row, or two runs of 2 or more beside a single substituted word.
MASKS = ("1111", "11011")

#: Words of documents that are looked up together.
GROUP_WORDS = 1 << 18

_TRIM = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")


@dataclass(frozen=True)
class SeedParams:
    masks: tuple[str, ...] = MASKS
    least_overlap: int = 13  #: words of a match, or the whole item
    most_different: float = 0.2  #: share of them that may be substituted
    most_broadcast_bytes: int = 8 << 20
    most_filter_bits: int = 24  #: the lookup filter has 2**bits places, 64 for each seed up to that


def normal(word: bytes) -> bytes:
    return _TRIM.sub(b"", word.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"))


class NormalHasher:
    """Hashes of a text's normalised words; each raw word is normalised once and remembered up to a bound."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > self.keep:
                self.known.clear()
            for i, h in enumerate(out):
                if h is None:
                    w = normal(words[i])
                    h = out[i] = self.known[words[i]] = (xxhash.xxh3_64_intdigest(w) or 1) if w else 0
        h = np.array(out, dtype=U64)
        return h[h > 0]


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, len(mask) * 1000 + mask.count("1"), U64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                out = out * MIX + h[j : j + n]
        return mix64(out)


def solid_width(n: int) -> int:
    """The width of the solid seeds that an item of n words has besides the masks; 0 for none. Only short items need them."""
    return min(3, n) if n <= 5 else 0


def item_seeds(h: np.ndarray, params: SeedParams) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes) by mask."""
    if w := solid_width(len(h)):
        yield w, seed_hashes(h, "1" * w)
    for m in params.masks:
        yield len(m), seed_hashes(h, m)


def document_masks(widths: Iterable[int], params: SeedParams) -> list[str]:
    """The masks to lay on documents; widths: of the items' solid seeds."""
    return [*params.masks, *("1" * w for w in sorted(set(widths) - {0}))]


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, params: SeedParams) -> tuple[int, int, int] | None:
    """The longest tolerated stretch on a diagonal (document place minus item place): start and end in the document, words that differ.

    An item of up to ``least_overlap`` words is compared whole. Else
    among all stretches that begin and end with equal words and whose different
    words are within the share, by prefix sums; None if it is too short.
    """
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    least = min(params.least_overlap, len(item))
    if b - a < least:
        return None
    same = doc[a:b] == item[a - diagonal : b - diagonal]
    if len(item) <= params.least_overlap:  # the whole item, whichever of its words differ
        different = int((~same).sum())
        return (a, b, different) if different <= params.most_different * len(item) + 1e-9 else None
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # equal words minus their required share: a stretch [i, j] qualifies iff value[j + 1] >= value[i]
    value = np.concatenate([[0.0], np.cumsum(np.where(same, params.most_different, params.most_different - 1.0))])
    starts, ends = value[at], value[at + 1]
    # For each start the last end that reaches it: suffix maxima of the ends, searched from the right.
    reach = np.maximum.accumulate(ends[::-1])[::-1]
    last = np.searchsorted(-reach, -(starts - 1e-9), side="right") - 1
    length = at[last] - at + 1
    k = int(length.argmax())
    if last[k] < k or length[k] < least:
        return None
    i, j = int(at[k]), int(at[last[k]]) + 1
    return a + i, a + j, int(j - i - same[i:j].sum())


class Benchmark:
    """Hashes of all items, sorted for lookup, behind a filter of single places."""

    def __init__(self, ids: list, words: list[np.ndarray], params: SeedParams):
        self.ids, self.words, self.params = ids, words, params
        self.masks = document_masks((solid_width(len(x)) for x in words), params)
        seeds = [(k, h) for k, x in enumerate(words) for _, h in item_seeds(x, params)]
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        hashes = join([h for _, h in seeds], U64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = join([np.full(len(h), k) for k, h in seeds], np.int32)[order]
        self.place = join([np.arange(len(h)) for _, h in seeds], np.int32)[order]
        bits = min(params.most_filter_bits, max(16, (64 * len(hashes)).bit_length()))
        self.shift = U64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, texts: list[np.ndarray]) -> dict[int, set[tuple[int, int]]]:
        """(item, diagonal) of all seed hits by text; the texts' words share each pass."""
        found: dict[int, set[tuple[int, int]]] = {}
        ends = np.cumsum([len(x) for x in texts])
        h = np.concatenate([*texts, np.empty(0, U64)])
        for mask in self.masks:
            s = seed_hashes(h, mask)
            at = np.flatnonzero(self.known[(s >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.hashes, s[at], "left")
            n = np.searchsorted(self.hashes, s[at], "right") - lo
            text = np.searchsorted(ends, at, "right")
            real = np.flatnonzero((n > 0) & (at + len(mask) <= ends[np.minimum(text, len(ends) - 1)])) if len(ends) else at
            begin = at - np.where(text > 0, ends[text - 1], 0) if len(ends) else at
            for p, t, a, k in zip(begin[real].tolist(), text[real].tolist(), lo[real].tolist(), n[real].tolist(), strict=True):
                found.setdefault(t, set()).update((i, p - q) for i, q in zip(self.item[a : a + k].tolist(), self.place[a : a + k].tolist(), strict=True))
        return found


def matches(texts: list[np.ndarray], bench: Benchmark) -> dict[int, list[tuple]]:
    """By text (item id, start, end, words that differ), the best of each item; texts without a match are not there."""
    out = {}
    for t, hits in bench.hits(texts).items():
        best: dict[int, tuple[int, int, int]] = {}
        for item, diagonal in hits:
            o = overlap(texts[t], bench.words[item], diagonal, bench.params)
            if o and (item not in best or (o[0] - o[1], o) < (best[item][0] - best[item][1], best[item])):
                best[item] = o
        if best:
            out[t] = [(bench.ids[k], *o) for k, o in sorted(best.items())]
    return out


def matches_of(texts: list[str | None], bench: Benchmark, hasher: NormalHasher) -> Iterator[tuple[int, list[tuple]]]:
    """(place among the texts, matches), texts taken in groups of bounded size."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(hasher(t))
        size += len(held[-1])
        if size > GROUP_WORDS or i + 1 == len(texts):
            for k, found in sorted(matches(held, bench).items()):
                yield at + k, found
            at, held, size = i + 1, [], 0


def _items(benchmark: DataFrame, params: SeedParams, item_key: str, item_text: str) -> tuple[DataFrame, list | None]:
    """The items, and their rows if they are within the bound for a broadcast."""
    items = benchmark.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    return items, items.collect() if total <= params.most_broadcast_bytes else None


def _hashed(rows: list) -> tuple[list, list[np.ndarray]]:
    hasher = NormalHasher()
    return [r["item_id"] for r in rows], [hasher(r["text"]) for r in rows]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams(), text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that overlap with no item."""
    items, rows = _items(benchmark, params, item_key, item_text)
    if rows is None:
        keyed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        keyed = keyed.withColumn("key", row_key(f"c{docs.columns.index(text)}"))
        found = _find_by_shuffle(keyed.dropDuplicates(["key"]), items, params, "key", f"c{docs.columns.index(text)}")
        return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").drop("key").toDF(*docs.columns)
    packed = docs.sparkSession.sparkContext.broadcast(_hashed(rows))

    def make():
        bench, hasher = Benchmark(*packed.value, params), NormalHasher()

        def each(texts):
            keep = np.ones(len(texts), bool)
            keep[[i for i, _ in matches_of(texts, bench, hasher)]] = False
            return keep, {}

        return each

    return rework(docs, text, make)


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: doc_id, item_id, start, end (words), n_different."""
    items, rows = _items(benchmark, params, item_key, item_text)
    if rows is None:
        return _find_by_shuffle(docs, items, params, key, text)
    packed = docs.sparkSession.sparkContext.broadcast(_hashed(rows))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def run(batches):
        bench, hasher = Benchmark(*packed.value, params), NormalHasher()
        for b in batches:
            at, out = [], []
            for i, found in matches_of(b.column(1).to_pylist(), bench, hasher):
                at += [i] * len(found)
                out += found
            if at:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(c[0]), *[pa.array(x, pa.int32()) for x in c[1:]]],
                    ["doc_id", "item_id", "start", "end", "n_different"],
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).transform(
        arrow_map, run, f"doc_id {kind}, item_id {item_kind}, start int, end int, n_different int"
    )


def _find_by_shuffle(docs: DataFrame, items: DataFrame, params: SeedParams, key: str, text: str) -> DataFrame:
    """The same result with no side broadcast whole.

    Hits are joined on the hash, reduced to distinct (document, item, diagonal),
    and verified on the item's and the document's words, fetched by two equi-joins.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    # Joined by keys of the rows' content, so that null ids and repeated rows keep their matches.
    d = docs.select(row_key(key, text).alias("d"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    u = items.select(row_key("item_id", "text").alias("u"), "item_id", F.col("text").alias("item_text"))

    def lengths(batches):
        hasher = NormalHasher()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([solid_width(len(hasher(t))) for t in b.column(0).to_pylist()], pa.int32())], ["width"])

    masks = document_masks([r["width"] for r in u.select("item_text").transform(arrow_map, lengths, "width int").distinct().collect()], params)

    def hashes(of_item: bool):
        def run(batches):
            hasher = NormalHasher()
            for b in batches:
                for i, t in enumerate(b.column(1).to_pylist()):
                    h = hasher(t)
                    seeds = item_seeds(h, params) if of_item else ((len(m), seed_hashes(h, m)) for m in masks)
                    for _, s in seeds:
                        if len(s):
                            yield pa.RecordBatch.from_arrays(
                                [b.column(0).slice(i, 1).take(pa.array(np.zeros(len(s), int))), pa.array(s.view(np.int64)), pa.array(np.arange(len(s)), pa.int32())],
                                ["id", "h", "p"],
                            )
        return run

    left = d.select("d", "text").transform(arrow_map, hashes(False), "id bigint, h bigint, p int").select(F.col("id").alias("d"), "h", "p")
    right = u.select("u", "item_text").distinct().transform(arrow_map, hashes(True), "id bigint, h bigint, p int").select(F.col("id").alias("u"), "h", F.col("p").alias("q"))
    hits = left.join(right, "h").select("d", "u", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
    both = hits.groupBy("d", "u").agg(F.collect_set("diagonal").alias("diagonals")).join(u, "u").join(d, "d").select("doc_id", "item_id", "diagonals", "text", "item_text")

    def verify(batches):
        hasher = NormalHasher()
        for b in batches:
            at, out = [], []
            for i, (ds, t, u) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                h, g = hasher(t), hasher(u)
                found = [o for x in ds if (o := overlap(h, g, x, params))]
                if found:
                    at.append(i)
                    out.append(min(found, key=lambda o: (o[0] - o[1], o)))
            if at:
                take, c = pa.array(at), list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(x, pa.int32()) for x in c]], ["doc_id", "item_id", "start", "end", "n_different"])

    return both.transform(arrow_map, verify, f"doc_id {kind}, item_id {item_kind}, start int, end int, n_different int")
