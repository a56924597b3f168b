"""Op 2: substring deduplication by suffix automata of reference shards.

A window of ``window`` words is removed if its words also start elsewhere. A
literal broadcast of automata of every shard to every document costs shards times
corpus, so the shards here are cut by content and the documents' parts go to the
one shard that can answer for them:

1. In each window the k-gram with the least hash is its anchor. Equal windows have
   equal anchors. Consecutive windows with one anchor make a segment.
2. Anchors are counted over the corpus (map-side sums). Only segments whose anchor
   occurs twice or more can hold a repeated window; the others end here.
3. The remaining segments' texts, each different one once with its number of
   occurrences, go to the shard of their anchor. A shard builds a suffix automaton
   of its texts, weights its states by occurrences, and streams the segments
   through it: a window is repeated iff the state of its last ``window`` words
   weighs two or more.
4. Verdicts go back to the segments' places, and the documents drop the words
   under the union of their repeated windows.

Anchors with more occurrences than ``hot`` are keyed by the window's own text, one
window a segment, so no shard holds more than ``hot`` texts of one anchor and
equal texts fold map-side. Within a shard windows are compared as words by the
automaton; segments and texts are told apart by 64-bit hashes, and a shard of one text
only needs its count.

Defined cases: a null text has no words, nothing removed, and the digest of the
empty string; texts shorter than a window stay whole; of equal grams in
a window the first is its anchor; a very long text is cut into segments of at most two
windows; repeated rows are occurrences of each other; an empty table gives an empty
result; only id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import PIECE_BYTES, U64, checkpoint, many_hashes, rolling, row_key, words_of


@dataclass(frozen=True)
class SubstringParams:
    window: int = 35
    gram: int = 12
    hot: int = 2000


def anchors(h: np.ndarray, counts: np.ndarray, params: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, text, first and last window of each segment; h: word hashes of texts with so many words each, in order."""
    none = np.empty(0, np.int64)
    if len(h) < params.window:
        return none, none, none, none
    g = rolling(h, params.gram)
    wide = params.window - params.gram + 1
    least, have = g, 1
    while have < wide:  # running minima by doubling
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    n = len(least)
    text = np.repeat(np.arange(len(counts)), counts)
    valid = text[:n] == text[params.window - 1 :]
    change = (least[1:] != least[:-1]) | ~valid[1:] | ~valid[:-1] | (text[1:n] != text[: n - 1])
    edge = np.concatenate([[True], change, [True]])
    first, last = np.flatnonzero(valid & edge[:-1]), np.flatnonzero(valid & edge[1:])
    views = sliding_window_view(g, wide)
    place_of = lambda at: np.concatenate([at[i : i + 4096] + views[at[i : i + 4096]].argmin(1) for i in range(0, len(at), 4096)] or [none])
    # A run of one minimum goes on past its place only where the same gram comes again: cut there, each place its own segment.
    firsts, lasts, places = [], [], []
    while len(first):
        place = place_of(first)
        over = last > place
        firsts.append(first)
        lasts.append(np.minimum(last, place))
        places.append(place)
        first, last = place[over] + 1, last[over]
    first, last, place = (np.concatenate(x or [none]) for x in (firsts, lasts, places))
    start = np.concatenate([[0], np.cumsum(counts)])[text[first]]
    return g[place].view(np.int64), text[first], first - start, last - start


class SuffixAutomaton:
    """Of several word sequences with weights; a state weighs the occurrences of its strings."""

    def __init__(self, texts: list[tuple[list[bytes], int]]):
        self.next: list[dict] = [{}]
        self.link, self.size, self.weight = [-1], [0], [0]
        for words, n in texts:
            last = 0
            for w in words:
                last = self._add(last, w)
                self.weight[last] += n
        weight, link = self.weight, self.link
        for s in sorted(range(1, len(link)), key=self.size.__getitem__, reverse=True):
            if link[s] > 0:
                weight[link[s]] += weight[s]

    def _state(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.size.append(size)
        self.link.append(link)
        self.weight.append(0)
        return len(self.link) - 1

    def _add(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        if (q := nxt[last].get(w)) is not None:  # known from a text before
            return q if size[q] == size[last] + 1 else self._split(last, w, q)
        s = self._state(size[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = s
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[s] = q if size[q] == size[p] + 1 else self._split(p, w, q)
        return s

    def _split(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def repeated(self, words: list[bytes], window: int) -> int:
        """Bit i: the window that starts at word i has weight two or more. words: one of the automaton's texts."""
        nxt, link, size, weight = self.next, self.link, self.size, self.weight
        s, mask = 0, 0
        for i, w in enumerate(words):
            s = nxt[s][w]
            while size[link[s]] >= window:  # the matching statistic is cut at the window's length
                s = link[s]
            if i + 1 >= window and weight[s] >= 2:
                mask |= 1 << (i + 1 - window)
        return mask


def _occurrences(rows: DataFrame, params: SubstringParams) -> DataFrame:
    """a, key, s0, s1: the segments of all texts."""

    def run(batches):
        for b in batches:
            keys, texts, at, size = b.column(0).to_numpy(), b.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size > PIECE_BYTES or i + 1 == len(texts):
                    a, which, s0, s1 = anchors(*many_hashes(texts[at : i + 1]), params)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(keys[at + which]), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32))], ["a", "key", "s0", "s1"]
                    )
                    at, size = i + 1, 0

    return rows.select("key", "text").transform(arrow_map, run, "a bigint, key bigint, s0 int, s1 int")


def _cut(placed: DataFrame, params: SubstringParams, places: bool) -> DataFrame:
    """The candidates' segments: a, h and where they are (key, s0), or a, h, their words (seg) and how often (n) they come.

    Segments with words are folded on the way out, so that many copies of one leave
    a task as few rows. placed: key, doc_id, text, found (array of a, s0, s1, hot).
    """
    digest = xxhash.xxh3_64_intdigest

    def signed(h: list[int]) -> pa.Array:
        return pa.array(np.array(h, U64).view(np.int64))

    def segments(words: list[bytes], found: list[dict]):
        for f in found:
            a, lo, hi = f["a"] % (1 << 64), f["s0"], f["s1"]
            if f["hot"]:
                for s in range(lo, hi + 1):
                    seg = b" ".join(words[s : s + params.window])
                    yield digest(seg, a), digest(seg), s, seg
            else:
                seg = b" ".join(words[lo : hi + params.window])
                yield a, digest(seg), lo, seg

    def run(batches):
        for b in batches:
            rows, folded = [], {}

            def out():
                if places:
                    a, h, key, s0 = zip(*rows, strict=True)
                    return pa.RecordBatch.from_arrays([signed(a), signed(h), pa.array(key, pa.int64()), pa.array(s0, pa.int32())], ["a", "h", "key", "s0"])
                a, h = zip(*folded, strict=True)
                n, seg = zip(*folded.values(), strict=True)
                return pa.RecordBatch.from_arrays([signed(a), signed(h), pa.array(n, pa.int64()), pa.array(seg, pa.binary())], ["a", "h", "n", "seg"])

            for key, text, found in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                for a, h, s, seg in segments(words_of(text.as_py()), found):
                    if places:
                        rows.append((a, h, key, s))
                    elif (have := folded.get((a, h))) is not None:
                        have[0] += 1
                    else:
                        folded[a, h] = [1, seg]
                if len(rows) > 50_000 or len(folded) > 20_000:
                    yield out()
                    rows, folded = [], {}
            if rows or folded:
                yield out()

    return placed.transform(arrow_map, run, "a bigint, h bigint, key bigint, s0 int" if places else "a bigint, h bigint, n bigint, seg binary")


def _verdicts(texts: DataFrame, params: SubstringParams) -> DataFrame:
    """a, h, mask: the repeated windows of each different segment that has any. texts: a, h, n, seg."""
    shards = texts.repartition("a").sortWithinPartitions("a", "h")

    def run(batches):
        now, held, rows = None, [], []

        def judge():
            if len(held) == 1:  # the states of a single text all weigh its occurrences
                h, n, seg = held[0]
                if n >= 2:
                    rows.append((now, h, (1 << (seg.count(b" ") + 2 - params.window)) - 1))
                return
            texts = [(h, n, seg.split(b" ")) for h, n, seg in held]
            automaton = SuffixAutomaton([(w, n) for _, n, w in texts])
            for h, _, w in texts:
                if mask := automaton.repeated(w, params.window):
                    rows.append((now, h, mask))

        def batch():
            a, h, mask = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(h, pa.int64()), pa.array(mask, pa.int64())], ["a", "h", "mask"])

        for b in batches:
            for a, h, n, seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a != now:
                    if held:
                        judge()
                    now, held = a, []
                if held and held[-1][0] == h:
                    held[-1][1] += n
                else:
                    held.append([h, n, seg])
            if rows:
                yield batch()
                rows = []
        if held:
            judge()
        if rows:
            yield batch()

    return shards.select("a", "h", "n", "seg").transform(arrow_map, run, "a bigint, h bigint, mask bigint")


def dedup_substrings(docs: DataFrame, params: SubstringParams = SubstringParams(), key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row, and the kept text if asked for."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(row_key(key, text).alias("key"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    occ = _occurrences(rows, params)
    # Written out, so that the join below stands between two exchanges and Spark may split a hot anchor's partition.
    counts = checkpoint(occ.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = checkpoint(
        occ.join(counts, "a").groupBy("key").agg(F.collect_set(F.struct("a", "s0", "s1", (F.col("n") > params.hot).alias("hot"))).alias("found"))
    )
    # A text that rows share by key comes once here for each row, so that occurrences count.
    # doc_id is carried along so that this join and the last one read one and the same exchange of the texts.
    placed = rows.join(found, "key").select("key", "doc_id", "text", "found")
    verdicts = _verdicts(_cut(placed, params, False), params)
    marks = _cut(placed, params, True).join(verdicts, ["a", "h"]).groupBy("key").agg(F.collect_set(F.struct("s0", "mask")).alias("marks"))

    def run(batches):
        for b in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            for t, marks in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = words_of(t.as_py())
                removed = 0
                if marks:
                    step = np.zeros(len(words) + 1, np.int32)
                    for m in marks:
                        s, mask = m["s0"], m["mask"]
                        while mask:
                            low = mask & -mask
                            i = s + low.bit_length() - 1
                            step[i] += 1
                            step[i + params.window] -= 1
                            mask ^= low
                    gone = np.cumsum(step[:-1]) > 0
                    removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "surrogatepass"))
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(marks, "key", "left").select("doc_id", "text", "marks").transform(arrow_map, run, schema)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: DuckDB SQL for the query's rows: every window spelled out, counted, and its words marked.
ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i : i + 34], ' ') END AS g FROM p),
f AS (SELECT r, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS again FROM g),
m AS (SELECT r, i, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
