"""Op 6: script ranges, then Viterbi over per-word scores.

Training counts hashed letter n-grams for each language on a bounded sample of
labelled rows and keeps log probabilities in one table of fixed size. A word's
score in a language is the sum over its letters. The script of its letters first
narrows the languages to those that training has seen in that script. Viterbi
with a penalty for every change of language then labels the words of a text, so a
mixed text falls into spans; the prediction is the language with most letters.

All of it is arithmetic on whole code-point arrays. Viterbi takes texts in chunks
whose transfers are chained, so its Python cost follows the chunk's length and not
the text's; letters are scored in slices of bounded size, and what is kept of a
whole text is some 50 bytes a word.

Letters and marks are those of Unicode, in all planes. Scripts are known by the names of
their code points, so any script that training saw narrows; words in a script that no
language was seen in are no evidence for any.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
every text if there is nothing to learn from; a text without evidence gets the
language that sorts first, with score 0; ties go to the language that sorts first;
very long texts are read whole, a word longer than a slice counting as several; a
null doc_id counts as the empty string and is never held out; repeated rows give
repeated results; an empty table gives an empty one; only doc_id, text and, for
training, lang are read, so other columns may have any names. More than
``max_languages`` labels are an error, never cut off.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import rework

# First words of Unicode names that say nothing of a script.
NO_SCRIPT = frozenset("MODIFIER FEMININE MASCULINE MATHEMATICAL DOUBLE SUPERSCRIPT COMBINING VARIATION INVERTED SCRIPT".split())
UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    max_languages: int = 256  #: bounds the model; training refuses more labels
    docs_per_language: int = 1500  #: bound of the training sample, in expectation, for each language
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3, 4)
    smoothing: float = 0.5
    switch_penalty: float = 12.0
    least_script_share: float = 0.002
    piece_letters: int = 1 << 20  #: letters times languages that are scored at once
    labelled_letters: int = 1 << 23  #: letters times languages whose words are labelled at once
    chunk_words: int = 128  #: words of a text that Viterbi steps through one by one


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For every code point: its lower case (0 if neither letter nor mark), whether it is a letter, its script's number; and how many scripts there are.

    A script is the ranges of code points whose names begin with one word (LATIN,
    KANNADA, CJK); number 0 is for those that belong to none.
    """
    low, letter, script = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, np.uint8)
    numbers: dict[str, int] = {}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(s := chr(c))[0]
        if kind == "L" or kind == "M":
            x = s.lower()
            low[c], letter[c] = ord(x) if len(x) == 1 else c, kind == "L"
            name = re.split("[ -]", unicodedata.name(s, ""), maxsplit=1)[0]
            if name and name not in NO_SCRIPT:
                script[c] = numbers.setdefault(name, len(numbers) + 1)
    return low, letter, script, len(numbers) + 1


class Letters:
    """The letters of several texts as arrays: n-gram buckets, word starts and scripts. Marks go with the letters before them."""

    def __init__(self, texts: list[str], params: LangParams):
        low, letter, script, _ = _tables()
        raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        letters = low[raw]
        at = np.flatnonzero(letters)
        doc = (np.searchsorted(starts, at, "right") - 1).astype(np.int32)
        most = max(params.orders)
        padded = np.concatenate([np.zeros(most, np.uint32), letters])
        before = [padded[at + (most - j)] for j in range(most)]
        for j in range(1, most):  # what lies beyond the word's start does not matter
            before[j][before[j - 1] == 0] = 0
        self.buckets = []
        with np.errstate(over="ignore"):
            for n in params.orders:
                h = np.full(len(at), n, np.uint64)
                for j in range(n):
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    h += before[j]
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                self.buckets.append(((h >> np.uint64(40)) % np.uint64(params.buckets)).astype(np.int32))
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        self.word_first = np.flatnonzero(first)  # among letters
        word_at = at[self.word_first]
        self.word_letters = np.diff(np.append(self.word_first, len(at))).astype(np.int32)
        self.word_doc = doc[self.word_first]
        self.script = script[raw[at]]
        self.word_script = self.script[self.word_first]
        self.word_start = word_at - starts[self.word_doc]
        true = np.concatenate([[0], np.cumsum(letter[raw[at]])])
        self.word_true = np.diff(true[np.append(self.word_first, len(at))]).astype(np.int32)  #: letters without marks
        self.n = len(at)


@dataclass(frozen=True)
class Found:
    """Of a text: its language, that language's share of the letters (letters without evidence are nobody's),
    the best path's mean advantage a letter over the mean of the languages, and spans (language, first and end code point)."""

    language: str
    share: float = 0.0
    evidence: float = 0.0
    spans: tuple[tuple[str, int, int], ...] = ()
    letters: int = 0  #: and marks


@dataclass
class LangModel:
    languages: list[str]
    table: np.ndarray  #: buckets x languages, float32
    allowed: np.ndarray  #: scripts x languages
    params: LangParams

    def words(self, x: Letters) -> np.ndarray:
        """Scores, words x languages; 0 for all where no language was seen in the word's script."""
        if not len(x.word_first):
            return np.zeros((0, len(self.languages)), np.float32)
        per = np.zeros((x.n, len(self.languages)), np.float32)
        for b in x.buckets:
            per += self.table[b]
        out = np.add.reduceat(per, x.word_first, axis=0)
        may = self.allowed[x.word_script]
        out[~may & may.any(1)[:, None]] = -1e4
        out[~may.any(1)] = 0
        return out

    def label(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best path's language of every word; sizes: words of each text, in order.

        Texts are cut into chunks of ``chunk_words``, or as many as there are languages.
        A chunk's transfer matrix has the best score from each language before it to
        each at its end; chained along a text they give every chunk its entry, and then
        all chunks of all texts are stepped through at once, forth and back.
        """
        n, k = scores.shape
        out = np.zeros(n, np.int16)
        sizes = np.asarray(sizes)
        begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        begins, sizes = begins[sizes > 0], sizes[sizes > 0]
        if k == 1 or not len(sizes):
            return out
        penalty, width = np.float32(self.params.switch_penalty), max(self.params.chunk_words, k)
        chunks = -(-sizes // width)
        first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        text = np.repeat(np.arange(len(sizes)), chunks)
        place = np.arange(len(text)) - first[text]
        start, length = begins[text] + place * width, np.minimum(sizes[text] - place * width, width)
        entry = np.zeros((len(text), k), np.float32)
        inner = np.flatnonzero(place < chunks[text] - 1)  # all but the last of a text: full chunks
        if len(inner):
            m = np.where(np.eye(k, dtype=bool), np.float32(0), np.float32(-np.inf))[None].repeat(len(inner), 0)
            for t in range(width):
                m = np.maximum(m, m.max(2, keepdims=True) - penalty) + scores[start[inner] + t][:, None, :]
            number = np.zeros(len(text), np.int64)
            number[inner] = np.arange(len(inner))
            longest = np.argsort(-chunks, kind="stable")
            for j in range(int(chunks.max()) - 1):
                at = first[longest[: int(np.searchsorted(-chunks[longest], -(j + 1), "left"))]] + j
                v = (entry[at][:, :, None] + m[number[at]]).max(1)
                entry[at + 1] = v - v.max(1, keepdims=True)
            del m
        order = np.argsort(-length, kind="stable")
        groups, ends, enters = [], np.zeros(len(text), np.int16), np.zeros((len(text), k), np.int16)
        a = 0
        while a < len(order):  # chunks whose lengths are within a factor of two step together
            b = a + max(1, int(np.searchsorted(-length[order[a:]], -(length[order[a]] // 2), "right")))
            group = order[a:b]
            begin, size, v = start[group], length[group], entry[group]
            steps = int(size[0])
            alive = np.searchsorted(-size, -np.arange(steps), "left")
            back, moved = np.zeros((steps, len(group)), np.int16), np.zeros((steps, len(group), k), bool)
            rows = np.arange(len(group))
            for t in range(steps):
                c = alive[t]
                w = v[:c]
                best = w.argmax(1)
                jump = w[rows[:c], best][:, None] - penalty
                back[t, :c], moved[t, :c] = best, w < jump
                v[:c] = np.maximum(w, jump) + scores[begin[:c] + t]
            ends[group] = v.argmax(1)
            now = np.tile(np.arange(k, dtype=np.int16), (len(group), 1))
            for t in range(steps - 1, -1, -1):
                c = alive[t]
                m = np.take_along_axis(moved[t, :c], now[:c].astype(np.int64), 1)
                now[:c] = np.where(m, back[t, :c, None], now[:c])
            enters[group] = now
            groups.append((group, alive, back, moved))
            a = b
        longest = np.argsort(-chunks, kind="stable")
        for j in range(1, int(chunks.max())):  # from each text's last chunk to its first
            at = (first + chunks)[longest[: int(np.searchsorted(-chunks[longest], -j, "left"))]] - j
            ends[at - 1] = enters[at, ends[at]]
        for group, alive, back, moved in groups:
            now, begin, rows = ends[group], start[group], np.arange(len(group))
            for t in range(len(alive) - 1, -1, -1):
                c = alive[t]
                out[begin[:c] + t] = now[:c]
                now[:c] = np.where(moved[t, rows[:c], now[:c]], back[t, :c], now[:c])
        return out

    def predict(self, texts: list[str]) -> list[Found]:
        """What is found of each text."""
        if not self.languages:
            return [Found(UNKNOWN)] * len(texts)
        most = max(1 << 14, self.params.labelled_letters // len(self.languages))
        return [x for some in pieces(texts, most) for x in self._predict(some)]

    def _predict(self, texts: list[str]) -> list[Found]:
        # Letters are taken in pieces, long texts in slices; words, far fewer, are labelled for all texts at once.
        most = max(1 << 12, self.params.piece_letters // len(self.languages))
        cut = [(i, a, s) for i, t in enumerate(texts) for a, s in slices(t, most)]
        parts, at = [], 0
        for some in pieces([s for _, _, s in cut], most):
            x = Letters(some, self.params)
            doc, offset = (np.array([c[f] for c in cut[at : at + len(some)]], np.int64)[x.word_doc] for f in (0, 1))
            parts.append((self.words(x), doc, x.word_letters, x.word_true, x.word_start + offset, self.allowed[x.word_script].any(1)))
            at += len(some)
        if not parts:
            return []
        scores, doc, letters, true, start, known = (np.concatenate(p) for p in zip(*parts, strict=True))
        labels = self.label(scores, np.bincount(doc, minlength=len(texts)))
        k, n = len(self.languages), len(texts)
        share = np.bincount(doc * k + labels, weights=letters * known, minlength=n * k).reshape(n, k)
        total, found = np.bincount(doc, weights=letters, minlength=n), np.bincount(doc, weights=true, minlength=n) > 0
        gain = np.bincount(doc, weights=scores[np.arange(len(labels)), labels], minlength=n)
        best = share.argmax(1)
        cut_at = np.ones(len(labels), bool)
        cut_at[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(cut_at)
        last = np.append(at[1:], len(labels)) - 1
        spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for d, c, i, j in zip(doc[at].tolist(), labels[at].tolist(), start[at].tolist(), (start[last] + letters[last]).tolist(), strict=True):
            spans[d].append((self.languages[c], i, j))
        return [
            Found(self.languages[best[i]], float(share[i, best[i]] / total[i]), float(gain[i] / total[i]), tuple(spans[i]), int(total[i])) if found[i] else Found(UNKNOWN)
            for i in range(n)
        ]


def slices(text: str, most: int):
    """A text in slices of at most so many characters, with their places, cut between words; a longer word is cut where it stands."""
    letter, at = _tables()[0], 0
    while len(text) - at > most:
        end = at + most
        while end > at + most // 2 and letter[ord(text[end - 1])]:
            end -= 1
        if letter[ord(text[end - 1])]:
            end = at + most
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def pieces(texts: list[str], letters: int):
    """Runs of texts of about so many characters together; a longer text is a run by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > letters:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(4)) == 2


def train(docs: DataFrame, params: LangParams = LangParams(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel:
    """Counts n-grams on at most about ``docs_per_language`` labelled rows of each language, chosen by a hash of the id."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out(F.col("id"))
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(params.max_languages + 1).collect()}
    if len(sizes) > params.max_languages:
        raise ValueError(f"more than {params.max_languages} languages to learn")
    n_scripts = _tables()[3]
    nothing = LangModel([], np.zeros((params.buckets, 0), np.float32), np.zeros((n_scripts, 0), bool), params)
    if not sizes:
        return nothing
    scale = 1 << 30
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, params.docs_per_language / n) * scale)))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(scale)) < F.try_element_at(part, F.col("lang")))

    def count(batches):
        for b in batches:
            by: dict[str, list[str]] = {}
            for la, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True):
                by.setdefault(la, []).append(t)
            for la, texts in by.items():
                cut = [s for t in texts for _, s in slices(t, params.piece_letters // 4)]
                for some in pieces(cut, params.piece_letters // 4):
                    x = Letters(some, params)
                    n = np.bincount(np.concatenate(x.buckets), minlength=params.buckets) if x.buckets else np.zeros(params.buckets, int)
                    s = np.bincount(x.script, minlength=n_scripts)
                    at = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(s)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([la] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(np.concatenate([n[n > 0], s[s > 0]]), pa.int64())],
                        ["lang", "bucket", "n"],
                    )

    counts = sample.select("text", "lang").transform(arrow_map, count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    label = counts["lang"].combine_chunks().dictionary_encode()
    names = label.dictionary.to_pylist()
    languages = sorted(names)
    if not languages:
        return nothing
    grid, scripts = np.zeros((params.buckets, len(languages))), np.zeros((n_scripts, len(languages)))
    at = np.array([languages.index(x) for x in names])[label.indices.to_numpy()]
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    grid[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    scripts[-1 - bucket[bucket < 0], at[bucket < 0]] = n[bucket < 0]
    # The orders share one table, so a language's total is that of all its n-grams.
    logs = np.log(grid + params.smoothing) - np.log(grid.sum(0) + params.smoothing * params.buckets)
    logs = (logs - logs.mean(1, keepdims=True)) / len(params.orders)
    allowed = scripts > params.least_script_share * np.maximum(scripts.sum(0), 1)
    allowed[0] = True
    return LangModel(languages, logs.astype(np.float32), allowed, params)


def identify(docs: DataFrame, model: LangModel | None = None, params: LangParams = LangParams(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, evidence and spans for every row. Prediction reads the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs, params, key, text, lang))
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = model.value.predict([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.language for x in found], pa.string()), pa.array([x.share for x in found], pa.float64()),
                 pa.array([x.evidence for x in found], pa.float64()), pa.array([[{"lang": s[0], "start": s[1], "end": s[2]} for s in x.spans] for x in found], span)],
                ["doc_id", "held_out", "lang_pred", "score", "evidence", "spans"],
            )

    return docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")).transform(
        arrow_map, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, evidence double, spans array<struct<lang:string,start:int,end:int>>"
    )


@dataclass(frozen=True)
class KeepParams:
    """When a text counts as written in a language that was learned.

    A text evenly mixed from three languages gives each a third. The evidence of
    random letters is half of what a known language reaches, but that of a few letters
    scatters with the root of their number, so short texts get leeway.
    """

    least_share: float = 0.4
    least_evidence: float = 1.0
    leeway: float = 4.0

    def keeps(self, found: Found) -> bool:
        return found.language != UNKNOWN and found.share >= self.least_share and found.evidence >= self.least_evidence - self.leeway / found.letters**0.5


def keep_identified(docs: DataFrame, model: LangModel, keep: KeepParams = KeepParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is in a language by ``keep``; lang as predicted, all other columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def each(texts):
            found = model.value.predict([t or "" for t in texts])
            return [keep.keeps(x) for x in found], {lang: pa.array([x.language for x in found], pa.string())}

        return each

    return rework(docs, text, make)
