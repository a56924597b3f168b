"""Op 8: secret scan by token efficiency.

A byte-pair vocabulary spells ordinary strings with few tokens and random ones with
many. Unbroken strings are cut at known digests and identifiers (hex of a digest's
length, UUIDs, dates, numbers) and at spans that the three fixed patterns have found.
What remains is tokenised, and its stretches of few characters a token are reported:
the maximal segments of the sum of (limit - characters) over tokens, so that neither a
path before a key nor a word behind it hides the key. Letters without a digit must be
spelt less efficiently still. The patterns' own spans always stay.

Only the candidate strings are tokenised, not the text, and in pieces of bounded size.
The vocabulary file is read once on the driver and broadcast: its size is that of a
fixed published file, checked against ``most_vocabulary_bytes``.

Defined cases: a null or empty text has no spans (digest of the empty string);
positions are code points; of equally good stretches the shortest, leftmost counts;
spans that begin together are in the order of kinds; very long texts are scanned whole;
repeated rows give repeated results; an empty table gives an empty one; only id and
text are read, and masking changes the text alone, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import rework

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

# A word that every ASSIGN match contains, and strings that are identifiers, not secrets.
HINTS = ("passw", "secret", "token", "api")
KNOWN = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?:19|20)\d\d[-_/]?\d\d[-_/]?\d\d|\d+|[0-9a-f]+|[0-9A-F]+)(?![0-9A-Za-z])"
)
HEXES = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class SecretLimits:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    most_vocabulary_bytes: int = 16 << 20
    least_length: int = 20
    most_chars_per_token: float = 2.0
    most_chars_without_digit: float = 1.6
    piece: int = 4096  #: characters that are tokenised at once


_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(raw: bytes) -> tiktoken.Encoding:
    """One encoding a worker process, however many tasks it runs."""
    if (found := _encodings.get(key := hash(raw))) is None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        found = _encodings[key] = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return found


def maximal_segments(weights: list[float]) -> list[tuple[int, int]]:
    """The best segment by sum, then the best left and right of it, and so on as long as sums are positive; in order, in linear time.

    A segment keeps the sums before it and at its end. A new positive weight joins the
    segments back to the last one that begins lower and ends no higher.
    """
    kept: list[tuple[float, float, int, int, int]] = []  # sum before, sum at the end, begin, end, the last segment that begins lower
    total = 0.0
    for i, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        low, begin = before, i
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][0] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][1] >= total:
                kept.append((low, total, begin, i + 1, k))
                break
            low, begin = kept[k][0], kept[k][2]
            del kept[k:]
    return [(a, b) for _, _, a, b, _ in kept]


class SecretScanner:
    def __init__(self, raw: bytes, limits: SecretLimits = SecretLimits()):
        self.encoding, self.limits = _encoding(raw), limits
        self.long = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % limits.least_length)

    @staticmethod
    def base(text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the fixed patterns."""
        out = []
        low = text.lower()
        if any(h in low for h in HINTS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        # A maximal run of hex digits: the greedy pattern matches nothing else.
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(out)

    def holes(self, run: str, at: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """What of a run is known, in places of the run, sorted."""
        out = [(max(0, x - at), min(len(run), y - at)) for x, _, y in base if x < at + len(run) and at < y]
        for m in KNOWN.finditer(run):
            s = m[0]
            if s.isdigit() or not HEXES.fullmatch(s) or len(s) in DIGEST_LENGTHS:
                out.append(m.span())
        return sorted(out)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out = []
        for m in self.long.finditer(text):
            run, at, a = m[0], m.start(), 0
            for x, y in [*self.holes(run, at, base), (len(run), len(run))]:
                for p in range(a, x, self.limits.piece):
                    out += [(at + i, 3, at + j) for i, j in self.stretches(run[p : min(p + self.limits.piece, x)], p)]
                a = max(a, y)
        return out

    def stretches(self, s: str, at: int) -> list[tuple[int, int]]:
        """The inefficient stretches of a string without known parts, in places shifted by at."""
        limits = self.limits
        if len(s) < limits.least_length:
            return []
        sizes = [len(x) for x in self.encoding.decode_tokens_bytes(self.encoding.encode_ordinary(s))]
        ends = [0, *accumulate(sizes)]
        out = []
        for i, j in maximal_segments([limits.most_chars_per_token - n for n in sizes]):
            a, b = ends[i], ends[j]
            found = s[a:b]
            most = limits.most_chars_per_token if any(map(str.isdigit, found)) else limits.most_chars_without_digit
            if b - a >= limits.least_length and any(map(str.isalpha, found)) and b - a <= most * (j - i) and len(set(found)) >= limits.least_length // 2:
                out.append((at + a, at + b))
        return out

    def __call__(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        if not text:
            return [], []
        base = self.base(text)
        return base, sorted(base + self.added(text, base))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def read_vocabulary(limits: SecretLimits) -> bytes:
    with open(limits.vocabulary, "rb") as f:
        raw = f.read(limits.most_vocabulary_bytes + 1)
    if len(raw) > limits.most_vocabulary_bytes:
        raise ValueError(f"{limits.vocabulary} has more than {limits.most_vocabulary_bytes} bytes")
    return raw


def scan(docs: DataFrame, limits: SecretLimits = SecretLimits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(limits))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        scanner = SecretScanner(shared.value, limits)
        for b in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for t in b.column(1).to_pylist():
                base, found = scanner(t)
                for i, c in enumerate(counts):
                    c.append(sum(k == i for _, k, _ in found))
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).transform(
        arrow_map, run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    )


def cover(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with every run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, mark: str, limits: SecretLimits = SecretLimits(), text: str = "text") -> DataFrame:
    """All rows and columns of docs, secrets in the text replaced by the mark."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(limits))

    def make():
        scanner = SecretScanner(shared.value, limits)
        return lambda texts: (None, {text: pa.array([cover(t, scanner(t)[1], mark) for t in texts], pa.string())})

    return rework(docs, text, make)
