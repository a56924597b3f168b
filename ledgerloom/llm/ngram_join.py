"""Op 10: n-gram Jaccard self-join by a MinHash LSH forest.

Equal texts are one node. A node's signature of ``trees * depth`` minima over its
shingles (five words) is cut into labels, one for each tree of the forest; nodes
whose labels in a tree begin alike share a trie node of it.
How far prefixes are shortened follows from the target recall: the depth falls until
a pair at the threshold meets in some tree with that probability.

Inside a bucket, a trie node of that depth, each node is compared with all others and
linked to those whose 4-bit sketches of the signatures agree well enough; a large
bucket is cut into blocks whose pairs are tasks of their own. What is connected
already is not compared again, and only a spanning forest leaves a task.
The components of these links hold all candidate pairs. Each component is then
verified exactly and whole: its shingle sets are compared all against all in
blocks of bounded size, so that a large group becomes many tasks and no pair is
ever a row. Links are counted; only a spanning forest of them leaves a block.

Result: one row for each document: doc_id, class_id (least doc_id of its component
of links), n_links (other texts with a similarity of the threshold or more),
n_copies (documents with the same text).

Defined cases: a null or wordless text is a class by itself without links, with
n_copies 1; a text of fewer than five words has one shingle, all its words;
repeated rows are copies of each other; a class without any doc_id has class_id
null; of equal ids the least is one of them; a similarity of exactly the threshold links;
a very long text is one set of shingles in one task, with the sets of its block; an
empty table gives an empty result; only id and text are read, so other columns may have
any names. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from .common import PIECE_BYTES, U64, WordHasher, checkpoint, mix64, rolling, words_of
from .components import components, contract


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    depth: int = 8
    recall: float = 0.9995  #: at the threshold
    sketch_floor: float = 0.55  #: estimated similarity from which two nodes are linked for verification
    block: int = 256  #: nodes of a component that are compared in one task
    bucket_block: int = 8192  #: rows of a bucket whose sketches are compared in one task

    def least_depth(self) -> int:
        d = self.depth
        while d > 1 and 1 - (1 - self.threshold**d) ** self.trees < self.recall:
            d -= 1
        return d


def shingles(words: list[bytes], hasher: WordHasher, width: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    if not words:
        return np.empty(0, U64)
    h = hasher(words)
    return np.unique(rolling(h, min(width, len(h))) ^ U64(min(width, len(h))))


class Signer:
    def __init__(self, params: JoinParams):
        self.params, self.hasher = params, WordHasher()
        with np.errstate(over="ignore"):
            n = params.trees * params.depth
            self.a = mix64(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
            self.b = mix64(np.arange(1, n + 1, dtype=U64) * U64(0xAF251AF3B0F025B5))

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """Signatures, sets x (trees * depth), of non-empty sets."""
        x = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        h = np.empty_like(x)
        with np.errstate(over="ignore"):
            for j in range(len(self.a)):
                np.multiply(x, self.a[j], out=h)
                np.add(h, self.b[j], out=h)
                np.right_shift(h, U64(32), out=h)
                out[:, j] = np.minimum.reduceat(h, starts)
        return out


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _nodes(docs: DataFrame, params: JoinParams) -> DataFrame:
    """k, sig, sketch, least (doc_id), n_copies: one row for each different text with words. docs: doc_id, k, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        signer = Signer(params)
        for b in batches:
            texts, at, sets, size = b.column(2).to_pylist(), [], [], 0

            def out():
                sig = signer(sets)
                low = (sig & 15).astype(np.uint8)
                sketch = low[:, ::2] | (low[:, 1::2] << 4)
                rows = pa.array(at)
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["doc_id", "k", "sig", "sketch"],
                )

            for i, t in enumerate(texts):
                s = shingles(words_of(t), signer.hasher, params.words)
                if len(s):
                    at.append(i)
                    sets.append(s)
                    size += len(t)
                    if size > PIECE_BYTES:
                        yield out()
                        at, sets, size = [], [], 0
            if at:
                yield out()

    signed = docs.transform(arrow_map, run, f"doc_id {kind}, k bigint, sig binary, sketch binary")
    return signed.groupBy("k").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))


def _labels(nodes: DataFrame, params: JoinParams) -> DataFrame:
    """k, sketch, bucket: a row for each node and tree; a bucket is a trie node of the least depth."""
    prefix = lambda t: F.substring("sig", 1 + 4 * params.depth * t, 4 * params.least_depth())
    return nodes.select("k", "sketch", F.explode(F.array(*[F.xxhash64(F.lit(t), prefix(t)) for t in range(params.trees)])).alias("bucket"))


def _planes(sketches: pa.Array) -> np.ndarray:
    """The sketches' 4-bit values as bit planes: sketches x 4 x words of 64 values."""
    raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), -1)
    values = np.concatenate([raw & 15, raw >> 4], 1)
    bits = np.packbits((values[:, None, :] >> np.arange(4, dtype=np.uint8)[None, :, None]) & 1, axis=2)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, 0), (0, -bits.shape[2] % 8)))).view(U64)


def _alike(a: np.ndarray, b: np.ndarray, params: JoinParams) -> np.ndarray:
    """Which sketches reach the floor of the estimated similarity; one in 16 values agrees by chance."""
    x = a ^ b
    differ = np.bitwise_count(x[:, 0] | x[:, 1] | x[:, 2] | x[:, 3]).sum(1, dtype=np.int64)
    return (1 - differ / (params.trees * params.depth) - 1 / 16) * (16 / 15) >= params.sketch_floor


def _link_many(planes: np.ndarray, here: np.ndarray, params: JoinParams) -> np.ndarray:
    """For each row a row of its component under all links of a large bucket (only those across if it has two blocks).

    Each row is compared with all that its component does not hold yet.
    """
    root = np.arange(len(planes))
    across = here.any()
    right = np.flatnonzero(here == 1) if across else root.copy()
    for x in np.flatnonzero(here == 0):
        y = right[root[right] != root[x]] if across else right[x + 1 :][root[x + 1 :] != root[x]]
        if len(y) and len(y := y[_alike(planes[y], planes[x][None], params)]):
            root[np.isin(root, root[y])] = root[x]
    return root


def _bucket_links(labels: DataFrame, params: JoinParams) -> DataFrame:
    """u, v: links that connect what all pairs of rows in each bucket connect."""
    sizes = labels.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most one bucket for bucket_block rows of the labels.
    big = checkpoint(sizes.where(F.col("n") > params.bucket_block).select("bucket", F.ceil(F.col("n") / params.bucket_block).cast("int").alias("nb")))
    zero = F.lit(0)
    if big.isEmpty():
        tasks = labels.select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("here"), "k", "sketch")
    else:
        placed = labels.join(F.broadcast(big), "bucket", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        mine = placed.withColumn("mine", F.pmod(F.xxhash64("k", F.lit("bucket")), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("nb") - 1)))
        tasks = mine.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("here"), "k", "sketch")
    dealt = tasks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    few = 64  # rows up to which buckets are compared together

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        group = np.stack([t.column(c).to_numpy() for c in range(3)], 1)
        here, k = t.column(3).to_numpy(), t.column(4).to_numpy()
        new = np.ones(len(k), bool)
        new[1:] = (group[1:] != group[:-1]).any(1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(k)))
        own = np.repeat(size, size)
        rows = np.flatnonzero(own > 1)
        if not len(rows):
            return None
        planes = _planes(t.column(5).combine_chunks().take(pa.array(rows)))
        here, k, number = here[rows], k[rows], np.repeat(np.arange(len(size)), size)[rows]
        small = np.flatnonzero(own[rows] <= few)
        two = group[rows, 1] != group[rows, 2]
        us, vs = [], []
        for d in range(1, few):
            x = small[: len(small) - d]
            y = small[d:]
            good = (number[x] == number[y]) & (~two[x] | (here[x] != here[y])) if len(x) else np.zeros(0, bool)
            if not good.any() and not (number[x] == number[y]).any():
                break
            x, y = x[good], y[good]
            alike = _alike(planes[x], planes[y], params)
            us.append(k[x[alike]])
            vs.append(k[y[alike]])
        begin = np.searchsorted(number, np.flatnonzero(size > few))
        for a, n in zip(begin.tolist(), size[size > few].tolist(), strict=True):
            if two[a] and here[a : a + n].all():
                continue
            root = _link_many(planes[a : a + n], here[a : a + n], params)
            at = np.flatnonzero(root != np.arange(n))
            us.append(k[a + at])
            vs.append(k[a + root[at]])
        u, v = contract(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the bucket that the last batch ends in, maybe not whole
        for b in batches:
            if not len(b):
                continue
            last = [b.column(c)[len(b) - 1] for c in range(3)]
            same = np.ones(len(b), bool)
            for c in range(3):
                same &= b.column(c).to_numpy() == last[c].as_py()
            cut = int(np.argmax(same))
            if held and (cut or any(held[-1].column(c)[0] != last[c] for c in range(3))):
                if (out := compare(pa.Table.from_batches([*held, b.slice(0, cut)]))) is not None:
                    yield out
                held = []
            elif cut and (out := compare(pa.Table.from_batches([b.slice(0, cut)]))) is not None:
                yield out
            held.append(b.slice(cut))
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.transform(arrow_map, run, "u bigint, v bigint").distinct()


def _count_links(sets: list[np.ndarray], here: np.ndarray, params: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs at or above the threshold: the counts of each set, and the pairs' ends.

    here: 0 for sets of the first block, 1 for those of the second; only pairs across
    count if there are both. Shingles of a single set cannot be common, so only the
    others enter the product of 0/1 matrices, in strips of bounded width.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(x, kind="stable")
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(x)))
    column = np.cumsum(new) - 1
    shared = count[column] > 1
    column, row = column[shared], row[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
    a, b = np.flatnonzero(here == 0), np.flatnonzero(here == 1)
    across = len(b) > 0
    left, right = (a, b) if across else (a, a)
    common = np.zeros((len(left), len(right)), np.float32)
    strip = 4096
    if len(column):
        borders = np.searchsorted(column, np.arange(0, column[-1] + strip + 1, strip))
        for k in range(len(borders) - 1):
            lo, hi = borders[k], borders[k + 1]
            if lo == hi:
                continue
            m = np.zeros((n, strip), np.float32)
            m[row[lo:hi], column[lo:hi] - k * strip] = 1
            common += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - common
    linked = common >= params.threshold * union - 1e-6
    if not across:
        np.fill_diagonal(linked, False)
    links = np.zeros(n, np.int64)
    links[left] += linked.sum(1)
    if across:
        links[right] += linked.sum(0)
    i, j = np.nonzero(linked)
    return links, left[i], right[j]


def _verify(texts: DataFrame, member: DataFrame, params: JoinParams) -> DataFrame:
    """k, root (least node that a block links it to), n (links in the block), split: for the nodes of all components."""
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    placed = member.join(sizes, "root").select("node", "root", blocks.alias("nb"), F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int").alias("mine"))
    one = texts.join(placed, texts["k"] == placed["node"]).drop("node")
    # A node goes to every pair of blocks that has its own: as many rows as its component has blocks.
    tasks = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("here"), "k", "text", (F.col("nb") > 1).alias("split")
    )
    dealt = tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "k")

    def run(batches):
        hasher = WordHasher()
        now, held = None, []

        def flush():
            here = np.array([h for _, h, _ in held])
            if len(held) < 2 or now[1] != now[2] and len(set(here.tolist())) < 2:
                return
            k = np.array([x for x, _, _ in held], np.int64)
            links, a, b = _count_links([s for _, _, s in held], here, params)
            u, v = contract(k[a], k[b]) if len(a) else (k[:0], k[:0])
            root = dict(zip(u.tolist(), v.tolist(), strict=True))
            at = np.flatnonzero(links)
            ks = k[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ks, pa.int64()), pa.array([root.get(x, x) for x in ks], pa.int64()), pa.array(links[at]), pa.array([now[3]] * len(at), pa.bool_())], ["k", "root", "n", "split"]
            )

        for b in batches:
            root, i, j, here, k, text, split = (c.to_pylist() for c in b.columns)
            for r in range(len(root)):
                task = (root[r], i[r], j[r], split[r])
                if task != now:
                    if held:
                        yield from flush()
                    now, held = task, []
                if not held or held[-1][0] != k[r]:  # equal texts came as one node; a hash shared by two texts counts once
                    held.append((k[r], here[r], shingles(words_of(text[r]), hasher, params.words)))
        if held:
            yield from flush()

    return dealt.transform(arrow_map, run, "k bigint, root bigint, n bigint, split boolean")


def join_similar(docs: DataFrame, params: JoinParams = JoinParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links and n_copies for every row."""
    return _join(docs, params, key, text).drop("k", "lead")


def _join(docs: DataFrame, params: JoinParams, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("k"), F.col(text).alias("text"))
    full = rows.where(has_words(F.col("text")))
    nodes = checkpoint(_nodes(full, params))
    member = components(_bucket_links(_labels(nodes, params), params))
    # One text for each node: the document with the least id, or any where no row has an id; repeated rows of it fall to the verifier's check.
    single = member.join(nodes.select(F.col("k").alias("node"), "least"), "node").select(F.col("node").alias("k"), F.col("least").alias("doc_id"))
    unnamed = full.where("doc_id IS NULL").select("k", "text").dropDuplicates(["k"])
    texts = full.join(single, ["k", "doc_id"], "left_semi").select("k", "text").unionByName(
        unnamed.join(single.where("doc_id IS NULL"), "k", "left_semi").select("k", "text")
    )
    found = checkpoint(_verify(texts, member, params))
    links = found.groupBy("k").agg(F.sum("n").alias("n_links"))
    sure = found.where(~F.col("split")).select(F.col("k").alias("node"), "root")
    across = found.where("split").select(F.col("k").alias("u"), F.col("root").alias("v"))
    classes = sure.unionByName(components(across)) if not across.isEmpty() else sure
    per_node = (
        nodes.select("k", "least", "n_copies")
        .join(links, "k", "left").join(classes.select(F.col("node").alias("k"), "root"), "k", "left")
        .select("k", "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", F.col("k")).alias("root"))
    )
    per_class = per_node.groupBy("root").agg(F.min("least").alias("class_id"), F.min("k").alias("lead"))
    info = per_node.join(per_class, "root").select("k", "class_id", "lead", "n_links", "n_copies")
    return rows.select("doc_id", has_words(F.col("text")).alias("w"), "k").join(info, "k", "left").select(
        "doc_id", "k", "lead",
        F.when(F.col("w"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("w"), F.coalesce("n_copies", F.lit(1))).otherwise(F.lit(1)).cast("bigint").alias("n_copies"),
    )


def keep_one(docs: DataFrame, params: JoinParams = JoinParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of one document of each class, the one with the least id, or any if none has an id; all columns as they are. Of repeated rows one stays."""
    # Columns go by place until the end, so that none can clash.
    names, k, t = docs.columns, docs.columns.index(key), docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    # Where a class has no id at all, the text with the least key stands for it.
    one = F.col("doc_id").isNotNull() | F.col("lead").isNull() | (F.col("k") == F.col("lead"))
    best = _join(plain, params, f"c{k}", f"c{t}").where(F.col("doc_id").eqNullSafe(F.col("class_id")) & one)
    best = checkpoint(best.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n")))
    kept = lambda w: plain.join(best.where(w), F.col(f"c{k}").eqNullSafe(F.col("doc_id")) & (text_key(F.col(f"c{t}")) == F.col("k")), "left_semi")
    out = kept("n = 1")
    if not best.where("n > 1").isEmpty():
        out = out.unionByName(kept("n > 1").dropDuplicates([f"c{k}", f"c{t}"]))
    return out.toDF(*names)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

#: DuckDB SQL for the query's rows: an exact join on shingles, and components by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE t AS (SELECT min(doc_id) AS t, count(*) AS n_copies, text, any_value({_WORDS}) AS w FROM documents GROUP BY text),
full_t AS (SELECT * FROM t WHERE len(w) > 0),
s AS (SELECT DISTINCT t, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM full_t)),
size AS (SELECT t, count(*) AS n FROM s GROUP BY t),
pairs AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.t <> b.t GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN size x ON x.t = a JOIN size y ON y.t = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT t, t FROM full_t UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
class AS (SELECT a AS t, min(b) AS class_id FROM reach GROUP BY 1),
n AS (SELECT a AS t, count(*) AS n FROM linked GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(t.w) > 0 THEN c.class_id ELSE d.doc_id END AS class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
  CASE WHEN len(t.w) > 0 THEN t.n_copies ELSE 1 END AS n_copies
FROM documents d JOIN t ON t.text IS NOT DISTINCT FROM d.text LEFT JOIN class c ON c.t = t.t AND len(t.w) > 0 LEFT JOIN n ON n.t = t.t
"""
