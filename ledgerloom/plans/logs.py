"""Logs, streams and stored forms over the tables, with SQL for each."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hex_of, le_bytes, le_uint
from ..operators import inventory, records, replay
from ..sources import binary, payloads, snapshot
from ..sources import projection as P
from ..streaming import op_stream

# What an event's type means as an operation on its user's slot.
OPS = {"purchase": "spend", "click": "unspend", "error": "freeze", "signup": "unfreeze", "view": "read"}


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/ledgerloom-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _log(s, d):
    """The events as operations; a user's spender is one of three."""
    op = F.element_at(F.create_map(*[F.lit(x) for p in OPS.items() for x in p]), F.col("event_type"))
    return P.read(s, d, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) * 16 + F.col("event_id") % 16).alias("seq"), op.alias("op"), (F.col("event_id") % 3).alias("spender"))


def replay_fold(s, d):
    return replay.fold(_log(s, d))


def replay_from_snapshot(s, d):
    """The log in two halves, the second folded on the state after the first: the same as the whole."""
    log = _log(s, d)
    half = F.col("seq") < 1704067200000000 * 16
    return replay.fold(log.where(~half), replay.fold(log.where(half)))


def double_spend_stream(s, d):
    """The log through the streaming state machine, written out and summed up."""
    folder = _folder(s)
    _log(s, d).write.parquet(f"{folder}/log")
    stream = s.readStream.schema(op_stream.LOG).parquet(f"{folder}/log")
    return op_stream.totals(s.read.parquet(op_stream.run_once(stream, folder)))


def snapshot_round_trip(s, d):
    folder = _folder(s)
    snapshot.write(P.state(s, d), folder)
    return inventory.slot_inventory(snapshot.read(s, folder))


def backup_verified(s, d):
    """A backup's tables against its manifest, and the rows of what is restored."""
    folder = _folder(s)
    snapshot.write(P.state(s, d), folder)
    st = snapshot.restore(s, folder)
    rows = None
    for name in snapshot.TABLES:
        one = getattr(st, name).agg(F.count(F.lit(1)).alias("restored")).withColumn("table", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return snapshot.verify(s, folder).join(rows, "table")


def _scan(s, d):
    """What a scan of stored bytes finds: spent slots 3 damaged, tombstones over some records."""
    st = P.state(s, d)
    raw = binary.slot_bytes(F.col("hash"), F.col("status"), F.col("spender"), F.col("vin"), F.col("cooldown"))
    hurt = (F.col("vout") == 3) & (F.col("status") == 1)
    slots = st.utxo.select("txid", "vout", F.when(hurt, F.concat(F.substring(raw, 1, 72), le_bytes((le_uint(raw, 72, 1) + 1) % 256, 1))).otherwise(raw).alias("raw")).withColumn("p", binary.parse_slot(F.col("raw")))
    slots = slots.select("txid", "vout", *[F.col(f"p.{c}").alias(c) for c in ("hash", "status", "spender", "vin", "cooldown", "intact")])
    blank = st.tx.withColumns({"spent_utxos": F.lit(-1).cast("long"), "pruned_utxos": F.lit(-1).cast("long")})
    tombs = P.tx_items(s, d).select("txid", (F.col("k") % 2 - 1).cast("long").alias("generation"))
    return records.rebuild(blank, slots, st.block, st.children, tombs)


def rebuild_scan(s, d):
    """The records that a scan brings back, with counters from their slots and the height at which they are due."""
    return _scan(s, d)[0].tx.select(hex_of("txid").alias("txid"), "utxo_count", "spent_utxos", "pruned_utxos", "delete_at_height")


def rebuild_skipped(s, d):
    return _scan(s, d)[1].select(hex_of("txid").alias("txid"), "why")


def rebuild_counters(s, d):
    """Counters from the slots alone, after the stored ones were lost."""
    st = P.state(s, d)
    lost = st.but(tx=st.tx.withColumns({"spent_utxos": F.lit(0).cast("long"), "pruned_utxos": F.lit(0).cast("long")}))
    return records.rebuild_counters(lost).tx.select(hex_of("txid").alias("txid"), "utxo_count", "spent_utxos", "pruned_utxos")


def slot_codec(s, d):
    """Slots written as bytes and read again."""
    u = P.state(s, d).utxo
    raw = binary.slot_bytes(F.col("hash"), F.col("status"), F.col("spender"), F.col("vin"), F.col("cooldown"))
    p = u.select("vout", raw.alias("raw")).withColumn("p", binary.parse_slot(F.col("raw")))
    return p.select(hex_of("p.hash").alias("hash"), "vout", "p.status", F.coalesce(hex_of("p.spender"), F.lit("")).alias("spender"), F.coalesce("p.vin", F.lit(-1)).alias("vin"), "p.cooldown", "p.intact", F.length("raw").cast("long").alias("n_bytes"))


def frame_codec(s, d):
    """Frames written and read again; half of the request ids are beyond BIGINT."""
    big = F.when(F.col("o_orderkey") % 2 == 1, F.lit(str(1 << 63))).otherwise("0").cast("decimal(20,0)")
    raw = binary.frame((F.col("o_orderkey").cast("decimal(19,0)") + big).cast("decimal(20,0)"), F.lit(1), F.lit(0), F.encode("o_orderpriority", "UTF-8"))
    p = P.read(s, d, "orders").select(raw.alias("raw")).withColumn("p", binary.parse_frame(F.col("raw")))
    return p.select(F.col("p.request_id").cast("string").alias("request_id"), "p.op", F.decode("p.payload", "UTF-8").alias("payload"), "p.whole", F.length("raw").cast("long").alias("n_bytes"))


def blob_assembly(s, d):
    """Customer names cut into chunks of five bytes; those of each seventh customer lose the first."""
    c = P.read(s, d, "customer").select(F.col("c_custkey").alias("key"), F.encode("c_name", "UTF-8").alias("b"))
    n = F.ceil(F.length("b") / 5) - 1
    chunks = c.select("key", "b", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("i")).where("key % 7 <> 0 OR i > 0")
    return binary.assemble(chunks.select("key", (F.col("i") * 5).cast("long").alias("at"), F.expr("substring(b, i * 5 + 1, 5)").alias("data")))


# The shared parameters that the encoded batches carry.
HEADERS = {
    "spend": {"ignore_conflicting": 0, "ignore_locked": 1, "current_block_height": 2000, "block_height_retention": 288},
    "unspend": {"current_block_height": 2000, "block_height_retention": 288},
    "set_mined": {"block_id": 103, "block_height": 2000, "subtree_idx": 3, "on_longest_chain": 1, "unset_mined": 0, "current_block_height": 2000, "block_height_retention": 288},
    "reassign": {"block_height": 2000, "spendable_after": 1000}, "slots": {}, "get": {"field_mask": 524287},
}


def _batches(s, d, kind):
    """Batches of consecutive orders as payloads: slot items are the lines that were returned, the others records."""
    if kind in ("set_mined", "get"):
        rows = P.tx_items(s, d).withColumn("place", F.col("k"))
    else:
        rows = P.items(s, d, "A").withColumns({"place": F.col("k") * 1000 + F.col("seq"), "spending_data": F.concat("spender", le_bytes(F.col("vin"), 4))})
    rows = rows.withColumn("batch", F.floor(F.col("k") / 4000))
    return payloads.encode(rows, kind, "batch", "place", {n: F.lit(v) for n, v in HEADERS[kind].items()})


def payload_codecs(s, d):
    """Sizes and digests of every kind of batch, and what a reader makes of it."""
    out = None
    for kind in HEADERS:
        told = _batches(s, d, kind).select("*", F.explode(F.array(payloads.decode(F.col("payload"), kind))).alias("read"))
        one = told.select(F.lit(kind).alias("kind"), "batch", "n_items", F.length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"), F.col("read.code").alias("code"), F.size("read.items").cast("long").alias("n_read"))
        out = one if out is None else out.unionByName(one)
    return out


def payload_round_trip(s, d):
    """The items of spend batches as read from their payloads."""
    read = _batches(s, d, "spend").select(F.explode(payloads.decode(F.col("payload"), "spend")["items"]).alias("i"))
    return read.select(hex_of("i.txid").alias("txid"), "i.vout", hex_of("i.hash").alias("hash"), hex_of("i.spending_data").alias("spending_data"))


def replica_watermarks(s, d):
    """Event numbers as replicated batches: every seventh is sent again from further back, others leave gaps or come twice."""
    w = Window.partitionBy(F.col("user_id") % 5).orderBy("event_id")
    e = P.read(s, d, "events").select((F.col("user_id") % 5).cast("long").alias("stream"), F.col("event_id").alias("arrival"), F.row_number().over(w).cast("long").alias("n"))
    again, gap = F.col("n") % 7 == 0, F.col("arrival") % 9 == 0
    first = F.when(again, F.greatest(F.lit(1), F.col("n") - 30)).otherwise(F.col("n") + F.when(gap, 2).otherwise(0))
    last = F.when(again, F.col("n")).otherwise(F.col("n") + F.when(gap, 2).otherwise(0) + F.col("arrival") % 4 - 1)
    return replay.receive(e.select("stream", "arrival", first.alias("first"), last.alias("last")))


def replica_generations(s, d):
    """Records whose generations are near the end of the 32-bit circle, and writes from before and after it."""
    local = P.read(s, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.pmod(F.lit(4294967290) + F.col("c_custkey") % 10, F.lit(1 << 32)).cast("long").alias("generation"), F.lit(-1).cast("long").alias("value"))
    writes = P.read(s, d, "orders").select(F.col("o_custkey").cast("long").alias("key"), F.pmod(F.lit(4294967288) + F.col("o_orderkey") % 16, F.lit(1 << 32)).cast("long").alias("generation"), F.col("o_orderkey").cast("long").alias("value"))
    return replay.apply_generations(local, writes)


def _le_sql(x: str, width: int) -> str:
    return "printf('" + "%02x" * width + "', " + ", ".join(f"({x} >> {8 * i}) & 255" for i in range(width)) + ")"


def _payloads_sql() -> str:
    out = []
    for kind, header in HEADERS.items():
        shared, fields = payloads.LAYOUTS[kind]
        records = kind in ("set_mined", "get")
        source = "SELECT *, k AS place FROM tx_items" if records else f"SELECT *, k * 1000 + seq AS place, spender || {_le_sql('vin', 4)} AS spending_data FROM items WHERE l_returnflag = 'A'"
        item = " || ".join(n if w >= payloads.RAW else _le_sql(n, w) for n, w in fields)
        head = " || ".join([_le_sql("count(*)", 4), *[_le_sql(f"CAST({header[n]} AS BIGINT)", w) for n, w in shared]])
        out.append(f"""SELECT '{kind}' AS kind, batch, n_items, CAST(length(p) // 2 AS BIGINT) AS n_bytes, sha256(from_hex(p)) AS digest, CAST(0 AS BIGINT) AS code, n_items AS n_read
          FROM (SELECT k // 4000 AS batch, count(*) AS n_items, {head} || string_agg({item}, '' ORDER BY place) AS p FROM ({source}) GROUP BY 1)""")
    return f"WITH {P.SQL} " + " UNION ALL ".join(out)


_FOLD = """WITH log AS (SELECT user_id AS key, epoch_us(ts) * 16 + event_id % 16 AS seq, event_type AS op, event_id % 3 AS spender FROM events),
lists AS (SELECT key, list({'op': op, 'spender': spender} ORDER BY seq) AS l FROM log GROUP BY 1),
folded AS (SELECT key, list_reduce(l, lambda a, x: CASE
    WHEN x.op = 'purchase' AND a.status = 0 THEN {'status': 1, 'spender': x.spender, 'n_ok': a.n_ok + 1, 'n_same': a.n_same, 'n_failed': a.n_failed}
    WHEN x.op = 'click' AND a.status = 1 AND a.spender = x.spender THEN {'status': 0, 'spender': -1, 'n_ok': a.n_ok + 1, 'n_same': a.n_same, 'n_failed': a.n_failed}
    WHEN x.op = 'error' AND a.status = 0 THEN {'status': 255, 'spender': -1, 'n_ok': a.n_ok + 1, 'n_same': a.n_same, 'n_failed': a.n_failed}
    WHEN x.op = 'signup' AND a.status = 255 THEN {'status': 0, 'spender': -1, 'n_ok': a.n_ok + 1, 'n_same': a.n_same, 'n_failed': a.n_failed}
    WHEN x.op IN ('view', 'click') OR (x.op = 'purchase' AND a.status = 1 AND a.spender = x.spender) THEN {'status': a.status, 'spender': a.spender, 'n_ok': a.n_ok, 'n_same': a.n_same + 1, 'n_failed': a.n_failed}
    ELSE {'status': a.status, 'spender': a.spender, 'n_ok': a.n_ok, 'n_same': a.n_same, 'n_failed': a.n_failed + 1} END,
  {'status': 0::BIGINT, 'spender': (-1)::BIGINT, 'n_ok': 0::BIGINT, 'n_same': 0::BIGINT, 'n_failed': 0::BIGINT}) AS s FROM lists)
SELECT key, s.status, s.spender, s.n_ok, s.n_same, s.n_failed FROM folded"""

_SCAN = f"""hurt AS (SELECT DISTINCT k FROM utxo WHERE vout = 3 AND status = 1),
tombs AS (SELECT txid FROM tx_items WHERE k % 2 = 1),
seen AS (SELECT tx.*, CASE WHEN txid IN (SELECT txid FROM tombs) THEN 'tombstone' WHEN k IN (SELECT k FROM hurt) THEN 'slots' END AS why FROM tx)"""

QUERIES = {
    k: globals()[k]
    for k in ("payload_codecs", "payload_round_trip", "replica_watermarks", "replica_generations", "replay_fold", "replay_from_snapshot", "double_spend_stream", "snapshot_round_trip", "backup_verified", "rebuild_scan", "rebuild_skipped", "rebuild_counters", "slot_codec", "frame_codec", "blob_assembly")
}

ORACLES = {
    "payload_codecs": _payloads_sql(),
    "payload_round_trip": f"WITH {P.SQL} SELECT txid, vout, hash, spender || {_le_sql('vin', 4)} AS spending_data FROM items WHERE l_returnflag = 'A'",
    "replica_watermarks": """WITH e AS (SELECT user_id % 5 AS stream, event_id AS arrival, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n FROM events),
      b AS (SELECT stream, arrival, CASE WHEN n % 7 = 0 THEN greatest(1, n - 30) ELSE n + CASE WHEN arrival % 9 = 0 THEN 2 ELSE 0 END END AS first,
        CASE WHEN n % 7 = 0 THEN n ELSE n + CASE WHEN arrival % 9 = 0 THEN 2 ELSE 0 END + arrival % 4 - 1 END AS last FROM e),
      l AS (SELECT stream, list({'f': CAST(first AS BIGINT), 'l': CAST(last AS BIGINT)} ORDER BY arrival) AS l FROM b GROUP BY 1),
      f AS (SELECT stream, list_reduce(l, lambda a, x: CASE
          WHEN x.l < x.f THEN {'w': a.w, 'a': a.a, 'd': a.d, 'p': a.p + 1, 'g': a.g}
          WHEN x.l <= a.w THEN {'w': a.w, 'a': a.a, 'd': a.d + 1, 'p': a.p, 'g': a.g}
          WHEN x.f > a.w + 1 THEN {'w': a.w, 'a': a.a, 'd': a.d, 'p': a.p, 'g': a.g + 1}
          ELSE {'w': x.l, 'a': a.a + 1, 'd': a.d, 'p': a.p, 'g': a.g} END,
        {'w': 0::BIGINT, 'a': 0::BIGINT, 'd': 0::BIGINT, 'p': 0::BIGINT, 'g': 0::BIGINT}) AS s FROM l)
      SELECT stream, s.w AS watermark, s.a AS n_applied, s.d AS n_duplicate, s.p AS n_probe, s.g AS n_gap FROM f""",
    "replica_generations": """WITH local AS (SELECT c_custkey AS key, (4294967290 + c_custkey % 10) % 4294967296 AS own FROM customer),
      w AS (SELECT o_custkey AS key, (4294967288 + o_orderkey % 16) % 4294967296 AS g, o_orderkey AS v FROM orders),
      ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.key ORDER BY (g - coalesce(own, 0) + 4294967296) % 4294967296 DESC, v) AS r
        FROM w LEFT JOIN local USING (key) WHERE own IS NULL OR (g - own + 4294967296) % 4294967296 BETWEEN 1 AND 2147483647)
      SELECT coalesce(l.key, r.key) AS key, coalesce(g, own) AS generation, coalesce(v, -1) AS value FROM local l FULL JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.key = l.key""",
    "replay_fold": _FOLD,
    "replay_from_snapshot": _FOLD,
    "double_spend_stream": _FOLD,
    "snapshot_round_trip": f"WITH {P.SQL} SELECT count(*) AS total, count(*) FILTER (status = 1) AS spent, count(*) FILTER (status = 2) AS pruned, count(*) FILTER (status = 255) AS frozen, count(*) FILTER (status = 0) AS unspent FROM utxo",
    "backup_verified": f"WITH {P.SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows, true AS intact, count(*) AS restored FROM {n}" for n in snapshot.TABLES),
    "rebuild_scan": f"WITH {P.SQL}, {_SCAN} SELECT txid, utxo_count, spent_utxos, pruned_utxos, CAST(delete_at_height AS BIGINT) AS delete_at_height FROM seen WHERE why IS NULL",
    "rebuild_skipped": f"WITH {P.SQL}, {_SCAN} SELECT txid, why FROM seen WHERE why IS NOT NULL",
    "rebuild_counters": f"WITH {P.SQL} SELECT txid, utxo_count, spent_utxos, pruned_utxos FROM tx",
    "slot_codec": f"WITH {P.SQL} SELECT hash, vout, CAST(status AS BIGINT) AS status, coalesce(spender, '') AS spender, CAST(coalesce(vin, -1) AS BIGINT) AS vin, CAST(cooldown AS BIGINT) AS cooldown, true AS intact, CAST(73 AS BIGINT) AS n_bytes FROM utxo",
    "frame_codec": "SELECT CAST(CAST(o_orderkey AS HUGEINT) + CASE WHEN o_orderkey % 2 = 1 THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END AS VARCHAR) AS request_id, CAST(1 AS BIGINT) AS op, o_orderpriority AS payload, true AS whole, CAST(16 + strlen(o_orderpriority) AS BIGINT) AS n_bytes FROM orders",
    "blob_assembly": "SELECT c_custkey AS key, CAST(CASE WHEN c_custkey % 7 = 0 THEN 18 ELSE 0 END AS BIGINT) AS code, CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE strlen(c_name) END AS BIGINT) AS size, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE sha256(c_name) END AS sha256 FROM customer WHERE c_custkey % 7 <> 0 OR strlen(c_name) > 5",
}
