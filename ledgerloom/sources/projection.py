"""A deterministic state and item batches derived from the star-schema tables, in Spark and as SQL.

One record for each order with lines, one slot for each line. The same rules are
given twice, as DataFrames and as DuckDB common table expressions, so that results
can be compared engine against engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators.state import State

_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_ORDER = ", ".join(_LINE)


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("string"), 256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows laid by an id get a part for so many bytes of the tables' files, and for so many of their rows (files that
#: compress well hold more of them), so that what a task sorts stays in its memory.
PART_BYTES, PART_ROWS = 8 << 20, 1 << 19

#: A task that reads the files for such parts gets no more than this of them: with more parts than
#: spark.shuffle.sort.bypassMergeThreshold it sorts its rows by part, in some 12 times the bytes of a file of plain rows.
SPLIT_BYTES, SPLIT_ROWS = 32 << 20, 1 << 21
SPLIT_SETTING = "spark.sql.files.maxPartitionBytes"

#: Rows of tables by path, bytes and time of change.
_counted: dict[tuple[str, int, int], int] = {}


def parts_of(spark: SparkSession, sf_dir: str) -> int | None:
    """Parts for rows laid by an id: one number for all rows of a directory, so that they meet as they lie; none where the session's own is enough."""
    conf, size, rows = spark._jsparkSession.sessionState().newHadoopConf(), 0, 0
    for name in ("orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        key = (f"{sf_dir}/{name}", fs.getContentSummary(path).getLength(), fs.getFileStatus(path).getModificationTime())
        if key not in _counted:
            _counted[key] = read(spark, sf_dir, name).count()  # of the files' footers
        size, rows = size + key[1], rows + _counted[key]
    parts = max(-(-size // PART_BYTES), -(-rows // PART_ROWS))
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return None
    split = min(SPLIT_BYTES, max(1, size * SPLIT_ROWS // max(1, rows)))
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > split:
        spark.conf.set(SPLIT_SETTING, str(split))
    return parts


def by_id(df: DataFrame, name: str, of: Column, parts: int | None) -> DataFrame:
    """Rows laid by an id that is a hash of their columns, and the id. Only the columns are shuffled, the hash is made after it."""
    return (df.repartition(parts, of) if parts else df.repartition(of)).withColumn(name, of)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their record (txid), place (vout), sequence number and the order's count of lines; those of a record lie together."""
    # An id that is never null needs no filter, so that all readers of the lines share one shuffle. No record has the empty one.
    own, txid = Window.partitionBy("txid"), F.coalesce(_sha(F.col("l_orderkey")), F.lit(b""))
    return by_id(read(spark, sf_dir, "lineitem"), "txid", txid, parts_of(spark, sf_dir)).withColumns({
        "vout": (F.row_number().over(own.orderBy(*_LINE)) - 1).cast("long"),
        "seq": F.row_number().over(own.orderBy("l_shipdate", *_LINE)).cast("long"),
        "n": F.count(F.lit(1)).over(own),
    })


def _height() -> Column:
    return F.greatest(F.lit(1), F.lit(1000) + F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))).cast("long")


def state(spark: SparkSession, sf_dir: str) -> State:
    li = lines(spark, sf_dir)
    zero, parts = F.lit(0).cast("long"), parts_of(spark, sf_dir)
    o = by_id(read(spark, sf_dir, "orders").withColumn("h", _height()), "txid", _sha(F.col("o_orderkey")), parts)
    n = by_id(read(spark, sf_dir, "lineitem"), "txid", _sha(F.col("l_orderkey")), parts).groupBy("txid").agg(
        F.count(F.lit(1)).alias("utxo_count"),
        F.sum(F.col("l_quantity").between(5.5, 15.5).cast("long")).alias("spent_utxos"),
        F.sum(F.col("l_quantity").between(15.6, 16.5).cast("long")).alias("pruned_utxos"),
    )
    flag = lambda when, bit: F.when(when, bit).otherwise(0)
    coinbase = F.col("o_orderkey") % 10 == 0
    tx = o.join(n, "txid").select(
        "txid", F.lit(1).cast("long").alias("tx_version"), zero.alias("locktime"), F.lit(500).cast("long").alias("fee"),
        F.lit(250).cast("long").alias("size_in_bytes"),
        (flag(coinbase, C.IS_COINBASE) + flag(F.col("o_orderstatus") == "P", C.CONFLICTING) + flag(F.col("o_custkey") % 5 == 0, C.LOCKED) + flag(F.col("o_custkey") % 3 == 0, C.EXTERNAL)).cast("long").alias("flags"),
        F.when(coinbase, F.col("h") + 100).otherwise(0).alias("spending_height"), F.lit(1710000000000).alias("created_at"),
        "utxo_count", "spent_utxos", "pruned_utxos", zero.alias("generation"), F.lit(1710000000000).alias("updated_at"), zero.alias("reassignment_count"),
        F.when(F.col("o_orderstatus") == "O", F.col("h")).otherwise(0).alias("unmined_since"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("h") + 288).otherwise(0).alias("delete_at_height"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("h") + 500).otherwise(0).alias("preserve_until"),
    )
    q = F.col("l_quantity")
    status = F.when(q <= 5.5, C.FROZEN).when(q <= 15.5, C.SPENT).when(q <= 16.5, C.PRUNED).otherwise(C.UNSPENT).cast("long")
    held = q.between(5.5, 16.5)
    utxo = li.join(o.select("txid", "h"), "txid").select(
        "txid", "vout", _sha(F.concat_ws(":", "l_orderkey", "vout")).alias("hash"), status.alias("status"),
        F.when(held, _sha(F.col("l_suppkey"))).alias("spender"), F.when(held, F.col("l_linenumber").cast("long")).alias("vin"),
        F.when((q > 16.5) & (F.col("l_linenumber") == 1), F.col("h") + 50).otherwise(0).alias("cooldown"),
    )
    block = o.where("o_orderstatus = 'F'").join(n.select("txid"), "txid", "left_semi").select(
        "txid", (F.col("h") % 7 + 100).alias("block_id"), F.col("h").alias("block_height"), zero.alias("subtree_idx")
    )
    children = by_id(read(spark, sf_dir, "lineitem").where("l_suppkey % 10 < 2"), "parent", _sha(F.col("l_orderkey")), parts).select(
        "parent", _sha(F.col("l_suppkey")).alias("child"), F.when(F.col("l_suppkey") % 10 == 0, "deleted").otherwise("conflicting").alias("kind")
    ).distinct()
    return State(tx, utxo, block, children)


def items(spark: SparkSession, sf_dir: str, returnflag: str) -> DataFrame:
    """A batch of slot items: k (the order), txid, vout, hash, seq, spender, vin, new_hash, reserved."""
    li = lines(spark, sf_dir).where(F.col("l_returnflag") == returnflag).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "seq", "n")
    li = by_id(li, "txid", _sha(F.when(F.col("l_tax") >= 0.075, F.concat(F.lit("u"), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string"))), parts_of(spark, sf_dir))
    vout = (F.col("l_partkey") % (F.col("n") + 1)).cast("long")
    return li.select(
        F.col("l_orderkey").alias("k"), "txid", vout.alias("vout"),
        F.when(F.col("l_discount") >= 0.085, _sha(F.lit("x"))).otherwise(_sha(F.concat_ws(":", "l_orderkey", vout))).alias("hash"),
        "seq", _sha(F.col("l_suppkey")).alias("spender"), F.col("l_linenumber").cast("long").alias("vin"),
        _sha(F.concat_ws("/", "l_orderkey", vout, "seq")).alias("new_hash"),
        ((F.col("l_linenumber") == 4) & (F.col("l_discount") < 0.005)).alias("reserved"),
    )


def tx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of record items, one for each order: k, txid, seq; the txid is unknown unless custkey % 3 = 1."""
    unknown = (F.col("o_custkey") % 3 != 1) | (F.col("o_orderkey") % 97 == 0)
    txid = _sha(F.when(unknown, F.concat(F.lit("u"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")))
    return by_id(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "txid", txid, parts_of(spark, sf_dir)).select(
        F.col("o_orderkey").alias("k"), "txid", F.col("o_orderkey").cast("long").alias("seq"),
    )


#: DuckDB common table expressions for the same rows.
SQL = f"""
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS vout,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, {_ORDER}) AS seq, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
o AS (SELECT *, greatest(1, 1000 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS h FROM orders),
tx AS (
  SELECT o_orderkey AS k, o_custkey, sha256(CAST(o_orderkey AS VARCHAR)) AS txid,
    (CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END
     + CASE WHEN o_custkey % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 8 ELSE 0 END) AS flags,
    CASE WHEN o_orderkey % 10 = 0 THEN h + 100 ELSE 0 END AS spending_height, utxo_count, spent_utxos, pruned_utxos, 0 AS generation,
    CASE WHEN o_orderstatus = 'O' THEN h ELSE 0 END AS unmined_since, CASE WHEN o_orderkey % 4 = 0 THEN h + 288 ELSE 0 END AS delete_at_height,
    CASE WHEN o_orderkey % 11 = 0 THEN h + 500 ELSE 0 END AS preserve_until, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_blocks, h
  FROM o JOIN (
    SELECT l_orderkey, count(*) AS utxo_count, count(*) FILTER (l_quantity BETWEEN 5.5 AND 15.5) AS spent_utxos,
      count(*) FILTER (l_quantity BETWEEN 15.6 AND 16.5) AS pruned_utxos
    FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
utxo AS (
  SELECT l_orderkey AS k, sha256(CAST(l_orderkey AS VARCHAR)) AS txid, vout, sha256(l_orderkey || ':' || vout) AS hash,
    CASE WHEN l_quantity <= 5.5 THEN 255 WHEN l_quantity <= 15.5 THEN 1 WHEN l_quantity <= 16.5 THEN 2 ELSE 0 END AS status,
    CASE WHEN l_quantity BETWEEN 5.5 AND 16.5 THEN sha256(CAST(l_suppkey AS VARCHAR)) END AS spender,
    CASE WHEN l_quantity BETWEEN 5.5 AND 16.5 THEN l_linenumber END AS vin,
    CASE WHEN l_quantity > 16.5 AND l_linenumber = 1 THEN h + 50 ELSE 0 END AS cooldown
  FROM li JOIN o ON o_orderkey = l_orderkey),
block AS (SELECT txid, h % 7 + 100 AS block_id, h AS block_height FROM tx WHERE n_blocks = 1),
children AS (
  SELECT DISTINCT sha256(CAST(l_orderkey AS VARCHAR)) AS parent, sha256(CAST(l_suppkey AS VARCHAR)) AS child,
    CASE WHEN l_suppkey % 10 = 0 THEN 'deleted' ELSE 'conflicting' END AS kind
  FROM lineitem WHERE l_suppkey % 10 < 2),
items AS (
  SELECT l_orderkey AS k, l_returnflag, CASE WHEN l_tax >= 0.075 THEN sha256('u' || l_orderkey) ELSE sha256(CAST(l_orderkey AS VARCHAR)) END AS txid,
    l_partkey % (n + 1) AS vout, CASE WHEN l_discount >= 0.085 THEN sha256('x') ELSE sha256(l_orderkey || ':' || l_partkey % (n + 1)) END AS hash,
    seq, sha256(CAST(l_suppkey AS VARCHAR)) AS spender, l_linenumber AS vin, sha256(l_orderkey || '/' || l_partkey % (n + 1) || '/' || seq) AS new_hash,
    l_linenumber = 4 AND l_discount < 0.005 AS reserved
  FROM li),
tx_items AS (
  SELECT o_orderkey AS k, sha256(CASE WHEN o_custkey % 3 <> 1 OR o_orderkey % 97 = 0 THEN 'u' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END) AS txid, o_orderkey AS seq
  FROM o)"""


def dah_sql(source: str, height: int, retention: int, touched: str, has_blocks: str, extra: str = "") -> str:
    """A SELECT that evaluates the lifecycle over a relation with the columns of tx."""
    due = height + retention
    every, last, ext = "(spent_utxos = utxo_count AND flags & 64 = 0)", "(flags & 16 <> 0)", "(flags & 8 <> 0)"
    fin = f"({every} AND {has_blocks} AND unmined_since = 0)"
    live = f"({touched}) AND {retention} <> 0 AND preserve_until = 0 AND {due} <= 4294967295"
    rule = (
        f"CASE WHEN NOT ({live}) THEN 0 WHEN flags & 2 <> 0 THEN CASE WHEN delete_at_height = 0 THEN 1 ELSE 0 END "
        f"WHEN {fin} AND delete_at_height < {due} THEN 2 WHEN {fin} THEN 3 WHEN delete_at_height <> 0 THEN 4 WHEN {every} <> {last} THEN 5 ELSE 0 END"
    )
    return f"""SELECT * REPLACE (
      CASE rule WHEN 1 THEN {due} WHEN 2 THEN {due} WHEN 4 THEN 0 ELSE delete_at_height END AS delete_at_height,
      CASE WHEN rule IN (2, 3) OR rule = 5 AND every THEN flags | 16 WHEN rule IN (4, 5) THEN flags & ~16 ELSE flags END AS flags),
      CASE WHEN rule IN (1, 2) AND ext THEN 3 WHEN rule = 4 AND ext THEN 4 WHEN rule = 5 THEN CASE WHEN every THEN 1 ELSE 2 END ELSE 0 END AS signal{extra}
    FROM (SELECT *, {rule} AS rule, {every} AS every, {ext} AS ext FROM {source})"""
