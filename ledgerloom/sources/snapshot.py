"""Versioned snapshots of the state as Parquet, published by a pointer that is written last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import shard_of
from ..operators.state import State

TABLES = ("tx", "utxo", "block", "children")


#: A part of a table is written for so many bytes of the files that the table comes from, and so many parts at least.
PART_BYTES, LEAST_PARTS = 32 << 20, 8


def parts_of(df: DataFrame) -> int:
    """Parts for a table by the size of its input files, so that what a task reads does not grow with the input."""
    spark, size = df.sparkSession, 0
    conf = spark._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
    return max(LEAST_PARTS, -(-size // PART_BYTES))


def _keyed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """Rows of one record lie together and in order, so that id filters prune row groups."""
    key = "parent" if name == "children" else "txid"
    return df.repartitionByRange(parts, shard_of(key), F.col(key)).sortWithinPartitions(key)


def digests(state: State) -> DataFrame:
    """table, shard, rows and digest of every table's rows, whatever their order; counts and XORs are combined map-side."""
    out = None
    for name in TABLES:
        df = getattr(state, name)
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("binary") if t == "string" else F.col(c).cast("string"), F.lit("\x00null")) for c, t in df.dtypes])
        one = df.groupBy(shard_of("parent" if name == "children" else "txid").alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("digest"))
        one = one.select(F.lit(name).alias("table"), "shard", "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def write(state: State, folder: str, parts: int | None = None) -> str:
    """Writes a version with its manifest and points to it; readers see the old or the new one, never a part."""
    version = uuid.uuid4().hex
    for name in TABLES:
        df = getattr(state, name)
        _keyed(df, name, parts or parts_of(df)).write.parquet(f"{folder}/{version}/{name}")
    spark = state.tx.sparkSession
    digests(_open(spark, folder, version)).coalesce(1).write.parquet(f"{folder}/{version}/manifest")
    at = F.lit(version).alias("version"), F.current_timestamp().alias("written")
    spark.range(1).select(*at).coalesce(1).write.mode("append").parquet(f"{folder}/pointer")
    return version


def _open(spark: SparkSession, folder: str, version: str) -> State:
    return State(*[spark.read.parquet(f"{folder}/{version}/{name}") for name in TABLES])


def newest(spark: SparkSession, folder: str) -> str:
    return spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("written")).first()["version"]


def read(spark: SparkSession, folder: str, version: str | None = None) -> State:
    """The newest version, or the one named."""
    return _open(spark, folder, version or newest(spark, folder))


def verify(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """table, rows and intact: whether every shard of a version's tables is what its manifest says."""
    version = version or newest(spark, folder)
    said = spark.read.parquet(f"{folder}/{version}/manifest").withColumnsRenamed({"rows": "said_rows", "digest": "said_digest"})
    found = digests(_open(spark, folder, version)).join(said, ["table", "shard"], "full_outer")
    same = F.col("rows").eqNullSafe(F.col("said_rows")) & F.col("digest").eqNullSafe(F.col("said_digest"))
    return found.groupBy("table").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.bool_and(same).alias("intact"))


def restore(spark: SparkSession, folder: str, version: str | None = None) -> State:
    """A version whose tables agree with its manifest; anything else is an error."""
    version = version or newest(spark, folder)
    wrong = [r["table"] for r in verify(spark, folder, version).where("NOT intact").collect()]  # at most the four tables
    if wrong:
        raise ValueError(f"version {version} is damaged: {', '.join(sorted(wrong))}")
    return _open(spark, folder, version)
