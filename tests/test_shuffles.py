"""What the plans of batches shuffle, and how many parts a snapshot has: figures that must not outgrow the tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.state import State
from ledgerloom.plans.catalog import ORACLES, QUERIES
from ledgerloom.sources import projection as P
from ledgerloom.sources import snapshot
from test_queries import TABLES, rows

DATA = "/root/testdata/sf0.001"
OFF = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}

#: Shuffles that the planner adds for itself, by query: sums and counts at the end, and the few rows that a batch changes.
ADDED = {
    "outcome_counters": (2, 1),
    "spend_outcome_matrix": (2, 1),
    "spend_batch_state": (0, 1),
    "unspend_batch_state": (0, 1),
    "spend_batch_outcomes": (0, 1),
    "spend_ignoring_gates": (0, 1),
    "unspend_batch_outcomes": (0, 1),
    "reassign_state": (0, 1),
    "reassign_batch_outcomes": (0, 1),
    "reassign_audit": (0, 1),
    "create_conflicting_children": (2, 0),
    "create_batch_state": (0, 0),
    "append_children_full": (3, 1),
}


def exchanges(spark, name):
    """(shuffles that the planner adds, shuffles of whole lines) of a query; a reused one is not counted."""
    old = {k: spark.conf.get(k) for k in OFF}
    try:
        for k, v in OFF.items():
            spark.conf.set(k, v)
        tree = [QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan()]
        added = whole = 0
        while tree:
            p = tree.pop()
            kids = [p.children().apply(i) for i in range(p.children().size())]
            if p.nodeName() == "Exchange" and "ENSURE_REQUIREMENTS" in p.simpleString(1000):
                added += 1
            if p.nodeName() == "Exchange" and "l_orderkey" in p.simpleString(1000) and p.output().size() > 10:
                whole += 1
            tree += kids
        return added, whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ADDED)
def test_batches_keep_the_records_partitioning(spark, name):
    added, whole = exchanges(spark, name)
    assert (added, whole) == ADDED[name]


def test_parts_follow_the_size_of_the_input(spark, monkeypatch, tmp_path):
    whole = P.state(spark, DATA)
    st = State(*[getattr(whole, n).limit(50) if n != "utxo" else whole.utxo for n in snapshot.TABLES])
    assert snapshot.parts_of(st.utxo) == snapshot.LEAST_PARTS
    monkeypatch.setattr(snapshot, "PART_BYTES", 10_000)
    parts = snapshot.parts_of(st.utxo)
    assert parts > snapshot.LEAST_PARTS
    version = snapshot.write(st, str(tmp_path))
    assert len(list((tmp_path / version / "utxo").glob("part-*.parquet"))) == parts
    assert snapshot.read(spark, str(tmp_path)).utxo.agg(F.count(F.lit(1))).first()[0] == whole.utxo.count()
    assert snapshot.verify(spark, str(tmp_path)).where("NOT intact").count() == 0


#: Queries whose rows are laid by id in parts of a bounded size.
LAID = ("spend_outcome_matrix", "spend_batch_state", "unspend_batch_state", "create_batch_state", "reassign_state", "spend_batch_outcomes", "spend_ignoring_gates", "unspend_batch_outcomes", "reassign_batch_outcomes", "reassign_audit")


@pytest.mark.parametrize("name", LAID)
def test_parts_laid_by_id_follow_the_size_of_the_input(spark, monkeypatch, name):
    assert P.parts_of(spark, DATA) is None
    monkeypatch.setattr(P, "PART_BYTES", 10_000)
    parts = P.parts_of(spark, DATA)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    laid = plan.count("REPARTITION_BY_NUM")
    assert laid and laid == plan.count(f", {parts}), REPARTITION_BY_NUM") and "REPARTITION_BY_COL" not in plan
    assert exchanges(spark, name) == ADDED[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    out = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in out.description], out.fetchall())


#: Queries whose files are read in splits of a bounded size where their rows are laid in many parts.
SPLIT = ("spend_batch_state", "spend_batch_outcomes", "spend_ignoring_gates", "reassign_batch_outcomes", "reassign_audit", "create_batch_state", "reassign_state", "unspend_batch_state", "unspend_batch_outcomes")


@pytest.fixture
def splits(spark, monkeypatch):
    old = spark.conf.get(P.SPLIT_SETTING)
    monkeypatch.setattr(P, "SPLIT_BYTES", 10_000)
    yield old
    spark.conf.set(P.SPLIT_SETTING, old)


@pytest.mark.parametrize("name", SPLIT)
def test_splits_read_for_many_parts_are_bounded(spark, monkeypatch, splits, name):
    monkeypatch.setattr(P, "PART_BYTES", 10_000)
    plan, found = [QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan()], set()
    while plan:
        p = plan.pop()
        plan += [p.children().apply(i) for i in range(p.children().size())]
        if p.nodeName().startswith("Scan parquet") and "l_orderkey" in p.simpleString(1000):
            found.add(p.inputRDD().getNumPartitions())
    assert found == {-(-os.path.getsize(f"{DATA}/lineitem.parquet") // 10_000)}


def test_splits_are_only_made_smaller_and_only_for_many_parts(spark, monkeypatch, splits):
    assert P.parts_of(spark, DATA) is None and spark.conf.get(P.SPLIT_SETTING) == splits
    monkeypatch.setattr(P, "PART_BYTES", 10_000)
    spark.conf.set(P.SPLIT_SETTING, "5000")
    assert P.parts_of(spark, DATA) and spark.conf.get(P.SPLIT_SETTING) == "5000"


#: Queries whose rows are laid by id in parts of a bounded number of rows, however few bytes the files have.
COUNTED = ("unspend_batch_state", "spend_batch_outcomes", "create_batch_state", "unspend_batch_outcomes", "reassign_state", "spend_ignoring_gates", "reassign_batch_outcomes", "reassign_audit")


@pytest.mark.parametrize("name", COUNTED)
def test_parts_laid_by_id_follow_the_rows_of_files_that_compress_well(spark, monkeypatch, splits, name):
    monkeypatch.setattr(P, "PART_ROWS", 1000, raising=False)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    n = con.execute("select (select count(*) from orders) + (select count(*) from lineitem)").fetchone()[0]
    parts = -(-n // 1000)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and os.path.getsize(f"{DATA}/lineitem.parquet") < P.PART_BYTES
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    laid = plan.count("REPARTITION_BY_NUM")
    assert laid and laid == plan.count(f", {parts}), REPARTITION_BY_NUM") and "REPARTITION_BY_COL" not in plan
    assert exchanges(spark, name) == ADDED[name]
    out = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in out.description], out.fetchall())


def test_splits_read_for_many_parts_are_bounded_in_rows(spark, monkeypatch, splits):
    monkeypatch.setattr(P, "PART_ROWS", 1000, raising=False)
    monkeypatch.setattr(P, "SPLIT_ROWS", 100, raising=False)
    P.parts_of(spark, DATA)
    size = sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem"))
    n = sum(P.read(spark, DATA, t).count() for t in ("orders", "lineitem"))
    assert int(spark.conf.get(P.SPLIT_SETTING)) == size * 100 // n < 10_000
