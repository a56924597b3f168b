"""Batches against an independent sequential model, and lifecycle scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codes as C
from ledgerloom.functions.scalars import fingerprint, generation_ahead, log2_bucket, shard_of
from ledgerloom.operators import inventory, pruner, records, slots
from ledgerloom.operators.state import BLOCK, CHILDREN, TX, UTXO, Heights, State
from ledgerloom.sources import payloads, snapshot
from ledgerloom.streaming.op_stream import apply_one

E = C.ERRORS


def b32(n):
    return bytes([n % 256, n // 256 % 256]) + bytes(30)


def tx_row(n, **v):
    base = dict(tx_version=1, locktime=0, fee=500, size_in_bytes=250, flags=0, spending_height=0, created_at=0, utxo_count=2, spent_utxos=0, pruned_utxos=0, generation=0,
                updated_at=0, reassignment_count=0, unmined_since=0, delete_at_height=0, preserve_until=0)
    return (b32(n), *{**base, **v}.values())


def make(spark, tx, utxo, block=(), children=()):
    return State(spark.createDataFrame(tx, TX), spark.createDataFrame(utxo, UTXO), spark.createDataFrame(list(block), BLOCK), spark.createDataFrame(list(children), CHILDREN))


def slot(n, vout, status=0, spender=None, vin=None, cooldown=0):
    return (b32(n), vout, b32(1000 + n * 10 + vout), status, spender, vin, cooldown)


ITEM = "txid binary, vout bigint, hash binary, seq bigint, spender binary, vin bigint, new_hash binary, reserved boolean"


def test_spend_against_sequential_model(spark):
    rnd = random.Random(5)
    tx, utxo, blocks = [], [], []
    state = {}
    for n in range(40):
        flags = rnd.choice([0, 0, 0, C.CONFLICTING, C.LOCKED])
        height = rnd.choice([0, 0, 2100, 1900])
        mined = rnd.random() < 0.4
        tx.append(tx_row(n, flags=flags, spending_height=height, utxo_count=3))
        if mined:
            blocks.append((b32(n), 7, 1500, 0))
        for v in range(3):
            status = rnd.choice([0, 0, 0, 1, 2, 255])
            held = b32(900 + rnd.randrange(2)) if status in (1, 2) else None
            cool = rnd.choice([0, 0, 2000, 2001]) if status == 0 else 0
            utxo.append(slot(n, v, status, held, 0 if held else None, cool))
            state[n, v] = [status, held, cool]
        state[n] = (flags, height, mined)
    items = []
    for i in range(600):
        n, v = rnd.randrange(42), rnd.randrange(4)
        h = b32(1000 + n * 10 + v) if rnd.random() < 0.8 else b32(5)
        items.append((b32(n), v, h, i, b32(900 + rnd.randrange(2)), 0, b32(0), rnd.random() < 0.05))
    want = []
    for t, v, h, i, sp, vin, _, reserved in items:
        n = t[0] + 256 * t[1]
        if reserved:
            code = 6
        elif n not in state:
            code = 1
        else:
            flags, height, mined = state[n]
            if flags & C.CONFLICTING:
                code = 8
            elif flags & C.LOCKED and not mined:
                code = 9
            elif height > 2000:
                code = 10
            elif v >= 3:
                code = 11
            elif h != b32(1000 + n * 10 + v):
                code = 2
            else:
                s = state[n, v]
                if s[0] == 0 and s[2] > 2000:
                    code = 13
                elif s[0] == 0:
                    s[0], s[1], code = 1, sp, 0
                elif s[0] == 1:
                    code = 0 if s[1] == sp else 3
                else:
                    code = 7 if s[0] == 255 else 6
        want.append((i, code))
    r = slots.spend(make(spark, tx, utxo, blocks), spark.createDataFrame(items, ITEM), Heights(2000))
    assert sorted((x["seq"], x["code"]) for x in r.items.collect()) == want
    after = {(x["txid"][0], x["vout"]): x["status"] for x in r.state.utxo.collect()}
    assert after == {(k[0], k[1]): v[0] for k, v in state.items() if isinstance(k, tuple)}
    assert r.state.tx.agg(F.sum("spent_utxos")).first()[0] == len([1 for k, v in state.items() if isinstance(k, tuple) and v[0] == 1]) - sum(u[3] == 1 for u in utxo)


def test_freeze_reassign_spend(spark):
    st = make(spark, [tx_row(1)], [slot(1, 0), slot(1, 1)])
    item = lambda h, sp=9: spark.createDataFrame([(b32(1), 0, h, 1, b32(sp), 0, b32(77), False)], ITEM)
    old, new = b32(1010), b32(77)
    one = lambda r: r.items.first()["code"]
    r = slots.freeze(st, item(old))
    assert one(r) == 0 and one(slots.freeze(r.state, item(old))) == E["ALREADY_FROZEN"]
    assert one(slots.spend(r.state, item(old), Heights(1000))) == E["FROZEN"]
    r = slots.reassign(r.state, item(old), 1000, 100)
    assert one(r) == 0 and r.audit.count() == 1
    assert one(slots.spend(r.state, item(old), Heights(1101))) == E["UTXO_HASH_MISMATCH"]
    assert one(slots.spend(r.state, item(new), Heights(1099))) == E["FROZEN_UNTIL"]
    assert one(slots.spend(r.state, item(new), Heights(1100))) == 0
    assert one(slots.reassign(r.state, item(new), C.U32_MAX, 1)) == E["STORAGE_IO"]


def test_deleted_child_spends_again(spark):
    st = make(spark, [tx_row(1), tx_row(9, utxo_count=1)], [slot(1, 0), slot(1, 1), slot(9, 0)])
    item = spark.createDataFrame([(b32(1), 0, b32(1010), 1, b32(9), 0, b32(0), False)], ITEM)
    spent = slots.spend(st, item, Heights(2000)).state
    r = records.delete(spent.but(tx=spent.tx.drop("signal", "overflow")), spark.createDataFrame([(b32(9), 1)], "txid binary, seq bigint"))
    again = slots.spend(r.state, item, Heights(2000)).items.first()
    assert again["code"] == E["INVALID_SPEND"] and again["by_spender"] == b32(9)
    t = r.state.tx.where(F.col("txid") == F.lit(b32(1))).first()
    assert (t["spent_utxos"], t["pruned_utxos"]) == (0, 1)


def test_reorg(spark):
    st = make(spark, [tx_row(1, unmined_since=900)], [slot(1, 0), slot(1, 1)])
    named = spark.createDataFrame([(b32(1), 1)], "txid binary, seq bigint")
    mined = records.set_mined(st, named, 100, 1000, Heights(1000)).state
    assert mined.tx.first()["unmined_since"] == 0 and mined.block.count() == 1
    back = records.unset_mined(mined.but(tx=mined.tx.select(*st.tx.columns)), named, 100, Heights(1001)).state
    assert back.tx.first()["unmined_since"] == 1001 and back.block.count() == 0


def test_preserve_blocks_deletion_until_it_expires(spark):
    st = make(spark, [tx_row(1, spent_utxos=2, preserve_until=5000)], [slot(1, 0, 1, b32(9), 0), slot(1, 1, 1, b32(9), 1)], [(b32(1), 7, 1000, 0)])
    assert pruner.sweep(st, 4000).items.count() == 0
    r = pruner.process_expired(st, 5000)
    assert r.items.count() == 0 and r.state.tx.first()["delete_at_height"] == 5288
    assert pruner.sweep(r.state, 5288).state.tx.count() == 0


def test_empty_state(spark):
    st = State.empty(spark)
    items = spark.createDataFrame([(b32(1), 0, b32(2), 1, b32(3), 0, b32(4), False)], ITEM)
    assert slots.spend(st, items, Heights(1)).items.first()["code"] == E["TX_NOT_FOUND"]
    assert inventory.slot_inventory(st).first()["total"] == 0
    assert inventory.status_report(st).first()["dead_permille"] == 0
    assert records.set_mined(st, items.select("txid", "seq"), 1, 1, Heights(1)).state.tx.count() == 0


def test_golden_values(spark):
    df = spark.createDataFrame([(bytes.fromhex("abcd") + bytes(30),)], "txid binary")
    assert df.select(shard_of("txid"), fingerprint("txid")).first() == (3499, 0xCDAB)
    n = spark.createDataFrame([(x,) for x in (0, 1, 127, 128, 255, 256, 1 << 40)], "ns bigint").select(log2_bucket(F.col("ns")).alias("b"))
    assert [r["b"] for r in n.collect()] == [0, 0, 0, 0, 0, 1, 24]
    g = spark.createDataFrame([(5, 4), (4, 5), (0, C.U32_MAX), (4, 4)], "a bigint, b bigint").select(generation_ahead(F.col("a"), F.col("b")).alias("g"))
    assert [r["g"] for r in g.collect()] == [True, False, True, False]


@pytest.mark.parametrize("op, start, want", [("spend", (0, -1), "ok"), ("spend", (1, 2), "same"), ("spend", (1, 3), "failed"), ("unspend", (1, 2), "ok"), ("freeze", (1, 2), "failed"), ("unfreeze", (255, -1), "ok")])
def test_stream_machine(op, start, want):
    assert apply_one(*start, op, 2)[2] == want


def test_damaged_backup_is_refused(spark, tmp_path):
    st = make(spark, [tx_row(n) for n in range(1, 6)], [slot(n, v) for n in range(1, 6) for v in (0, 1)])
    version = snapshot.write(st, str(tmp_path))
    assert snapshot.restore(spark, str(tmp_path)).utxo.count() == 10
    other = spark.createDataFrame([slot(n, v, status=int(n == 3)) for n in range(1, 6) for v in (0, 1)], UTXO)
    other.write.mode("overwrite").parquet(f"{tmp_path}/{version}/utxo")
    assert {r["table"]: r["intact"] for r in snapshot.verify(spark, str(tmp_path)).collect()}["utxo"] is False
    with pytest.raises(ValueError):
        snapshot.restore(spark, str(tmp_path), version)


def test_malformed_payloads(spark):
    items = spark.createDataFrame([(0, i, b32(i), i, b32(9)) for i in range(3)], "batch int, seq int, txid binary, vout bigint, hash binary")
    good = payloads.encode(items, "slots", "batch", "seq").first()["payload"]
    cases = [bytes(good), bytes(good) + b"more", bytes(good)[:-1], b"", b"\x01", (9000).to_bytes(4, "little") + bytes(9000 * 68), (0).to_bytes(4, "little"), None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p binary").select("i", payloads.decode(F.col("p"), "slots").alias("d"))
    got = [(r["d"]["code"], len(r["d"]["items"])) for r in df.orderBy("i").collect()]
    bad = (E["PAYLOAD_MALFORMED"], 0)
    assert got == [(0, 3), (0, 3), bad, bad, bad, bad, (0, 0), bad]
    first = df.first()["d"]["items"][2]
    assert (bytes(first["txid"]), first["vout"], bytes(first["hash"])) == (b32(2), 2, b32(9))


def test_children_beyond_a_full_list(spark):
    st = make(spark, [tx_row(1)], [slot(1, 0), slot(1, 1)], children=[(b32(1), b32(1000 + i), "conflicting") for i in range(250)])
    pairs = spark.createDataFrame([(b32(1), b32(3000 - i), i) for i in range(20)] + [(b32(1), b32(1000), 99), (b32(2), b32(5), 1)], "parent binary, child binary, seq bigint")
    r = records.append_children(st, pairs, "conflicting")
    assert [tuple(x)[1:] for x in r.items.collect()] == [(5, 15)] and r.state.children.count() == 255
    new = {bytes(x["child"]) for x in r.state.children.collect()} - {b32(1000 + i) for i in range(250)}
    assert new == {b32(3000 - i) for i in range(5)}


def test_effective_changes_are_stamped(spark):
    st = make(spark, [tx_row(1, updated_at=7), tx_row(2, updated_at=7)], [slot(1, 0), slot(1, 1), slot(2, 0), slot(2, 1)])
    item = spark.createDataFrame([(b32(1), 0, b32(1010), 1, b32(9), 0, b32(0), False)], ITEM)
    r = slots.spend(st, item, Heights(2000), now_ms=50)
    assert {x["txid"][0]: (x["generation"], x["updated_at"]) for x in r.state.tx.collect()} == {1: (1, 50), 2: (0, 7)}
    again = slots.spend(r.state.but(tx=r.state.tx.select(*st.tx.columns)), item, Heights(2000), now_ms=60)
    assert again.items.first()["idempotent"] and {x["txid"][0]: x["updated_at"] for x in again.state.tx.collect()} == {1: 50, 2: 7}
