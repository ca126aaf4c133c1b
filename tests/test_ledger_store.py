"""The composed merge and the stored ledger: any order and split of captures gives one ledger, broken writes lose nothing."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerwright.operators import merge
from ledgerwright.plans import registered_merge
from ledgerwright.sources import ledger_store as store

KIND = ("account_id string, order_id string, record_id string, record_type string, batch_id long, seq long, captured_at timestamp, item_names array<string>, asins array<string>, return_urls array<string>, "
        "order_items array<string>, detail_scan_complete boolean, authoritative boolean, provisional boolean, return_token string, return_item_id string, item_identity_source string, "
        "item_asin_evidence_source string, return_stage string, status string, status_text string, refund_cents long, manual_state string")
NAMES = [c.split()[0] for c in KIND.split(", ")]


def capture(seq, **given):
    base = dict(account_id="a", order_id="o", record_id="r", record_type="return", batch_id=0, seq=seq)
    return tuple((base | given).get(c) for c in NAMES)


def one(spark, *rows):
    return merge.merge_captures(spark.createDataFrame(list(rows), KIND), versions=True).first()


def test_a_poorer_capture_takes_nothing_away(spark):
    full = dict(record_type="order", order_items=["full"], detail_scan_complete=True, item_names=["Lamp"], asins=["B1"], refund_cents=100)
    got = one(spark, capture(1, **full), capture(2, record_type="order", order_items=["part"], detail_scan_complete=False, item_names=["Desk", "LAMP"], asins=[], manual_state="reconciled"))
    assert (got.item_names, got.asins, got.order_items, got.detail_scan_complete, got.refund_cents) == (["Lamp", "Desk"], ["B1"], ["full"], True, 100)
    assert got.versions.refund_cents.seq == 1 and "manual_state" not in got.asDict()
    first = one(spark, capture(1, record_type="order", order_items=["a"]), capture(2, record_type="order", order_items=["b"]))
    assert first.order_items == ["a"]  # without complete details the first list stays


def test_identity_of_a_linked_return(spark):
    link = dict(item_identity_source="order-detail-return-link", return_item_id="i", item_names=["Lamp"], asins=["B1"])
    other = dict(return_item_id="i", item_names=["Desk"], asins=["B2"], item_identity_source="page")
    got = one(spark, capture(1, **link), capture(2, **other))
    assert (got.item_names, got.asins, got.item_identity_source, got.identity_conflict) == (["Lamp"], ["B1"], "order-detail-return-link", False)
    strong = dict(other, item_asin_evidence_source="return-item-data-asin")
    got = one(spark, capture(1, **link), capture(2, **strong))
    assert got.identity_conflict and tuple(got.identity_conflict_incoming) == (["Desk"], ["B2"], "page") and got.asins == ["B1"]
    got = one(spark, capture(1, **dict(link, asins=[])), capture(2, **strong), capture(3, **dict(other, return_item_id=None, authoritative=True, item_names=["New"])))
    assert (got.item_names, got.asins, got.identity_conflict) == (["New"], ["B2"], False)


def test_a_batch_supersedes_its_neighbours(spark):
    t = dict(return_token="t")
    rows = [capture(1, record_id="guess", provisional=True, **t), capture(2, record_id="other", provisional=True, return_token="u"),
            capture(3, record_id="sure", batch_id=1, authoritative=True, **t)]
    ids = lambda r: {x.record_id for x in merge.merge_captures(spark.createDataFrame(r, KIND)).collect()}
    assert ids(rows) == {"other", "sure"}
    assert ids([*rows, capture(4, record_id="guess", batch_id=2, provisional=True, refund_cents=1, **t)]) == {"other", "sure", "guess"}
    assert merge.merge_captures(spark.createDataFrame([], KIND)).count() == 0


def plain(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(set(df.columns) - {"last_scanned_at", "versions"})).collect())))


def test_any_order_and_split_gives_one_ledger(spark, tmp_path):
    rows = registered_merge.evidence(spark, "/root/testdata/sf0.001").withColumn("dice", F.rand(3)).cache()
    want = plain(merge.merge_captures(rows.drop("dice")))
    for turn in range(2):
        dice, path = random.Random(turn), f"{tmp_path}/led{turn}"
        cuts = sorted(dice.random() for _ in range(2))
        parts = list(enumerate(zip([0, *cuts], [*cuts, 1])))
        dice.shuffle(parts)
        for epoch, (_, (low, high)) in enumerate(parts):
            part = rows.where((F.col("dice") >= low) & (F.col("dice") < high + 0.05)).drop("dice")  # neighbours overlap: some captures come twice
            store.append_captures(part, path, epoch, buckets=3, feed=turn == 1)
            if dice.random() < 0.5:
                store.compact_ledger(spark, path)
        assert plain(store.read_ledger_store(spark, path)) == want


def test_a_batch_writes_its_captures_and_replays_change_nothing(spark, tmp_path):
    path, files = f"{tmp_path}/led", lambda: {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.parquet")}
    df = lambda rows: spark.createDataFrame(rows, KIND)
    many = [capture(1, order_id=f"o{k}", record_id=f"r{k}", return_stage="received") for k in range(40)]
    store.append_captures(df(many), path, 0, buckets=8)
    before = files()
    small = df([capture(2, order_id="o0", record_id="r0", return_stage="started", status_text="late")])
    store.append_captures(small, path, 1, buckets=99)
    assert len(files() - before) <= 1 + 4 and before <= files()  # one capture, and the changes of one order
    after = files()
    store.append_captures(small, path, 1)
    assert files() == after
    assert {r.record_id: r.return_stage for r in store.read_ledger_store(spark, path).collect()} == {f"r{k}": "received" for k in range(40)}
    changes = {(r.epoch, r.record_id): r.change for r in store.read_changes(spark, path).collect()}
    assert changes[1, "r0"] == "unchanged" and changes[0, "r5"] == "inserted" and len(changes) == 41
    store.append_captures(df([]), path, 2)
    assert store.read_ledger_store(spark, path).count() == 40 and store.read_ledger_store(spark, f"{tmp_path}/none") is None
    assert store._buckets(store.Folder(spark, path), 5) == 8


def test_broken_writes_lose_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/led"
    df = lambda seq: spark.createDataFrame([capture(seq, refund_cents=seq)], KIND)
    cents = lambda: store.read_ledger_store(spark, path).first().refund_cents
    real = store.Folder.place

    def broken(at):
        def place(self, written, *parts):
            if parts[0] == at:
                raise OSError("gone")
            real(self, written, *parts)
        return place

    store.append_captures(df(1), path, 0, buckets=2)
    for epoch, at in ((1, "deltas"), (2, "changes")):  # a batch that breaks off is run again
        monkeypatch.setattr(store.Folder, "place", broken(at))
        with pytest.raises(OSError):
            store.append_captures(df(epoch + 1), path, epoch)
        assert cents() == (epoch if at == "deltas" else epoch + 1)
        monkeypatch.setattr(store.Folder, "place", real)
        store.append_captures(df(epoch + 1), path, epoch)
        assert cents() == epoch + 1 and store.read_changes(spark, path).count() == epoch + 1
    monkeypatch.setattr(store.Folder, "place", broken("base"))
    with pytest.raises(OSError):
        store.compact_ledger(spark, path)
    assert cents() == 3
    monkeypatch.setattr(store.Folder, "place", real)
    planned = store.read_ledger_store(spark, path)
    assert store.compact_ledger(spark, path) == 2 and planned.first().refund_cents == 3  # readers of the version before can end
    store.append_captures(df(4), path, 3, feed=False)
    assert cents() == 4 and not [n for n in store.Folder(spark, path).names() if n.startswith("_")]
    assert store.compact_ledger(spark, path) == 3 and store.Folder(spark, path).numbers("deltas", "e") == [3] and cents() == 4
