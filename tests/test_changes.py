import json

import pytest

from corpusloom.operators import changes, delivery

OPS = "delivery_id long, request_id string, op_ordinal int, op_kind string, document_id string, document_json string, idempotency_key string, sequence_number long, delivered_at timestamp, index_name string"
REQ = "request_id string, index_name string, idempotency_key string, wants_refresh boolean, document_id string"


def op(n, kind="Index", doc="d", payload="{}", key=None, seq=None, req="r", ordinal=0):
    return (n, req, ordinal, kind, doc, payload, key, seq, None, "clashing name")


@pytest.fixture
def make(spark):
    def frames(ops, reqs=(("r", "i", None, None, "clash"),)):
        return spark.createDataFrame(list(ops), OPS), spark.createDataFrame(list(reqs), REQ)

    return frames


def test_last_change_wins_whatever_the_arrival(make, rows):
    ops = [op(1, seq=30, kind="UPDATE"), op(2, seq=10), op(3, seq=20, kind="delete", payload=None), op(4, doc="gone", seq=1), op(5, doc="gone", seq=2, kind="Delete", payload=None)]
    assert rows(changes.replay(*make(ops))) == [("i", "d", 30)]


@pytest.mark.parametrize("payload", [None, "", "null", "[]", '"x"', '{"a":', '{"a":1} {"b":2}', "{'a':1}", '{"a":NaN}', "{}x"])
def test_incomplete_payload_changes_nothing(make, rows, payload):
    ops = [op(1, seq=10), op(2, seq=20, payload=payload), op(3, doc="never", seq=5, payload=payload)]
    assert rows(changes.replay(*make(ops))) == [("i", "d", 10)]


def test_copies_count_once_with_their_lowest_number(make, rows):
    ops = [op(1, seq=10, key=" K1"), op(2, seq=20, kind="delete", payload=None), op(3, seq=30, key="k1 "), op(4, seq=None, key="k1")]
    assert rows(changes.replay(*make(ops))) == []


def test_missing_numbers_kinds_documents_and_requests(make, rows):
    ops = [op(1, seq=None), op(2, kind="Upsert", seq=1), op(3, kind=None, seq=2), op(4, doc=None, seq=3), op(5, req="unknown", seq=4), op(6, req=None, seq=5)]
    assert rows(changes.replay(*make(ops))) == []


def test_empty_tables(make, rows):
    assert rows(changes.replay(*make([], []))) == []
    assert rows(delivery.dropped_copies(*make([], []))) == []


def test_watermark_holds_at_the_first_gap(spark, rows):
    numbers = spark.createDataFrame([("a", n) for n in (2, 4, 6, 10, 12)] + [("b", n) for n in (1, 2, 3)] + [("c", None)], "k string, n long")
    assert rows(changes.contiguous_watermark(numbers, ["k"], "n", step=2, block=4)) == [("a", 6), ("b", 3)]


def test_open_log_holds_changes_behind_a_gap_and_incomplete_transactions(make, rows):
    ops = [op(1, doc="x", seq=2, req="r", ordinal=0), op(2, doc="y", seq=4, req="r", ordinal=1), op(3, doc="z", seq=20, req="s", ordinal=0)]
    reqs = [("r", "i", None, None, ""), ("s", "i", None, None, "")]
    assert rows(changes.replay(*make(ops, reqs), closed=False)) == [("i", "x", 2), ("i", "y", 4)]
    late = [*ops[:1], op(2, doc="y", seq=6, req="r", ordinal=2)]  # ordinal 1 hasn't arrived
    assert rows(changes.replay(*make(late, reqs), closed=False, step=4)) == []


def test_one_log_over_all_indexes(make, rows):
    reqs = [(r, i, None, None, "") for r, i in (("r", "i"), ("s", "j"), ("t", "i"), ("u", "j"))]
    ops = [op(1, doc="a", seq=2), op(2, doc="b", seq=4, req="s"), op(3, doc="c", seq=None, req="s", ordinal=1), op(4, doc="d", seq=8, req="s", ordinal=2), op(5, doc="e", seq=10, req="t")]
    # 6 was the place of an operation without a number, so nothing is outstanding below 10
    assert rows(changes.replay(*make(ops, reqs), closed=False)) == [("i", "a", 2), ("i", "e", 10), ("j", "b", 4), ("j", "d", 8)]
    more = [*ops, op(6, doc="f", seq=14, req="u"), op(7, doc="a", kind="delete", payload=None, seq=16, req="t", ordinal=1)]  # nothing accounts for 12
    assert rows(changes.replay(*make(more, reqs), closed=False)) == rows(changes.replay(*make(ops, reqs), closed=False))
    assert rows(changes.log_watermark(make(more, reqs)[0], closed=False)) == [(10,)]
    assert rows(changes.log_watermark(make(more, reqs)[0], closed=True)) == [(16,)]


def test_end_record_settles_gaps_up_to_its_number_only(spark, rows):
    numbers = spark.createDataFrame([(n,) for n in (2, 4, 20, 22, 40, 42)], "n long")
    mark = lambda end, block=1 << 20: rows(changes.contiguous_watermark(numbers, [], "n", 2, block, end=spark.createDataFrame([(end,)], "settled long")))
    want = {None: 4, 1: 4, 10: 10, 18: 22, 20: 22, 22: 22, 30: 30, 38: 42, 42: 42}
    assert {end: mark(end)[0][0] for end in want} == want
    assert {end: mark(end, 8)[0][0] for end in want} == want


def test_closed_log_takes_the_steps_of_the_open_one(make, rows, monkeypatch):
    reqs = [("r", "i", None, None, ""), ("s", "i", None, None, "")]
    ops = [op(1, doc="x", seq=2), op(2, doc="y", seq=6, ordinal=2), op(3, doc="z", seq=20, req="s")]  # ordinal 1 is missing, and 8 to 18
    made = make(ops, reqs)
    assert rows(changes.replay(*made, closed=False)) == []
    assert rows(changes.replay(*made)) == [("i", "x", 2), ("i", "y", 6), ("i", "z", 20)]
    # without its end record, gaps and incomplete transactions hold the closed log as they do the open one
    with monkeypatch.context() as m:
        m.setattr(changes, "end_record", lambda ops: ops.selectExpr("cast(null as long) as settled").limit(1), raising=False)
        assert rows(changes.replay(*made)) == []
    # a record of an earlier end settles the transaction below it; the gap behind it holds
    with monkeypatch.context() as m:
        m.setattr(changes, "end_record", lambda ops: ops.selectExpr("6L as settled").limit(1), raising=False)
        assert rows(changes.replay(*made)) == [("i", "x", 2), ("i", "y", 6)]


def test_copies_above_the_watermark_wait(make, rows):
    ops = [op(1, seq=2), op(2, doc="x", seq=4, ordinal=1, payload="{", key="k"), op(3, doc="x", seq=90, ordinal=1, key="k")]
    assert rows(changes.replay(*make(ops), closed=False)) == [("i", "d", 2)]
    assert rows(changes.replay(*make(ops))) == [("i", "d", 2), ("i", "x", 4)]


def test_repeated_requests_count_once(make, rows):
    reqs = [("r", "i", "K", None, "")] * 3 + [("q", "i", None, None, "")]
    ops = [op(n, key=k, req=r) for n, k, r in ((3, None, "r"), (1, " k", "q"), (2, "  ", "r"), (4, None, "q"))]
    assert rows(delivery.dropped_copies(*make(ops, reqs))) == [(2,), (3,)]


def test_batches_of_any_cut_give_the_same_winners(make, rows):
    ops = [op(n, doc=f"d{n % 7}", key=f"k{n % 5}") for n in range(1, 120)]
    want = sorted((n,) for n in range(36, 120))
    for share in (0.0, 0.3, 0.9, 1.0):
        assert sorted(rows(delivery.dropped_copies(*make(ops), history_share=share, rows_per_partition=10))) == want


def test_only_affected_partitions_are_overwritten(make, spark, tmp_path, rows):
    ids = delivery.delivery_identities(*make([op(n, doc=f"d{n}", key="k") for n in range(1, 41)] + [op(50, doc="d1", key="k")]))
    store = delivery.WinnerStore(spark, str(tmp_path / "w"), rows_per_partition=10)
    store.ingest(ids.where("delivery_id < 45"))
    before = store._manifest()["parts"]
    store.ingest(ids.where("delivery_id >= 45"))
    after = store._manifest()["parts"]
    assert [p for p in before if before[p] != after[p]] == ["0"]
    assert rows(store.dropped()) == [(50,)]
    store.ingest(ids.where("delivery_id >= 45"))  # the same batch again
    assert rows(store.dropped()) == [(50,)] and store.winners().count() == 40


def test_round_trip_against_a_plain_replay(make, rows):
    import random

    rng = random.Random(5)
    ops, state = [], {}
    for seq in range(1, 400):
        doc, kind = f"d{rng.randrange(12) if rng.random() < 0.7 else 0}", rng.choice(["index", "Update", "DELETE"])
        ops.append(op(seq, kind, doc, json.dumps({"n": seq}), seq=seq))
        if kind == "DELETE":
            state.pop(doc, None)
        else:
            state[doc] = seq
    rng.shuffle(ops)
    assert rows(changes.replay(*make(ops))) == sorted(("i", d, s) for d, s in state.items())


def test_only_affected_partitions_are_rewritten_and_a_crash_is_no_obstacle(spark, tmp_path, monkeypatch):
    from corpusloom.operators.delivery import WinnerStore
    from corpusloom.sources import shared

    row = lambda i, d: (i, i * 31, d)
    make = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, delivery_id long")
    store = WinnerStore(spark, str(tmp_path / "s"), rows_per_partition=10, buckets=4)
    store.ingest(make([row(i, i) for i in range(100)]))
    before = store._manifest()["parts"]
    assert len(before) == 10
    with monkeypatch.context() as m:
        m.setattr(shared, "write_text_atomically", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            store.ingest(make([row(5, 200), row(300, 201)]))
    store.ingest(make([row(5, 200), row(300, 201), row(72, 202)]))
    after = store._manifest()["parts"]
    assert {p for p in before if before[p] != after[p]} == {"0", "7"} and set(after) - set(before) == {"20"}
    assert sorted(r.delivery_id for r in store.dropped().collect()) == [200, 202]
    assert store.winners().count() == 101
    assert store.vacuum() and store.winners().count() == 101 and not store.vacuum()
