from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.functions import geo
from corpusloom.operators import hits as H
from corpusloom.operators import profiles as P
from corpusloom.operators import sessions as S
from corpusloom.plans import query as q
from corpusloom.sources import merging
from corpusloom.sources.index import build, combined
from corpusloom.sources.store import DocumentStore


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, f"red blue{' red' * (i % 3)}", i * 10) for i in range(12)] + [(None, "red", 1)], "doc_id long, text string, n int")
    return build(docs, {"text": ("text", an.standard)})


def test_pins_and_priorities(index):
    rules = [P.Rule("low", 1, pins={3: 1, 4: 2}), P.Rule("high", 2, pins={5: 1}), P.Rule("later", starts=datetime(2999, 1, 1), only=q.Term("text", "none")), P.Rule("tagged", tags=frozenset("x"), only=q.Term("text", "none"))]
    ranked = P.rank(index, q.Term("text", "red"), P.Profile("p", "1"), 4, rules)
    got = {r["rank"]: r.doc_id for r in ranked.collect()}
    assert got[1] == 5 and got[2] == 4 and set(got) == {1, 2, 3, 4}
    assert P.rank(index, q.Term("text", "red"), P.Profile("p", "1"), 4, rules, tags=frozenset("x")).count() == 0


def test_a_stage_leaves_what_is_beyond_its_budget_behind(index):
    plain = [r.doc_id for r in P.rank(index, q.Term("text", "red"), P.Profile("p", "1"), 12).orderBy("rank").collect()]
    stage = P.Profile("p", "1", (P.Function("n", lambda: -F.col("doc.n"), "order", 3),))
    got = [r.doc_id for r in P.rank(index, q.Term("text", "red"), stage, 12).orderBy("rank").collect()]
    assert got == sorted(plain[:3]) + plain[3:]


def test_fingerprints_are_values():
    make = lambda n: q.Where(lambda c: c("n") > n)
    assert H.fingerprint(make(1)) == H.fingerprint(make(1)) != H.fingerprint(make(2))
    assert H.fingerprint(P.Profile("a", "1")) != H.fingerprint(P.Profile("a", "2"))


def test_session_pages_and_cache(index):
    session = S.Session(index, q.Term("text", "red"), [("n", False)], b"k")
    seen, cursor = [], None
    while True:
        page, cursor = session.page(5, cursor)
        seen += [r.doc_id for r in page.collect()]
        if cursor is None:
            break
    assert seen == list(range(12))
    _, cursor = session.page(5)
    with pytest.raises(ValueError):
        S.Session(index, q.Term("text", "blue"), [("n", False)], b"k").page(5, cursor)
    with pytest.raises(ValueError):
        S.Session(index, q.Term("text", "red"), [("n", False)], b"other").page(5, cursor)
    cache = S.ResultCache(index, 1)
    assert cache.top(q.Term("text", "red"), 2) == cache.top(q.Term("text", "red"), 2) and (cache.hits, cache.misses) == (1, 1)
    assert S.limited(q.search(index, q.Term("text", "none")), 3).count() == 0
    assert len(list(S.streamed(q.search(index, q.Term("text", "red"))))) == 12


def test_indexes_with_clashing_ids(spark, index):
    both = combined([index, index])
    hits = q.search(both, q.Term("text", "red"))
    assert hits.count() == 24 and hits.select("doc_id").distinct().count() == 24
    rows = hits.join(both.docs, "doc_id").groupBy("index_no").agg(F.count("*").alias("n"), F.max("local_id").alias("top")).orderBy("index_no").collect()
    assert [tuple(r) for r in rows] == [(0, 12, 11), (1, 12, 11)]


def test_merge_policies(spark, tmp_path):
    sizes = [(str(i), b) for i, b in enumerate([100, 110, 90, 5000, 95, 100])]
    assert merging.never(sizes) == [] and merging.tiered(7, 3)(sizes) == []
    assert merging.tiered(3, 3, floor_bytes=1)(sizes) == [["4", "0", "5"]]
    assert merging.tiered(3, 3, floor_bytes=1, most_bytes=10)(sizes) == []
    assert merging.log_bytes(3, least_bytes=1)([("a", 100), ("b", 100), ("c", 100), ("d", 9000), ("e", 100)]) == [["a", "b", "c"]]
    store = DocumentStore(spark, str(tmp_path / "s"))
    for i in range(4):
        store.append(spark.createDataFrame([(i, "x"), (i + 10, "y")], "doc_id long, t string"))
    store.delete(spark.createDataFrame([(0,)], "doc_id long"))
    store.append(spark.createDataFrame([(0, "back")], "doc_id long, t string"))
    store.merge(merging.log_bytes(2))
    assert sorted(tuple(r) for r in store.read().collect()) == [(0, "back"), (1, "x"), (2, "x"), (3, "x"), (10, "y"), (11, "y"), (12, "y"), (13, "y")]
    assert len(store.manifest()["data"]) == 3


def test_coordinates(spark):
    df = spark.createDataFrame([(-90.0, -180.0), (0.0, 0.0), (90.0, 180.0), (91.0, None)], "lat double, lon double")
    rows = df.select(geo.encode_latitude(F.col("lat")), geo.encode_longitude(F.col("lon"))).collect()
    assert [tuple(r) for r in rows] == [(-(2**31), -(2**31)), (-1, -1), (2**31 - 1, 2**31 - 1), (None, None)]
