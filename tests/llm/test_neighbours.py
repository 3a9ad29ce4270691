from dataclasses import replace

import numpy as np
import pytest

from corpusloom.llm import neighbours as N
from corpusloom.llm.queries import KNN

FIELDS = [("i", "v", 8), ("i", "w", 8), ("j", "v", 4), ("i", "text", None)]


@pytest.fixture
def frames(spark):
    def make(rows):
        vectors = spark.createDataFrame([(q, i, f, v, "clash") for q, i, f, v in rows], "query_id long, index_name string, field_name string, query_vector array<float>, vector_dimensions string")
        return vectors, spark.createDataFrame(FIELDS, "index_name string, field_name string, vector_dimensions int")

    return make


def _exact(rows, k, least):
    x = {q: np.array(v) / np.linalg.norm(v) for q, v in rows}
    pairs = set()
    for q in x:
        best = sorted(((-(x[q] @ x[o]), o) for o in x if o != q))[:k]
        pairs |= {(min(q, o), max(q, o)) for c, o in best if -c >= least}
    return sorted(pairs)


def _clustered(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 3, dims))
    return [(i, (rng.uniform(0.01, 100) * (centres[i % len(centres)] + 0.1 * rng.standard_normal(dims))).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"shard_values": 800}, {"leaf_rows": 20, "probes": 60}])
def test_pairs_equal_brute_force(frames, rows, options):
    data = _clustered(360)
    got = rows(N.similar_pairs(*frames([(q, "i", "v", v) for q, v in data]), N.Search(k=10, min_cosine=0.9, **options)))
    want = _exact(data, 10, 0.9)
    assert len(set(got) & set(want)) >= 0.98 * len(want) and len(got) <= len(want)


def test_recall_of_plain_neighbours(frames):
    rng = np.random.default_rng(3)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(1500)]
    got = {(r.query_id, r.neighbour_id) for r in N.links(*frames([(q, "i", "v", v) for q, v in data]), N.Search(leaf_rows=64, probes=40), "query_id % 100 = 0").collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(o)) for q in range(0, 1500, 100) for o in [o for o in np.argsort(-(x @ x[q])) if o != q][:10]}
    assert len(got) == len(want) == 150 and len(got & want) / len(want) >= 0.9


def test_recall_of_plain_neighbours_in_many_shards(frames):
    rng = np.random.default_rng(4)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(1500)]
    got = {(r.query_id, r.neighbour_id) for r in N.links(*frames([(q, "i", "v", v) for q, v in data]), replace(KNN, shard_values=800), "query_id % 100 = 0").collect()}
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(o)) for q in range(0, 1500, 100) for o in [o for o in np.argsort(-(x @ x[q])) if o != q][:10]}
    assert got == want  # a shard of a hundred vectors is one leaf, so every true neighbour is seen


def test_unusable_vectors_and_other_fields_are_no_partners(frames, rows):
    v = [1.0] * 8
    bad = [(3, "i", "v", None), (4, "i", "v", []), (5, "i", "v", [0.0] * 8), (6, "i", "v", [float("nan")] + v[1:]), (7, "i", "v", [float("inf")] + v[1:]), (8, "i", "v", v[1:]), (9, "i", "v", [None] + v[1:]), (None, "i", "v", v), (10, None, "v", v), (11, "i", "text", v), (12, "x", "v", v)]
    found = rows(N.similar_pairs(*frames([(1, "i", "v", v), (2, "i", "v", v), (13, "i", "w", v), *bad]), N.Search(min_cosine=0.9)))
    assert found == [(1, 2)]


def test_repeated_ids_and_equal_vectors(frames, rows):
    v = [1.0, 2, 3, 4, 5, 6, 7, 8]
    data = [(q, "i", "v", [x * (2.0 ** (q % 5)) for x in v]) for q in range(40)]
    found = rows(N.similar_pairs(*frames(data * 2), N.Search(k=3, min_cosine=0.9)))
    # each has the three lowest other ids as its neighbours
    assert sorted(found) == sorted({(min(a, b), max(a, b)) for a in range(40) for b in [x for x in range(40) if x != a][:3]})


def test_empty_tables(frames, rows):
    assert rows(N.similar_pairs(*frames([]), N.Search(min_cosine=0.9))) == []
    assert rows(N.similar_pairs(*frames([(1, "i", "v", [1.0] * 8)]), N.Search(min_cosine=0.9))) == []


def test_a_vector_with_half_of_all_rows_is_one_row_before_routing(frames, monkeypatch):
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(8)
    data = [(i, (hot * (1 + i % 3)).tolist() if i % 2 else rng.standard_normal(8).tolist()) for i in range(2400)]
    seen, search = [], N._search
    monkeypatch.setattr(N, "_search", lambda flat, n, s: seen.append([r["count"] for r in flat.groupBy("shard").count().collect()]) or search(flat, n, s))
    # upper levels of the routing tree from 128 rows on the driver, the lower ones from distributed quantiles
    s = N.Search(k=5, shard_values=800, sample_rows=32, driver_rows=128, routes=None)
    got = {}
    for r in N.links(*frames([(q, "i", "v", v) for q, v in data]), s, "query_id % 100 in (0, 1)").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbour_id, r.cosine))
    assert len(seen) == 1 and len(seen[0]) == 16 and max(seen[0]) < 250  # 75 of 1,201 distinct vectors, and the 13 that ask
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (*range(0, 2400, 100), *range(1, 2400, 100)):
        cosine = np.round(x @ x[q], 6)
        want = [int(o) for o in np.lexsort((np.arange(len(x)), -cosine)) if o != q][:5]
        assert [n for _, n, _ in sorted(got[q])] == want
