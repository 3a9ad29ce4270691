import pytest

from corpusloom.llm import ranking as R

FEATURES = "request_identity string, document_identity string, feature_name string, feature_value double, used_for_scoring boolean, relevance string"


@pytest.fixture
def scores(spark):
    def make(features, selections=(), catalogue=(("up", True), ("down", False))):
        f = spark.createDataFrame([(r, d, n, v, u, "clash") for r, d, n, v, u in features], FEATURES)
        s = spark.createDataFrame([(r, d, v) for r, d, v in selections], "request_identity string, document_identity string, relevance float")
        return R.candidate_scores(f, s, spark.createDataFrame(list(catalogue), "feature_name string, higher_is_better boolean"))

    return make


def _order(df):
    return [r.document_identity for r in df.orderBy("request_identity", "rank").collect()]


def test_range_doesn_t_count(scores):
    # b is best in two of three scores, a only in the one with the largest range
    f = [("r", d, n, float(v), True) for d, vs in {"a": (1e9, 0.10, 5), "b": (9e8, 0.13, 1), "c": (0, 0.11, 4)}.items() for n, v in zip(("up", "up2", "down"), vs)]
    assert _order(R.ideal_point_ranking(scores(f))) == ["b", "a", "c"]


def test_missing_unused_and_repeated(scores):
    nan = float("nan")
    f = [("r", "a", "up", 1.0, True), ("r", "b", "up", None, True), ("r", "c", "up", nan, True), ("r", "d", "up", 5.0, True), ("r", "a", "noise", 1e9, False), (None, "x", "up", 1.0, True), ("r", None, "up", 1.0, True)]
    ranked = R.ideal_point_ranking(scores(f * 2, [("r", "b", 0.9), ("r", "a", 0.1), ("r", "d", None), ("q", "only", None)]))
    assert _order(ranked.where("request_identity = 'r'")) == ["b", "d", "a", "c"]
    assert [(r.document_identity, r.closeness) for r in ranked.where("request_identity = 'q'").collect()] == [("only", 0.0)]


def test_constant_scores_tie_by_identity_and_outliers_are_clipped(scores):
    f = [("r", d, "up", 3.0, True) for d in "ba"]
    assert _order(R.ideal_point_ranking(scores(f))) == ["a", "b"]
    many = [("r", f"{i:03}", "up", float(i), True) for i in range(100)] + [("r", "999", "up", 1e12, True)]
    top = R.ideal_point_ranking(scores(many)).where("closeness > 0.9").count()
    assert top >= 10  # without winsorising the outlier would leave all others near 0


def test_first_three_and_empty(scores):
    f = [("r", f"{i}", "up", float(i), True) for i in range(9)]
    assert _order(R.first_candidates(scores(f))) == ["8", "7", "6"]
    assert R.first_candidates(scores([])).count() == 0


def test_the_length_counts_beside_the_range(scores):
    # both scores range from 0 to 1; "up" tells a apart from all others, in "up2" half of the candidates are as good as b
    names = [f"c{i}" for i in range(8)]
    up = {"a": 1.0, "b": 0.0} | dict.fromkeys(names, 0.0)
    up2 = {"a": 0.0, "b": 1.0} | {n: float(i % 2) for i, n in enumerate(names)}
    f = [("r", d, n, v, True) for n, vs in (("up", up), ("up2", up2)) for d, v in vs.items()]
    got = {r.document_identity: r.closeness for r in R.ideal_point_ranking(scores(f)).collect()}
    assert got["a"] > got["b"] + 0.1  # distances by range alone would make them equal
    even = {r.document_identity: r.closeness for r in R.ideal_point_ranking(scores(f), weights={"f:up": 0.0}).collect()}
    assert even["b"] == 1.0 and even["a"] == 0.0


def test_ranks_are_those_of_a_window(scores):
    f = [(f"r{i % 3 if i % 2 else 0}", f"{i:04}", "up", float(i * 37 % 101), True) for i in range(600)]
    ranked = R.ideal_point_ranking(scores(f)).selectExpr("*", "row_number() over (partition by request_identity order by closeness desc, document_identity) as w")
    assert ranked.count() == 600 and ranked.where("rank <> w").count() == 0
