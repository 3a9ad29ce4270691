import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.operators import hits as H
from corpusloom.plans import parser
from corpusloom.plans import query as q
from corpusloom.sources.index import build

TEXTS = {1: "red green blue", 2: "red red amber", 3: "green amber amber grey", 4: "", 5: None, 6: "blue red green red", 7: "the and of"}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(i, t, None if i == 3 else i * 10, "x") for i, t in TEXTS.items()] + [(None, "red", 1, "x")], "doc_id long, text string, n int, term string")
    return build(docs, {"text": ("text", an.standard)})


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_random_trees_against_a_plain_evaluator(index):
    rng = random.Random(2)
    words = ["red", "green", "blue", "amber", "grey", "absent"]
    sets = {i: set((t or "").split()) - {"the", "and", "of"} for i, t in TEXTS.items()}

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            w = rng.choice(words)
            return q.Term("text", w), {i for i, s in sets.items() if w in s}
        part = lambda n: [tree(depth - 1) for _ in range(rng.randrange(n))]
        must, should, no = part(3), part(4), part(2)
        least = rng.choice([0, 0, 2])
        hit = set()
        if must or should:
            for i in sets:
                k = sum(i in s for _, s in should)
                if all(i in s for _, s in must) and k >= max(least, 0 if must else 1) and not any(i in s for _, s in no):
                    hit.add(i)
        return q.Bool(tuple(x for x, _ in must), tuple(x for x, _ in should), tuple(x for x, _ in no), least), hit

    for _ in range(12):
        query, want = tree(3)
        assert ids(q.search(index, query, scores=False)) == sorted(want)


def test_scores_add_up_and_boosts_count(index):
    score = lambda x: {r.doc_id: r.score for r in q.search(index, x).collect()}
    a, b = score(q.Term("text", "red")), score(q.Term("text", "green").boosted(3.0))
    both = score(q.Bool(must=(q.Term("text", "red"),), should=(q.Term("text", "green").boosted(3.0),)))
    assert all(both[i] == pytest.approx(a[i] + b.get(i, 0.0)) for i in a)


def test_empty_index_and_unknown_fields(spark, index):
    empty = build(spark.createDataFrame([], "doc_id long, text string"), {"text": ("text", an.standard)})
    for query in (q.Term("text", "red"), q.Phrase("text", ("red", "green")), q.MatchAll(), q.Fuzzy("text", "red"), q.MoreLikeThis(1, "text"), q.Rrf((q.Term("text", "red"),))):
        assert q.search(empty, query).count() == 0
    assert q.search(index, q.Term("nowhere", "red")).count() == 0


def test_phrases_and_slop(index):
    assert ids(q.search(index, q.Phrase("text", ("red", "green")))) == [1, 6]
    assert ids(q.search(index, q.Phrase("text", ("red", "blue"), slop=1))) == [1]
    assert ids(q.search(index, q.NearTerms("text", ("blue", "green"), slop=1, ordered=False))) == [1, 6]


@pytest.mark.parametrize(
    "text, want",
    [
        ("red", q.Term("text", "red")),
        ("RED^2", q.Term("text", "red", boost=2.0)),
        ("+red -green", q.Bool(must=(q.Term("text", "red"),), must_not=(q.Term("text", "green"),))),
        ("red AND green", q.Bool(must=(q.Term("text", "red"), q.Term("text", "green")))),
        ("red OR other:green", q.Bool(should=(q.Term("text", "red"), q.Term("other", "green")))),
        ("red | green", q.DisMax((q.Term("text", "red"), q.Term("text", "green")))),
        ('"red green"~2', q.Phrase("text", ("red", "green"), slop=2)),
        ("re*", q.Prefix("text", "re")),
        ("r?d*", q.Wildcard("text", "r?d*")),
        ("red~1", q.Fuzzy("text", "red", 1)),
        ("[a TO m}", q.TermRange("text", "a", "m", True, False)),
        ("/gr.y/", q.Regexp("text", "gr.y")),
        ("red^=3", q.ConstantScore(q.Term("text", "red"), 3.0)),
        ("the", q.Bool()),
        ("", q.Bool()),
    ],
)
def test_query_strings(text, want):
    assert parser.parse(text, "text") == want


def test_query_string_errors():
    for text in ("(red", "red)", "(" * 70 + "x" + ")" * 70):
        with pytest.raises(parser.QuerySyntaxError):
            parser.parse(text, "text")
        assert parser.parse(text, "text", lenient=True) == q.Bool()


def test_cursor_is_bound_to_its_query():
    key, query = b"secret", q.Term("text", "red")
    cursor = H.sign_cursor([1.5, 7], H.fingerprint(query), key)
    assert H.read_cursor(cursor, H.fingerprint(query), key) == [1.5, 7]
    for other, secret in ((q.Term("text", "blue"), key), (query, b"guess")):
        with pytest.raises(ValueError):
            H.read_cursor(cursor, H.fingerprint(other), secret)


def test_pages_join_up(index):
    rows = q.search(index, q.MatchAll()).join(index.docs.select("doc_id", "n"), "doc_id")
    keys = [H.number_key(F.col("n"), True)]
    every = [(r.n or 0, r.doc_id) for r in H.sort_hits(rows, keys, 100).collect()]
    seen, at = [], None
    while True:
        page = (H.sort_hits(rows, keys, 2) if at is None else H.search_after(rows, keys, at, 2)).collect()
        if not page:
            break
        seen += [(r.n or 0, r.doc_id) for r in page]
        at = seen[-1]
    assert seen == every


def test_pins_keep_their_places(spark):
    hits = spark.createDataFrame([(i, float(10 - i)) for i in range(6)], "doc_id long, score double")
    order = [r.doc_id for r in H.pin(hits, {4: 1, 5: 3, 99: 2}, 6).orderBy("rank").collect()]
    assert order == [4, 0, 5, 1, 2, 3]


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert tuple(H.stats(none, "v").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert H.histogram(none, "v").count() == 0 and H.facets(none, ["v"]).count() == 0


def test_analysis_of_null_and_empty(spark):
    from corpusloom.functions.languages import STEMMERS, language_analyser

    df = spark.createDataFrame([(None,), ("",), ("L'été des nations; Übergrößen u.s.a. foo-bar 12abc",)], "t string")
    for fn in [*an.ANALYSERS.values(), language_analyser("fr"), language_analyser("ru"), language_analyser("xx", ["a"]), an.ngrams(2, 3), an.edge_ngrams(1, 2), an.path_tree()]:
        got = [r[0] for r in df.select(fn(F.col("t"))).collect()]
        assert not got[0] and not any(got[1]) and got[2]
    words = spark.createDataFrame([("chevaux",), ("nations",), ("freundlichkeit",)], "w string")
    assert [r[0] for r in words.select(STEMMERS["fr"](F.col("w"))).collect()][0] == "cheval"
    assert [r[0] for r in words.select(STEMMERS["de"](F.col("w"))).collect()][2] == "freu"


def test_ipv6_ipv4_and_rubbish(spark):
    values = ["10.0.0.5", "::ffff:10.0.0.7", "2001:db8::1", "2001:DB8:0:0:0:0:0:ff", "::1", "fe80::1:2:3", "1.2.3", "300.1.1.1", "a:b", ":::", "", None, "::ffff:0a00:0009"]
    df = spark.createDataFrame([(v,) for v in values], "ip string")
    from corpusloom.plans import query as q

    def hits(w):
        return [r.ip for r in df.where(w.predicate(lambda c: F.col(c))).collect()]

    mapped = ["10.0.0.5", "::ffff:10.0.0.7", "::ffff:0a00:0009"]
    assert hits(q.ip_range("ip", "10.0.0.0", "10.0.0.255")) == mapped
    assert hits(q.ip_range("ip", "::ffff:10.0.0.0", "::ffff:10.0.0.255")) == mapped
    assert hits(q.ip_range("ip", "2001:db8::", "2001:db8::ffff")) == ["2001:db8::1", "2001:DB8:0:0:0:0:0:ff"]
    assert hits(q.ip_range("ip", "::", "::ffff:10.0.0.9")) == ["10.0.0.5", "::ffff:10.0.0.7", "::1", "::ffff:0a00:0009"]
    assert hits(q.ip_points("ip", ["fe80:0::1:2:3", "2001:db8:0::1"])) == ["2001:db8::1", "fe80::1:2:3"]
