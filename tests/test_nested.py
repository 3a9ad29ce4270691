import json

import pytest

from corpusloom.operators import nested


@pytest.fixture
def cases(spark, rows):
    def run(payloads=(), searches=()):
        ops = spark.createDataFrame(list(enumerate(payloads, 1)), "delivery_id long, document_json string")
        log = spark.createDataFrame([(i, q, r, "x") for i, (q, r) in enumerate(searches, 1)], "search_id long, request_json string, response_json string, path string")
        return [r[2:] for r in rows(nested.nested_cases(ops, log))]

    return run


def test_children_at_any_depth(cases):
    found = cases([json.dumps({"a": [1, {"b": [{"c": 1}, None, [{"d": 2}]]}], "o": {"x": [{}]}})])
    assert found == [("child", "/a/1", ""), ("child", "/a/1/b/0", "/a/1"), ("child", "/a/1/b/2/0", "/a/1"), ("child", "/o/x/0", "")]


@pytest.mark.parametrize("text", [None, "", "[", '{"a":[{}]', "null", '"[{}]"', '{"a":[{}]} x', "{}"])
def test_nothing_from_what_isnt_complete(cases, text):
    assert cases([text], [(text, text)]) == []


def test_clauses_names_and_bare_values(cases):
    q = {"Query": {"Must": [None, {"kind": "x", "should": {"kind": "y"}}], "spanNear": {"Clauses": [{"kind": "z"}]}, "mustNot": "text"}}
    found = cases(searches=[(json.dumps(q), None)])
    assert found == [("clause", "/query/must/1", ""), ("clause", "/query/must/1/should/0", "/query/must/1"), ("clause", "/query/spanNear/clauses/0", "")]


def test_hits_fragments_and_double_encoding(cases):
    r = {"Hits": [None, {"Highlights": {"Body.De": ["a", None, "b"], "t": "c"}}, {"highlights": None, "document": {"hits": [{}]}}]}
    found = cases(searches=[(None, json.dumps(json.dumps(r)))])
    assert found == [("fragment", "/hits/1/highlights/Body.De/0", "/hits/1"), ("fragment", "/hits/1/highlights/Body.De/2", "/hits/1"), ("fragment", "/hits/1/highlights/t/0", "/hits/1"), ("hit", "/hits/1", ""), ("hit", "/hits/2", "")]


def test_equal_objects_have_one_identity_and_keep_every_occurrence(spark):
    ops = spark.createDataFrame([(1, '{"a":[{"x":1,"y":2},{"y":2,"x":1},{"x":1}]}'), (2, '{"b":[{"x":1.0,"y":2},{"y":2,"x":1}]}')], "delivery_id long, document_json string")
    found = nested.payload_occurrences(ops)
    store = {r.content: r.occurrences for r in nested.object_store(found).collect()}
    assert store == {'{"x":1,"y":2}': 4, '{"x":1}': 1}
    assert found.count() == 5


def test_searches_that_stand_twice_count_once(spark, rows):
    log = spark.createDataFrame([(1, '{"query":{"must":[{}]}}', None)] * 2, "search_id long, request_json string, response_json string")
    ops = spark.createDataFrame([], "delivery_id long, document_json string")
    assert rows(nested.nested_cases(ops, log)) == [("search", 1, "clause", "/query/must/0", "")]


def test_very_deep_text_is_no_failure(cases):
    assert cases(['{"a":' * 200_000 + "1" + "}" * 200_000, '{"a":[' * 300 + "{}" + "]}" * 300])[-1][0] == "child"


def test_every_object_of_both_sources_has_an_identity(spark):
    ops = spark.createDataFrame([(1, '{"n":1,"o":{"x":2},"a":[{"x":2}]}'), (2, '{"n":3}')], "delivery_id long, document_json string")
    search = (7, '{"query":{"must":[{"k":1}]}}', '{"total":1,"hits":[{"document":{"t":"d"},"highlights":{"b":["f"]}}]}')
    log = spark.createDataFrame([search] * 2, "search_id long, request_json string, response_json string")
    found = nested.all_occurrences(ops, log)
    places = {(r.record_id, r.entity, r.path, r.parent_path): r for r in found.collect()}
    assert sorted(places) == [
        (1, "child", "/a/0", ""), (1, "object", "/o", ""), (1, "payload", "", ""), (2, "payload", "", ""),
        (7, "clause", "/query/must/0", "/query"), (7, "fragment", "/hits/0/highlights/b/0", "/hits/0/highlights"), (7, "hit", "/hits/0", ""),
        (7, "object", "/hits/0/document", "/hits/0"), (7, "object", "/hits/0/highlights", "/hits/0"), (7, "object", "/query", ""), (7, "request", "", ""), (7, "response", "", ""),
    ]
    assert found.count() == 12
    assert places[1, "object", "/o", ""].node_hash == places[1, "child", "/a/0", ""].node_hash
    assert places[7, "hit", "/hits/0", ""].parent_hash == places[7, "response", "", ""].node_hash
    assert nested.object_store(found).count() == 11  # one object is a child and a property's value


def test_objects_beyond_a_thousand_levels(cases):
    found = cases(['{"a":' * 1500 + '{"b":[{}]}' + "}" * 1500, '{"a":[' * 1500 + "{}" + "]}" * 1500])
    assert [r[0] for r in found] == ["child"] * 1501


def test_equal_numbers_and_names_like_references(spark):
    ops = spark.createDataFrame([(1, '{"a":[{"x":1},{"x":1.0},{"x":1e0},{"x":"1"},{"$":"00"},{"y":{"x":1}}]}'), (2, None)], "delivery_id long, document_json string")
    log = spark.createDataFrame([], "search_id long, request_json string, response_json string")
    rows = nested.all_occurrences(ops, log).collect()
    at = {r.path: r.node_hash for r in rows}
    assert at["/a/0"] == at["/a/1"] == at["/a/2"] == at["/a/5/y"] and len({at[p] for p in ("/a/0", "/a/3", "/a/4", "/a/5")}) == 4
    assert {r.content for r in rows if r.path == "/a/4"} == {'{"$$":"00"}'}


def test_bridge_and_objects_name_each_other(spark, sf):
    import __spark_entry__ as entry

    q = entry.queries()
    bridge, objects = q["p4_bridge"](spark, sf), q["p4_objects"](spark, sf)
    identities = bridge.select("node_hash").distinct()
    assert identities.count() == objects.count() == objects.join(identities, "node_hash").count()
    assert bridge.count() == objects.agg({"occurrences": "sum"}).first()[0]
    # every parent is an object, and every reference in a content too
    assert bridge.where("parent_hash is not null").select("parent_hash").distinct().join(objects, objects.node_hash == bridge.parent_hash, "left_anti").count() == 0
