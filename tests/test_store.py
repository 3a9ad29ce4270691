import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stemming
from corpusloom.sources import schema
from corpusloom.sources.store import Conflict, DocumentStore


@pytest.fixture
def store(spark, tmp_path):
    s = DocumentStore(spark, str(tmp_path / "store"))
    s.append(spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string"))
    return s


def texts(df):
    return sorted(r.text for r in df.collect())


def test_changes_and_versions(store, spark):
    store.update(spark.createDataFrame([(1, "new"), (9, "added")], "doc_id long, text string"))
    store.delete_where(F.col("doc_id") == 2)
    store.append(spark.createDataFrame([(2, "again")], "doc_id long, text string"))
    assert texts(store.read()) == ["added", "again", "new", "t0", "t3", "t4", "t5"]
    assert texts(store.read(1)) == [f"t{i}" for i in range(6)]
    store.compact(1)
    assert store.manifest()["tombstones"] == [] and texts(store.read()) == ["added", "again", "new", "t0", "t3", "t4", "t5"]
    assert store.keep_last(1, pinned=(1,)) == [2, 3, 4]
    assert texts(store.read(1)) == [f"t{i}" for i in range(6)] and store.validate() == {"null_ids": 0, "repeated_ids": 0}


def test_two_phases_rollback_and_conflict(store, spark):
    rows = spark.createDataFrame([(7, "x")], "doc_id long, text string")
    first, second = store.prepare(rows), store.prepare(rows)
    assert store.read().count() == 6
    store.commit(first)
    with pytest.raises(Conflict):
        store.commit(second)
    assert store.read().count() == 7
    third = store.prepare(rows)
    store.rollback(third)
    assert store.versions() == [1, 2]


def test_a_batch_counts_once(store, spark):
    rows = spark.createDataFrame([(7, "x")], "doc_id long, text string")
    store.append(rows, ("s", 0))
    store.append(rows, ("s", 0))
    store.append(rows, ("s", 1))
    assert store.read().count() == 8


def test_backup_is_verified(store, tmp_path, spark):
    checksum = store.backup(str(tmp_path / "copy"))
    assert checksum == store.checksum() == DocumentStore(spark, str(tmp_path / "copy")).checksum()
    store.delete_where(F.col("doc_id") == 0)
    assert store.checksum() != checksum


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    rules = [schema.FieldRule("a", "bigint", True), schema.FieldRule("b", "string", True)]
    schema.check_columns(df, rules, strict=True)
    assert df.select(schema.violations(df, rules)).first()[0] == ["b"]
    for bad, strict in (([schema.FieldRule("c", "string", True)], False), ([schema.FieldRule("a", "int")], False), ([schema.FieldRule("a", "bigint")], True)):
        with pytest.raises(schema.SchemaError):
            schema.check_columns(df, bad, strict)
    nested = spark.createDataFrame([(1, '{"x":{"y":2,"z":[1,2]}}')], "id long, j string")
    assert schema.from_json_column(nested, "j", "x struct<y:int,z:array<int>>").columns == ["id", "j.x.y", "j.x.z"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("generalizations", "gener"), ("controll", "control"), ("sky", "sky"), ("at", "at")])
def test_porter(word, stem):
    assert stemming.porter(word) == stem


def test_lexicon_and_affixes():
    assert stemming.longest_match(frozenset({"研究", "研究生", "生命"}))("研究生命x") == ["研究生", "命", "x"]
    stem = stemming.affix_stemmer({"work": "A", "happy": "B"}, {"A": [("", "ed", ".")], "B": [("y", "iness", "y")]})
    assert [stem(w) for w in ("worked", "happiness", "work", "other")] == ["work", "happy", "work", "other"]
