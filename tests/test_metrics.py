import pytest

import __spark_entry__ as entry


def test_documents_of_any_id_are_judged(spark, tmp_path):
    docs = [(5_000 + i, "query segment facet", "wiki", "en", 19, "t", None) for i in range(40)]
    columns = "doc_id long, text string, source string, lang string, n_chars long, title string, updated_at timestamp"
    spark.createDataFrame(docs, columns).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.query_id: r for r in entry.queries()["rank_metrics"](spark, str(tmp_path)).collect()}
    # equal scores go to the lower id; grade (id + query) % 4 is 0 for 3, 2 and 2 of ids 5000..5009, and 30 of 40 are relevant
    assert [found[q].precision for q in range(3)] == pytest.approx([0.7, 0.8, 0.8])
    assert [found[q].recall for q in range(3)] == pytest.approx([0.233333, 0.266667, 0.266667])
