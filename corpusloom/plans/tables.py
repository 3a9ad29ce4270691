"""Queries over stores, schemas, JSON, vectors, blocks, streams and the star schema's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.operators import hits as H
from corpusloom.plans import query as q
from corpusloom.plans.registry import Registry, table
from corpusloom.plans.searches import documents_index
from corpusloom.sources import schema, shared
from corpusloom.sources.index import FieldStats, Index
from corpusloom.sources.store import DocumentStore
from corpusloom.streaming import ingest as stream

_SLIM = ["doc_id", "source", "lang", "n_chars"]


def _store(s, d) -> DocumentStore:
    store = DocumentStore(s, shared.scratch_path(s, "store"), sort_by=("doc_id",))
    store.append(table(s, d, "documents").select(*_SLIM))
    return store


def _rounded(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _vectors(s, d) -> Index:
    """The embeddings as documents without text fields."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    empty = s.createDataFrame([], "field string, term string, doc_id long, tf long, positions array<int>, dl long")
    return Index(rows, empty, s.createDataFrame([], "field string, term string, df long, cf long"), {"embedding": FieldStats(0, 0)})


def register(reg: Registry) -> None:
    """Add this module's queries."""
    slim = ", ".join(_SLIM)

    # life of a store
    def appended(s, d):
        store = _store(s, d)
        store.append(table(s, d, "documents").where("doc_id % 5 = 0").select((F.col("doc_id") + 10**7).alias("doc_id"), *_SLIM[1:]))
        return store.read()

    reg.add("store_append", appended, f"SELECT {slim} FROM documents UNION ALL SELECT doc_id + 10000000, source, lang, n_chars FROM documents WHERE doc_id % 5 = 0")

    def updated(s, d):
        store = _store(s, d)
        store.update_where(F.col("source") == "wiki", lambda r: r.withColumn("lang", F.lit("xx")))
        return store.read()

    reg.add("update_by_term", updated, f"SELECT doc_id, source, CASE WHEN source = 'wiki' THEN 'xx' ELSE lang END AS lang, n_chars FROM documents")

    def deleted(s, d):
        store = _store(s, d)
        store.delete_where(F.col("source") == "blog")
        return store.read()

    reg.add("delete_by_term", deleted, f"SELECT {slim} FROM documents WHERE source IS DISTINCT FROM 'blog'")

    def deleted_by_query(s, d):
        store = _store(s, d)
        store.delete(q.search(documents_index(s, d), q.Term("text", "facet"), scores=False))
        return store.read()

    tokens = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nd}]+')"
    reg.add("delete_by_query", deleted_by_query, f"SELECT {slim} FROM documents WHERE NOT list_contains({tokens}, 'facet')")

    def soft(s, d):
        store = _store(s, d)
        store.soft_delete(F.col("lang") == "de", F.lit("2024-01-01").cast("timestamp"))
        return store.read().groupBy(F.col("deleted_at").isNotNull().alias("deleted")).agg(F.count("*").alias("n"))

    reg.add("soft_delete", soft, "SELECT coalesce(lang = 'de', FALSE) AS deleted, count(*) AS n FROM documents GROUP BY 1")

    def compacted(s, d):
        store = _store(s, d)
        store.delete_where(F.col("doc_id") % 3 == 0)
        store.compact(2)
        return store.read()

    reg.add("store_compact", compacted, f"SELECT {slim} FROM documents WHERE doc_id % 3 <> 0")

    def pinned(s, d):
        store = _store(s, d)
        store.delete_where(F.col("doc_id") % 3 == 0)
        store.keep_last(1, pinned=(1,))
        return store.read(1)

    reg.add("store_snapshot", pinned, f"SELECT {slim} FROM documents")

    def merged(s, d):
        a, b = _store(s, d), _store(s, d)
        a.add_store(b)
        return a.read()

    reg.add("merge_stores", merged, f"SELECT {slim} FROM documents UNION ALL SELECT doc_id + (SELECT max(doc_id) FROM documents), source, lang, n_chars FROM documents")

    def restored(s, d):
        store = _store(s, d)
        to = shared.scratch_path(s, "backup")
        store.backup(to)
        return DocumentStore(s, to).read()

    reg.add("store_backup", restored, f"SELECT {slim} FROM documents")

    # schemas and JSON
    rules = [schema.FieldRule("doc_id", "bigint", True), schema.FieldRule("lang", "string", True), schema.FieldRule("source", "string", True)]
    reg.add(
        "schema_validate",
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(schema.violations(table(s, d, "documents"), rules)).alias("missing")),
        "SELECT doc_id, 'lang' AS missing FROM documents WHERE lang IS NULL UNION ALL SELECT doc_id, 'source' FROM documents WHERE source IS NULL",
    )
    reg.add(
        "json_flatten",
        lambda s, d: schema.from_json_column(table(s, d, "events").select("event_id", "props"), "props", "k int").withColumnRenamed("props.k", "k"),
        "SELECT event_id, (props->>'k')::INT AS k FROM events",
    )

    # vectors
    probe = tuple(0.1 * ((i * 7) % 11 - 5) for i in range(64))
    cos = f"list_cosine_similarity(embedding::DOUBLE[], {list(probe)}::DOUBLE[])"
    reg.add("knn_exact", lambda s, d: _rounded(q.top(q.search(_vectors(s, d), q.Vector("embedding", probe)), 10)), f"SELECT vec_id AS doc_id, round({cos}, 6) AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 10")
    reg.add(
        "knn_filtered",
        lambda s, d: _rounded(q.top(q.search(_vectors(s, d), q.Vector("embedding", probe, q.points("label", [1, 2]))), 10)),
        f"SELECT vec_id AS doc_id, round({cos}, 6) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY {cos} DESC, vec_id LIMIT 10",
    )

    def int8(s, d):
        """Vectors as bytes of their greatest component; the first 40 by bytes are ranked again exactly."""
        rows = table(s, d, "embeddings")
        scale = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
        packed = rows.withColumn("q8", F.when(scale > 0, F.transform("embedding", lambda x: F.round(x.cast("double") * 127 / scale).cast("tinyint"))))
        target = F.array(*[F.lit(float(x)) for x in probe])
        rough = packed.withColumn("rough", q.cosine(F.col("q8"), target)).orderBy(F.desc("rough"), "vec_id").limit(40)
        return _rounded(q.top(rough.select(F.col("vec_id").alias("doc_id"), q.cosine(F.col("embedding"), target).alias("score")), 10))

    reg.add("knn_int8", int8, f"SELECT vec_id AS doc_id, round({cos}, 6) AS score FROM embeddings ORDER BY {cos} DESC, vec_id LIMIT 10")
    norm = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
    reg.add("vector_normalise", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(q.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm")), f"SELECT vec_id, round({norm}, 5) AS norm FROM embeddings")

    def diverse(s, d):
        hits = q.top(q.search(_vectors(s, d), q.Vector("embedding", probe)), 50).join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
        return H.mmr(hits.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.col("score").alias("relevance"), "vector"), 10)

    reg.add("mmr", diverse)

    # blocks and multi-valued columns: orders with their lines
    reg.add(
        "block_join_orders",
        lambda s, d: table(s, d, "orders").join(table(s, d, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_orderpriority"),
        "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R')",
    )

    def many(s, d):
        return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("prices"))  # an order has few lines

    reg.add(
        "sort_multivalue_min_max",
        lambda s, d: many(s, d).select("l_orderkey", F.array_min("prices").alias("low"), F.array_max("prices").alias("high")).orderBy(F.desc("low"), "l_orderkey").limit(20),
        "SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_orderkey ORDER BY low DESC, l_orderkey LIMIT 20",
    )
    reg.add(
        "stats_multivalue",
        lambda s, d: H.stats(many(s, d), "prices").select("count", "min", "max", F.round("sum", 2).alias("sum"), F.round("avg", 4).alias("avg")),
        "SELECT count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS avg FROM lineitem",
    )
    reg.add(
        "range_multivalue",
        lambda s, d: many(s, d).where(F.exists("prices", lambda x: x.between(90000, 95000))).select("l_orderkey"),
        "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_extendedprice BETWEEN 90000 AND 95000",
    )
    reg.add(
        "histogram_price",
        lambda s, d: H.histogram(table(s, d, "lineitem"), "l_extendedprice", 1000.0),
        "WITH e AS (SELECT floor(min(l_extendedprice) / 1000)::BIGINT AS f, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT unnest(range(f, f + ceil((hi - f * 1000) / 1000)::BIGINT + 1)) AS b FROM e) SELECT b * 1000.0::DOUBLE AS bucket, count(l_extendedprice) AS count FROM b LEFT JOIN lineitem ON floor(l_extendedprice / 1000)::BIGINT = b GROUP BY b",
    )
    reg.add(
        "facet_multi_index",
        lambda s, d: H.facets(table(s, d, "events").select(F.col("event_type").alias("kind")).unionByName(table(s, d, "orders").select(F.col("o_orderpriority").alias("kind"))), ["kind"]),
        "SELECT 'kind' AS field, kind AS value, count(*) AS count FROM (SELECT event_type AS kind FROM events UNION ALL SELECT o_orderpriority FROM orders) WHERE kind <> '' GROUP BY kind",
    )

    # streams
    def ingested(s, d):
        store = DocumentStore(s, shared.scratch_path(s, "store"))
        stream.ingest(stream.parquet_stream(s, d, "documents").select(*_SLIM), store, shared.scratch_path(s, "offsets"))
        return store.read()

    reg.add("stream_ingest", ingested, f"SELECT {slim} FROM documents")

    wanted = {"query and facet": ["query", "facet"], "segment": ["segment"]}

    def standing(s, d):
        out = shared.scratch_path(s, "matches")
        found = stream.standing_queries(stream.parquet_stream(s, d, "documents"), "text", an.standard, wanted)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared.scratch_path(s, "offsets")).trigger(availableNow=True).start().awaitTermination()
        return s.read.schema("doc_id long, query string").parquet(out)

    reg.add("stream_standing_queries", standing, f"SELECT doc_id, 'segment' AS query FROM documents WHERE list_contains({tokens}, 'segment') UNION ALL SELECT doc_id, 'query and facet' FROM documents WHERE list_contains({tokens}, 'query') AND list_contains({tokens}, 'facet')")
    reg.add(
        "event_windows",
        lambda s, d: stream.event_counts(table(s, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total")),
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    )
