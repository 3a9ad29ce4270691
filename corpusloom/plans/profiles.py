"""Queries over ranking profiles, sessions, several indexes at once, coordinates and merges of stores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.functions import geo
from corpusloom.operators import hits as H
from corpusloom.operators import profiles as P
from corpusloom.operators import sessions as S
from corpusloom.plans import query as q
from corpusloom.plans.registry import Registry, table
from corpusloom.plans.searches import LAT, LON, _cte, _has, _rounded, _scores, _sql, _terms_sql, documents_index
from corpusloom.sources import merging, shared
from corpusloom.sources.index import build, combined
from corpusloom.sources.store import DocumentStore

_halves: dict[tuple[str, str], list] = {}


def _split_index(s, d):
    """The documents as two indexes, written at their first use in a session."""
    key = (s.sparkContext.applicationId, d)
    if key not in _halves:
        docs = table(s, d, "documents")
        _halves[key] = [build(docs.where(f"doc_id % 2 = {i}"), {"text": ("text", an.standard)}) for i in (0, 1)]
    return combined(_halves[key], apart=False)


def register(reg: Registry) -> None:
    """Add this module's queries."""
    term = lambda t: q.Term("text", t)

    reg.add("multi_index_term", lambda s, d: _rounded(q.search(_split_index(s, d), term("segment"))), _terms_sql("term = 'segment'"))
    reg.add("multi_index_phrase", lambda s, d: q.search(_split_index(s, d), q.Bool(must=(term("query"), term("results"))), scores=False), _sql(_cte(), out=f"SELECT doc_id FROM documents WHERE doc_id IN ({_has('query')}) AND doc_id IN ({_has('results')})"))

    def multi_facets(s, d):
        ix = _split_index(s, d)
        return H.facets(q.search(ix, term("facet"), scores=False).join(ix.docs, "doc_id"), ["source", "lang"])

    facet_rows = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS count FROM documents WHERE doc_id IN ({_has('facet')}) AND {c} <> '' GROUP BY {c}" for c in ("source", "lang"))
    reg.add("multi_index_facets", multi_facets, _sql(_cte(), out=facet_rows))

    def encoded(s, d):
        lat, lon = F.expr(f"cast({LAT} as double)"), F.expr(f"cast({LON} as double)")
        rows = table(s, d, "documents").select("doc_id", geo.encode_latitude(lat).alias("lat_code"), geo.encode_longitude(lon).alias("lon_code"))
        return rows.withColumns({"lat": F.round(geo.decode_latitude(F.col("lat_code")), 4), "lon": F.round(geo.decode_longitude(F.col("lon_code")), 4)})

    turn = "CAST(floor((({0}) + {1}) * (4294967295 / {2})) AS BIGINT) - 2147483648"
    reg.add("geo_codes", encoded, f"SELECT doc_id, CAST({turn.format(LAT, '90.0', '180.0')} AS INTEGER) AS lat_code, CAST({turn.format(LON, '180.0', '360.0')} AS INTEGER) AS lon_code, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon FROM documents")

    # profiles
    first = f"r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM sc)"  # noqa: F541
    boosted = P.Profile("length", "1", (P.Function("length", lambda: F.col("doc.n_chars") * 0.001, "add", 50),))
    reg.add(
        "profile_function",
        lambda s, d: P.rank(documents_index(s, d), term("query"), boosted, 20).withColumn("score", F.round("score", 6)),
        _sql(_cte(), _scores("term = 'query'"), first, "b AS (SELECT doc_id, score + coalesce(n_chars, 0) * 0.001 AS score FROM r JOIN documents USING (doc_id) WHERE place <= 50)", out="SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 20"),
    )
    ordered = P.Profile("order", "1", (P.Function("fresh", lambda: F.col("doc.doc_id"), "order", 30),))
    reg.add(
        "profile_order_only",
        lambda s, d: P.rank(documents_index(s, d), term("query"), ordered, 10).withColumn("score", F.round("score", 6)),
        _sql(_cte(), _scores("term = 'query'"), first, out="SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM r WHERE place <= 30 ORDER BY doc_id DESC LIMIT 10"),
    )
    two = P.Profile("two", "1", (P.Rescore("again", term("facet"), 40, 1.0, 2.0), P.Function("length", lambda: F.lit(2.0), "multiply", 5)))
    reg.add(
        "profile_two_stages",
        lambda s, d: P.rank(documents_index(s, d), term("query"), two, 10).withColumn("score", F.round("score", 6)),
        _sql(
            _cte(), _scores("term = 'query'"), _scores("term = 'facet'", name="fa"), first,
            "g AS (SELECT doc_id, r.score + 2 * coalesce(fa.score, 0) AS score FROM r LEFT JOIN fa USING (doc_id) WHERE place <= 40)",
            "h AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM g)",
            out="SELECT doc_id, round(CASE WHEN place <= 5 THEN 2 * score ELSE score END, 6) AS score, place AS rank FROM h WHERE place <= 10",
        ),
    )
    rules = [
        P.Rule("only-facets", 5, request="Query  ", only=term("facet")),
        P.Rule("others", 1, request="something else", only=term("nothing")),
        P.Rule("past", 1, ends=datetime(2020, 1, 1), only=term("nothing")),
        P.Rule("half", 2, factors={i: 0.5 for i in range(0, 50)}),
    ]
    reg.add(
        "query_rules",
        lambda s, d: P.rank(documents_index(s, d), term("query"), P.Profile("plain", "1"), 20, rules, "query").withColumn("score", F.round("score", 6)),
        _sql(_cte(), _scores("term = 'query'"), f"f AS (SELECT doc_id, CASE WHEN doc_id < 50 THEN 0.5 ELSE 1 END * score AS score FROM sc WHERE doc_id IN ({_has('facet')}))", out="SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f ORDER BY score DESC, doc_id LIMIT 20"),
    )

    def logged(s, d):
        ix = documents_index(s, d)
        top = P.rank(ix, term("query"), P.Profile("plain", "1"), 10).join(ix.docs.select("doc_id", "n_chars"), "doc_id")
        out = P.feature_log(top, {"score": F.col("score"), "n_chars": F.col("n_chars")}, "query", P.Profile("plain", "1"))
        return out.drop("profile_fingerprint").withColumn("feature_value", F.round("feature_value", 6))

    shown = "t AS (SELECT r.*, n_chars FROM r JOIN documents USING (doc_id) WHERE place <= 10)"
    reg.add("feature_log", logged, _sql(_cte(), _scores("term = 'query'"), first, shown, out=" UNION ALL ".join(f"SELECT 'query' AS request_identity, doc_id, place AS shown_rank, '1' AS schema_version, '{n}' AS feature_name, round(CAST({c} AS DOUBLE), 6) AS feature_value FROM t" for n, c in (("score", "score"), ("n_chars", "n_chars")))))

    # paging and limits
    def second_page(s, d):
        session = S.Session(documents_index(s, d), term("query"), [("n_chars", True)], b"a secret")
        _, cursor = session.page(15)
        return session.page(15, cursor)[0]

    reg.add("session_page", second_page, _sql(_cte(), out=f"SELECT doc_id, n_chars FROM documents WHERE doc_id IN ({_has('query')}) ORDER BY n_chars DESC, doc_id LIMIT 15 OFFSET 15"))
    reg.add(
        "limited_hits",
        lambda s, d: S.limited(q.search(documents_index(s, d), term("query")), 20).agg(F.count("*").alias("n"), F.max("is_partial").alias("is_partial")),
        _sql(_cte(), out=f"SELECT least(count(*), 20)::BIGINT AS n, count(*) > 20 AS is_partial FROM ({_has('query')})"),
    )
    reg.add(
        "custom_collector",
        lambda s, d: S.collected(q.search(documents_index(s, d), term("query")), n_hits=F.count("*"), best=F.round(F.max("score"), 6), ids=F.bit_xor("doc_id")),
        _sql(_cte(), _scores("term = 'query'"), out="SELECT count(*) AS n_hits, round(max(score), 6) AS best, bit_xor(doc_id) AS ids FROM sc"),
    )
    reg.add("binary_points", lambda s, d: q.search(documents_index(s, d), q.binary_points("source_bytes", [b"wiki", b"blog"]), scores=False), "SELECT doc_id FROM documents WHERE source IN ('wiki', 'blog')")
    reg.add("ip_points", lambda s, d: q.search(documents_index(s, d), q.ip_points("ip", ["10.7.13.1", "::ffff:10.14.26.2", "2001:db8::1"]), scores=False), "SELECT doc_id FROM documents WHERE (doc_id * 7) % 256 IN (7, 14) AND ((doc_id * 7) % 256, (doc_id * 13) % 256, doc_id % 256) IN ((7, 13, 1), (14, 26, 2))")

    # stores
    def merged(s, d):
        store = DocumentStore(s, shared.scratch_path(s, "store"))
        for i in range(5):
            store.append(table(s, d, "documents").where(f"doc_id % 5 = {i}").select("doc_id", "source"))
        store.delete_where(F.col("source") == "blog")
        groups = store.merge(merging.log_bytes(factor=3)) + store.merge(merging.tiered(per_tier=3, at_once=3))
        return store.read().withColumn("folders", F.lit(len(store.manifest()["data"]))).withColumn("merged", F.lit(sum(map(len, groups))))

    reg.add("store_merge", merged, "SELECT doc_id, source, 1 AS folders, 6 AS merged FROM documents WHERE source IS DISTINCT FROM 'blog'")

    def updated_by_query(s, d):
        store = DocumentStore(s, shared.scratch_path(s, "store"), sort_by=("source", "doc_id"), compression="gzip")
        store.append(table(s, d, "documents").select("doc_id", "source", "lang"))
        hit = q.search(documents_index(s, d), term("facet"), scores=False)
        store.update(store.read().join(hit, "doc_id", "left_semi").withColumn("lang", F.lit("hit")))
        return store.read()

    reg.add("update_by_query", updated_by_query, _sql(_cte(), out=f"SELECT doc_id, source, CASE WHEN doc_id IN ({_has('facet')}) THEN 'hit' ELSE lang END AS lang FROM documents"))

    def checked(s, d):
        store = DocumentStore(s, shared.scratch_path(s, "store"), sort_by=("doc_id",))
        rows = table(s, d, "documents").select("doc_id", "source")
        store.append(rows.unionByName(rows.where("doc_id < 10")).unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
        problems = store.validate()
        return store.inspect().agg(F.sum("rows").alias("rows")).withColumns({k: F.lit(v).cast("long") for k, v in problems.items()})

    reg.add("store_check", checked, "SELECT count(*) + count(*) FILTER (doc_id < 10) + 1 AS rows, 1::BIGINT AS null_ids, count(*) FILTER (doc_id < 10) AS repeated_ids FROM documents")
