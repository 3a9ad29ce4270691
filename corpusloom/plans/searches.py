"""Search queries over the documents, each with DuckDB SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import analysis as an
from corpusloom.functions import similarity as sim
from corpusloom.operators import hits as H
from corpusloom.operators import suggest as G
from corpusloom.plans import parser
from corpusloom.plans import query as q
from corpusloom.plans.registry import Registry, table
from corpusloom.sources.index import Index, build

_open: dict[tuple[str, str], Index] = {}
LAT, LON = "((doc_id * 37) % 180) - 90", "((doc_id * 91) % 360) - 180"
IP = "concat('10.', cast((doc_id * 7) % 256 as {s}), '.', cast((doc_id * 13) % 256 as {s}), '.', cast(doc_id % 256 as {s}))"


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a data directory's documents, written at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        docs = table(spark, sf_dir, "documents").selectExpr(
            "*", f"cast({LAT} as double) as lat", f"cast({LON} as double) as lon", f"{IP.format(s='string')} as ip", "cast(source as binary) as source_bytes", "cast(doc_id - doc_id % 10 as bigint) as parent_id"
        )
        _open[key] = build(docs, {"text": ("text", an.standard), "title": ("title", an.standard)})
    return _open[key]


STOPS = "[" + ", ".join(f"'{w}'" for w in an.STOP_WORDS) + "]"


def _q(p: str) -> str:
    return f"{p}all" if p else '"all"'


def _cte(column: str = "text", p: str = "") -> str:
    """Tokens, postings and statistics of a column, names prefixed by p."""
    return f"""
{p}toks AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: lower(x)), lambda x: NOT list_contains({STOPS}, x)) AS t FROM documents),
{p}post AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM {p}toks),
{p}tfs AS (SELECT doc_id, term, count(*) AS tf FROM {p}post GROUP BY doc_id, term),
{p}dls AS (SELECT doc_id, len(t) AS dl FROM {p}toks),
{p}st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl, sum(dl)::DOUBLE AS sl FROM {p}dls),
{p}dfs AS (SELECT term, count(*) AS df, sum(tf)::DOUBLE AS cf FROM {p}tfs GROUP BY term),
{_q(p)} AS (SELECT * FROM {p}tfs JOIN {p}dls USING (doc_id) JOIN {p}dfs USING (term) CROSS JOIN {p}st)"""


_IDF = "ln(1 + (n - df + 0.5) / (df + 0.5))"
_SAT = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_IDFC = "(1 + ln(n / (df + 1)))"
FORMULAS = {
    "bm25": f"{_IDF} * {_SAT}",
    "bm25plus": f"{_IDF} * ({_SAT} + 1)",
    "bm25l": f"{_IDF} * ({_SAT} + 0.5 * tf / (1 + tf))",
    "tfidf": f"sqrt(tf) * {_IDFC} / sqrt(dl)",
    "tfidf_aug": f"(0.5 + 0.5 * tf / (tf + 0.5)) * {_IDFC} / sqrt(dl)",
    "tfidf_double": f"(0.5 + 0.5 * tf / (tf + 0.5)) * {_IDFC} / (0.8 + 0.2 * dl / avgdl)",
    "tfidf_pivoted": f"sqrt(tf) * {_IDFC} / (0.8 + 0.2 * dl / avgdl)",
    "dirichlet": "ln((tf + 2000 * cf / sl) / (dl + 2000))",
    "jm": "ln(0.9 * tf / dl + 0.1 * cf / sl)",
    "absdisc": "ln((greatest(tf - 0.7, 0) + 0.7 * dl * cf / sl) / dl)",
}
BM25 = FORMULAS["bm25"]


def _scores(where: str, formula: str = BM25, p: str = "", name: str = "sc") -> str:
    return f"{name} AS (SELECT doc_id, sum({formula}) AS score FROM {_q(p)} WHERE {where} GROUP BY doc_id)"


def _sql(*ctes: str, out: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + out


def _terms_sql(where: str, formula: str = BM25) -> str:
    return _sql(_cte(), _scores(where, formula), out="SELECT doc_id, round(score, 6) AS score FROM sc")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def T(term: str) -> q.Term:
    return q.Term("text", term)


def _has(*terms: str) -> str:
    return "SELECT doc_id FROM tfs WHERE term IN (" + ", ".join(f"'{t}'" for t in terms) + ")"


def register(reg: Registry) -> None:
    """Add this module's queries."""

    def add(name, query, sql, similarity="bm25"):
        reg.add(name, lambda s, d: _rounded(q.search(documents_index(s, d), query() if callable(query) else query, similarity)), sql)

    def plain(name, fn, sql):
        reg.add(name, lambda s, d: fn(documents_index(s, d)), sql)

    # similarities
    add("bm25_term", T("segment"), _terms_sql("term = 'segment'"))
    for name in sim.SIMILARITIES:
        if name != "bm25":
            add(f"sim_{name}", T("query"), _terms_sql("term = 'query'", FORMULAS[name]), name)

    # boolean
    or3 = q.Bool(should=(T("query"), T("segment"), T("facet")))
    or3_sql = "term IN ('query', 'segment', 'facet')"
    add("bm25_or3", or3, _terms_sql(or3_sql))
    top_sql = _sql(_cte(), _scores(or3_sql), out="SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
    plain("bm25_top10", lambda ix: _rounded(q.top(q.search(ix, or3), 10)), top_sql)
    add(
        "bm25_and2_not1",
        q.Bool(must=(T("query"), T("results")), must_not=(T("facet"),)),
        _sql(_cte(), _scores("term IN ('query', 'results')"), out=f"SELECT doc_id, round(score, 6) AS score FROM sc WHERE doc_id IN ({_has('query')}) AND doc_id IN ({_has('results')}) AND doc_id NOT IN ({_has('facet')})"),
    )
    add(
        "bool_min_should",
        q.Bool(should=(T("query"), T("results"), T("segment"), T("facet")), minimum=2),
        _sql(_cte(), "sc AS (SELECT doc_id, sum(" + BM25 + ") AS score, count(*) AS k FROM all_ WHERE term IN ('query', 'results', 'segment', 'facet') GROUP BY doc_id)", out="SELECT doc_id, round(score, 6) AS score FROM sc WHERE k >= 2").replace("FROM all_", 'FROM "all"'),
    )
    add(
        "bool_must_should",
        q.Bool(must=(T("query"),), should=(T("facet").boosted(2.0),)),
        _sql(_cte(), f"sc AS (SELECT doc_id, sum(CASE WHEN term = 'facet' THEN 2 ELSE 1 END * {BM25}) AS score FROM \"all\" WHERE term IN ('query', 'facet') GROUP BY doc_id)", out=f"SELECT doc_id, round(score, 6) AS score FROM sc WHERE doc_id IN ({_has('query')})"),
    )
    add("bool_only_not", q.Bool(must_not=(T("query"),)), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE FALSE")
    add("bool_complement", ~T("query"), _sql(_cte(), out=f"SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN ({_has('query')})"))
    add("match_all", q.MatchAll(boost=2.0), "SELECT doc_id, 2.0::DOUBLE AS score FROM documents")
    add("match_none", q.MatchNone("nothing"), "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE FALSE")

    # multi-term
    add("term_in_set", q.TermInSet("text", ("query", "segment", "merge", "query")), _sql(_cte(), out=f"SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM ({_has('query', 'segment', 'merge')})"))
    add("prefix_terms", q.Prefix("text", "seg"), _terms_sql("starts_with(term, 'seg')"))
    add("wildcard_terms", q.Wildcard("text", "s?gm*t*"), _terms_sql("regexp_full_match(term, 's.gm.*t.*')"))
    add("wildcard_prefix", q.Wildcard("text", "mer*"), _terms_sql("starts_with(term, 'mer')"))
    add("regexp_terms", q.Regexp("text", "que.*s$"), _terms_sql("regexp_matches(term, '^que.*s$')"))
    add("regexp_unanchored", q.Regexp("text", ".*dex.*"), _terms_sql("contains(term, 'dex')"))
    add("term_range", q.TermRange("text", "sea", "seg", True, False), _terms_sql("term >= 'sea' AND term < 'seg'"))
    near = "SELECT term, d FROM (SELECT term, levenshtein(term, 'segmant') AS d FROM dfs WHERE regexp_full_match(term, '[a-z0-9]+')) WHERE d <= 2 ORDER BY d, term LIMIT 64"
    add("fuzzy_terms", q.Fuzzy("text", "segmant", 2), _sql(_cte(), f"near AS ({near})", f"sc AS (SELECT doc_id, sum((1 - d / 3.0) * {BM25}) AS score FROM \"all\" JOIN near USING (term) GROUP BY doc_id)", out="SELECT doc_id, round(score, 6) AS score FROM sc"))

    # stored columns
    one = "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE "
    add("field_exists", q.exists("lang"), one + "lang IS NOT NULL")
    add("num_range", q.number_range("n_chars", 200, 900), one + "n_chars BETWEEN 200 AND 900")
    add("num_range_exclusive", q.number_range("n_chars", 200, 900, False, False), one + "n_chars > 200 AND n_chars < 900")
    add("int_points", q.points("doc_id", [3, 5, 8, 13, 21, 10**9]), one + "doc_id IN (3, 5, 8, 13, 21, 1000000000)")
    add("string_set", q.points("source", ["wiki", "blog"]), one + "source IN ('wiki', 'blog')")
    add("binary_range", q.binary_range("source_bytes", b"b", b"f"), one + "source::BLOB BETWEEN 'b'::BLOB AND 'f'::BLOB")
    add("ip_range", q.ip_range("ip", "10.50.0.0", "10.99.255.255"), one + "(doc_id * 7) % 256 BETWEEN 50 AND 99")
    add("geo_box", q.geo_box("lat", "lon", -20, 40, -100, 80), one + f"{LAT} BETWEEN -20 AND 40 AND {LON} BETWEEN -100 AND 80")
    hav = f"2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(48.0 - ({LAT})) / 2), 2) + cos(radians({LAT})) * cos(radians(48.0)) * pow(sin(radians(11.0 - ({LON})) / 2), 2))))"
    add("geo_distance", q.geo_distance("lat", "lon", 48.0, 11.0, 3_000_000.0), one + f"{hav} <= 3000000.0")
    add(
        "bool_filter_range",
        q.Bool(must=(T("query"), q.ConstantScore(q.number_range("n_chars", 500, None), 0.0))),
        _sql(_cte(), _scores("term = 'query'"), out="SELECT doc_id, round(score, 6) AS score FROM sc JOIN documents USING (doc_id) WHERE n_chars >= 500"),
    )

    # compound scores
    add("constant_score", q.ConstantScore(T("query"), 2.5, 2.0), _sql(_cte(), out="SELECT doc_id, 5.0::DOUBLE AS score FROM tfs WHERE term = 'query'"))
    add(
        "dismax",
        q.DisMax((T("query"), T("results"), T("index")), 0.1),
        _sql(_cte(), f"sc AS (SELECT doc_id, max({BM25}) AS m, sum({BM25}) AS t FROM \"all\" WHERE term IN ('query', 'results', 'index') GROUP BY doc_id)", out="SELECT doc_id, round(m + 0.1 * (t - m), 6) AS score FROM sc"),
    )
    add(
        "synonym",
        q.Synonym("text", ("query", "queries")),
        _sql(
            _cte(),
            "d AS (SELECT max(df) AS df FROM dfs WHERE term IN ('query', 'queries'))",
            "x AS (SELECT doc_id, sum(tf) AS tf, any_value(dl) AS dl, any_value(n) AS n, any_value(avgdl) AS avgdl FROM \"all\" WHERE term IN ('query', 'queries') GROUP BY doc_id)",
            out=f"SELECT doc_id, round({BM25}, 6) AS score FROM x CROSS JOIN d",
        ),
    )
    norm = "(0.25 + 0.75 * dl / avgdl)"
    add(
        "combined_fields",
        q.CombinedFields(("title", "text"), ("query", "ledger"), weights=(2.0, 1.0)),
        _sql(
            _cte("title", "a_"),
            _cte("text", "b_"),
            f"freq AS (SELECT doc_id, term, sum(w * tf / {norm}) AS f FROM (SELECT *, 2.0 AS w FROM a_all UNION ALL SELECT *, 1.0 AS w FROM b_all) WHERE term IN ('query', 'ledger') GROUP BY doc_id, term)",
            "d AS (SELECT term, count(*) AS df FROM freq GROUP BY term)",
            out=f"SELECT doc_id, round(sum({_IDF} * 2.2 * f / (f + 1.2)), 6) AS score FROM freq JOIN d USING (term) CROSS JOIN (SELECT n FROM a_st) GROUP BY doc_id",
        ),
    )
    for mode, expr in {"multiply": "score * v", "replace": "v", "sum": "score + v", "max": "greatest(score, v)"}.items():
        add(
            f"function_score_{mode}",
            q.FunctionScore(T("query"), lambda c: c("n_chars") / 1000.0, mode),
            _sql(_cte(), _scores("term = 'query'"), out=f"SELECT doc_id, round(CASE WHEN v IS NULL THEN score ELSE {expr} END, 6) AS score FROM sc JOIN (SELECT doc_id, n_chars / 1000.0::DOUBLE AS v FROM documents) USING (doc_id)"),
        )
    add("function_query", q.FunctionQuery(lambda c: (c("n_chars") + 1) / F.lit(2.0)), "SELECT doc_id, round(coalesce((n_chars + 1) / 2.0::DOUBLE, 0), 6) AS score FROM documents")
    ranked = "SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM (SELECT * FROM {0} ORDER BY score DESC, doc_id LIMIT 100)"
    add(
        "rrf",
        q.Rrf((T("query"), q.Term("title", "ledger"))),
        _sql(_cte(), _cte("title", "a_"), _scores("term = 'query'", name="s1"), _scores("term = 'ledger'", p="a_", name="s2"), out=f"SELECT doc_id, round(sum(part), 6) AS score FROM ({ranked.format('s1')} UNION ALL {ranked.format('s2')}) GROUP BY doc_id"),
    )
    add("block_join", q.BlockJoin(T("facet")), _sql(_cte(), out="SELECT DISTINCT doc_id - doc_id % 10 AS doc_id, 1.0::DOUBLE AS score FROM tfs WHERE term = 'facet' AND doc_id % 10 <> 0"))
    add(
        "more_like_this",
        q.MoreLikeThis(4, "text"),
        _sql(
            _cte(),
            "m AS (SELECT term, tf * ln(n / (df + 1)) AS w FROM \"all\" WHERE doc_id = 4 AND tf >= 2 AND df >= 5 AND length(term) >= 3 ORDER BY w DESC, term LIMIT 25)",
            f"sc AS (SELECT doc_id, sum({BM25} * w / (SELECT max(w) FROM m)) AS score FROM \"all\" JOIN m USING (term) WHERE doc_id <> 4 GROUP BY doc_id)",
            out="SELECT doc_id, round(score, 6) AS score FROM sc",
        ),
    )

    # phrases, spans, intervals
    def pos(term, a):
        return f"(SELECT doc_id, pos FROM post WHERE term = '{term}') {a}"

    phrase_score = "x AS (SELECT doc_id, any_value(dl) AS dl, any_value(n) AS n, any_value(avgdl) AS avgdl, arg_min(tf, (df, CASE term WHEN '{0}' THEN 0 ELSE 1 END)) AS tf FROM \"all\" WHERE term IN ('{0}', '{1}') GROUP BY doc_id), two AS (SELECT df FROM dfs WHERE term IN ('{0}', '{1}'))"

    def near_sql(a, b, cond):
        found = f"SELECT DISTINCT a.doc_id FROM {pos(a, 'a')} JOIN {pos(b, 'b')} ON a.doc_id = b.doc_id AND {cond}"
        return _sql(_cte(), phrase_score.format(a, b), out=f"SELECT doc_id, round(sum({BM25}), 6) AS score FROM x CROSS JOIN two WHERE doc_id IN ({found}) GROUP BY doc_id")

    add("phrase_exact", q.Phrase("text", ("query", "weights")), near_sql("query", "weights", "b.pos = a.pos + 1"))
    add("phrase_slop", q.Phrase("text", ("geo", "filter"), slop=2), near_sql("geo", "filter", "abs(b.pos - a.pos - 1) <= 2"))
    add("span_near_ordered", q.NearTerms("text", ("segment", "merger"), slop=3), near_sql("segment", "merger", "b.pos > a.pos AND b.pos - a.pos <= 4"))
    add("span_near_unordered", q.NearTerms("text", ("merged", "segment"), slop=12, ordered=False), near_sql("merged", "segment", "abs(b.pos - a.pos) <= 13"))
    multi = q.MultiPhrase("text", (("query", "prefix", "geo"), ("weights", "terms", "points")))
    add("multi_phrase", multi, _sql(_cte(), out="SELECT DISTINCT a.doc_id, 1.0::DOUBLE AS score FROM (SELECT * FROM post WHERE term IN ('query', 'prefix', 'geo')) a JOIN (SELECT * FROM post WHERE term IN ('weights', 'terms', 'points')) b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1"))

    def span(t):
        return q.SpanOf(T(t))

    def docs_sql(found):
        return _sql(_cte(), out=f"SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM ({found})")

    add("span_term", span("facet"), docs_sql("SELECT doc_id FROM post WHERE term = 'facet'"))
    add("span_or", q.SpanOr((span("facet"), span("merger"))), docs_sql("SELECT doc_id FROM post WHERE term IN ('facet', 'merger')"))
    add("span_not", q.SpanNot(span("query"), span("facet")), docs_sql(f"SELECT doc_id FROM post WHERE term = 'query' AND doc_id NOT IN ({_has('facet')})"))
    add("span_first", q.SpanFirst(span("query"), 5), docs_sql("SELECT doc_id FROM post WHERE term = 'query' AND pos + 1 <= 5"))
    add("span_multi_term", q.SpanFirst(q.SpanOf(q.Prefix("text", "seg")), 10), docs_sql("SELECT doc_id FROM post WHERE starts_with(term, 'seg') AND pos + 1 <= 10"))
    big = q.SpanNear((span("query"), span("results")), 8)
    pair = f"SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e FROM {pos('query', 'a')} JOIN {pos('results', 'b')} ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos - a.pos - 1 <= 8"
    inner = f"(SELECT doc_id, pos FROM post WHERE term = 'cached')"
    add("span_containing", q.SpanContaining(big, span("cached")), docs_sql(f"SELECT p.doc_id FROM ({pair}) p JOIN {inner} c ON p.doc_id = c.doc_id AND c.pos >= p.s AND c.pos + 1 <= p.e"))
    add("span_within", q.SpanContaining(big, span("cached"), within=True), docs_sql(f"SELECT p.doc_id FROM ({pair}) p JOIN {inner} c ON p.doc_id = c.doc_id AND c.pos >= p.s AND c.pos + 1 <= p.e"))
    add("interval_not_containing", q.SpanContaining(big, span("cached"), negate=True), docs_sql(f"SELECT p.doc_id FROM ({pair}) p WHERE NOT EXISTS (SELECT 1 FROM {inner} c WHERE p.doc_id = c.doc_id AND c.pos >= p.s AND c.pos + 1 <= p.e)"))
    add("interval_ordered", big, docs_sql(pair))
    add("interval_unordered", q.SpanNear((span("query"), span("results")), 8, ordered=False), docs_sql(f"SELECT a.doc_id FROM {pos('query', 'a')} JOIN {pos('results', 'b')} ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) - 1 <= 8"))
    add("interval_phrase", q.SpanPhrase((span("score"), span("ties"))), docs_sql(f"SELECT a.doc_id FROM {pos('score', 'a')} JOIN {pos('ties', 'b')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 1"))
    add("interval_or", q.SpanOr((q.SpanPhrase((span("score"), span("ties"))), span("facet"))), docs_sql(f"SELECT a.doc_id FROM {pos('score', 'a')} JOIN {pos('ties', 'b')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 UNION ALL SELECT doc_id FROM post WHERE term = 'facet'"))

    # query strings
    add("parse_boolean", lambda: parser.parse('+query -facet results^2 "score ties"', "text"), None)
    add("parse_and_or", lambda: parser.parse("(query AND results) OR facet", "text"), _sql(
        _cte(), f"a1 AS (SELECT doc_id, sum({BM25}) AS s, count(*) AS k FROM \"all\" WHERE term IN ('query', 'results') GROUP BY doc_id)", f"f1 AS (SELECT doc_id, {BM25} AS s FROM \"all\" WHERE term = 'facet')",
        out="SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, s FROM a1 WHERE k = 2 UNION ALL SELECT doc_id, s FROM f1) GROUP BY doc_id"))
    add("parse_best", lambda: parser.parse("query | results", "text"), _sql(_cte(), f"sc AS (SELECT doc_id, max({BM25}) AS score FROM \"all\" WHERE term IN ('query', 'results') GROUP BY doc_id)", out="SELECT doc_id, round(score, 6) AS score FROM sc"))
    add("parse_prefix_range", lambda: parser.parse("text:seg* text:[sea TO seg}", "text"), _sql(
        _cte(), f"sc AS (SELECT doc_id, sum({BM25} * (CASE WHEN starts_with(term, 'seg') THEN 1 ELSE 0 END + CASE WHEN term >= 'sea' AND term < 'seg' THEN 1 ELSE 0 END)) AS score FROM \"all\" WHERE starts_with(term, 'seg') OR (term >= 'sea' AND term < 'seg') GROUP BY doc_id)", out="SELECT doc_id, round(score, 6) AS score FROM sc"))
    add("request_json", lambda: parser.from_request({"kind": "boolean", "must": [{"kind": "term", "field": "text", "value": "query"}], "mustNot": [{"kind": "prefix", "field": "text", "prefix": "fac"}]}),
        _sql(_cte(), _scores("term = 'query'"), out="SELECT doc_id, round(score, 6) AS score FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM tfs WHERE starts_with(term, 'fac'))"))

    # order, paging, count
    plain("count_query", lambda ix: q.count(ix, or3), _sql(_cte(), out=f"SELECT count(DISTINCT doc_id) AS n FROM ({_has('query', 'segment', 'facet')})"))
    sort_rows = lambda ix: q.search(ix, T("query"), scores=False).join(ix.docs.select("doc_id", "source", "n_chars"), "doc_id")
    keys = lambda: [H.text_key(F.col("source")), H.number_key(F.col("n_chars"), True)]
    base = f"SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN ({_has('query')})"
    order = "ORDER BY coalesce(source, ''), coalesce(n_chars, 0) DESC, doc_id"
    plain("sort_multi", lambda ix: H.sort_hits(sort_rows(ix), keys(), 20), _sql(_cte(), out=f"{base} {order} LIMIT 20"))
    plain("search_after_field", lambda ix: H.search_after(sort_rows(ix), keys(), ["blog", 1500, 0], 15),
          _sql(_cte(), out=f"SELECT * FROM ({base}) WHERE coalesce(source, '') > 'blog' OR (coalesce(source, '') = 'blog' AND (coalesce(n_chars, 0) < 1500 OR (coalesce(n_chars, 0) = 1500 AND doc_id > 0))) {order} LIMIT 15"))
    plain("search_after_score", lambda ix: _rounded(H.search_after(q.search(ix, T("query")), [(F.col("score"), True)], [1.0, 0], 15)),
          _sql(_cte(), _scores("term = 'query'"), out="SELECT doc_id, round(score, 6) AS score FROM sc WHERE score < 1.0 OR (score = 1.0 AND doc_id > 0) ORDER BY sc.score DESC, doc_id LIMIT 15"))
    plain("stored_fields", lambda ix: q.top(q.search(ix, T("segment")), 10).join(ix.docs.select("doc_id", "title", "source"), "doc_id").select("doc_id", "title", "source"),
          _sql(_cte(), _scores("term = 'segment'"), out="SELECT doc_id, title, source FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 10) JOIN documents USING (doc_id)"))
    plain("rescore_query", lambda ix: _rounded(H.rescore(ix, q.top(q.search(ix, T("query")), 50), T("results"), 0.7, 2.0)),
          _sql(_cte(), _scores("term = 'query'", name="s1"), _scores("term = 'results'", name="s2"), out="SELECT doc_id, round(0.7 * a.score + coalesce(2.0 * s2.score, 0), 6) AS score FROM (SELECT * FROM s1 ORDER BY score DESC, doc_id LIMIT 50) a LEFT JOIN s2 USING (doc_id)"))
    plain("rescore_sort", lambda ix: H.sort_hits(q.top(q.search(ix, T("query")), 50).join(ix.docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", "n_chars"), [H.number_key(F.col("n_chars"), True)], 10),
          _sql(_cte(), _scores("term = 'query'"), out="SELECT doc_id, n_chars FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 50) JOIN documents USING (doc_id) ORDER BY coalesce(n_chars, 0) DESC, doc_id LIMIT 10"))
    plain("federated", lambda ix: _rounded(q.search(ix, T("query")).unionByName(q.search(ix, q.Term("title", "query")).select((F.col("doc_id") + 10**9).alias("doc_id"), "score"))),
          _sql(_cte(), _cte("title", "a_"), _scores("term = 'query'", name="s1"), _scores("term = 'query'", p="a_", name="s2"), out="SELECT doc_id, round(score, 6) AS score FROM s1 UNION ALL SELECT doc_id + 1000000000, round(score, 6) FROM s2"))

    # aggregation over matches
    matched = lambda ix: q.search(ix, T("query"), scores=False).join(ix.docs, "doc_id")
    hit = f"documents WHERE doc_id IN ({_has('query')})"
    plain("agg_stats", lambda ix: H.stats(matched(ix), "n_chars").select("count", "min", "max", "sum", F.round("avg", 6).alias("avg")),
          _sql(_cte(), out=f"SELECT count(n_chars) AS count, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max, sum(n_chars)::DOUBLE AS sum, round(avg(n_chars), 6) AS avg FROM {hit}"))
    plain("agg_histogram", lambda ix: H.histogram(matched(ix), "n_chars", 100.0),
          _sql(_cte(), f"v AS (SELECT n_chars::DOUBLE AS v FROM {hit} AND n_chars IS NOT NULL)", "e AS (SELECT floor(min(v) / 100)::BIGINT AS f, max(v) AS hi FROM v)",
               "b AS (SELECT unnest(range(f, f + ceil((hi - f * 100) / 100)::BIGINT + 1)) AS b FROM e)",
               out="SELECT b * 100.0::DOUBLE AS bucket, count(v) AS count FROM b LEFT JOIN v ON floor(v / 100)::BIGINT = b GROUP BY b"))
    plain("facet_terms", lambda ix: H.facets(matched(ix), ["lang", "source"]),
          _sql(_cte(), f"m AS (SELECT lang, source FROM {hit})", out="SELECT field, value, count(*) AS count FROM (SELECT 'lang' AS field, lang AS value FROM m UNION ALL SELECT 'source', source FROM m) WHERE value <> '' GROUP BY ALL"))
    scored = lambda ix: q.search(ix, T("query")).join(ix.docs.select("doc_id", "source"), "doc_id")
    for name, least, order in (("collapse_top", False, "DESC"), ("collapse_min", True, "ASC")):
        plain(name, lambda ix, least=least: H.collapse(scored(ix), "source", least).select("group", "doc_id", F.round("score", 6).alias("score"), "hits"),
              _sql(_cte(), _scores("term = 'query'"), out=f"SELECT coalesce(source, '__null__') AS \"group\", doc_id, round(score, 6) AS score, count(*) OVER (PARTITION BY coalesce(source, '__null__')) AS hits FROM sc JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY coalesce(source, '__null__') ORDER BY score {order}, doc_id) = 1"))

    # suggestions, explanation, metrics
    plain("suggest_prefix", lambda ix: G.suggest(ix, "text", "se", 10), _sql(_cte(), out="SELECT term, df FROM dfs WHERE starts_with(term, 'se') ORDER BY df DESC, term LIMIT 10"))
    plain("suggest_context", lambda ix: G.suggest_within(ix, "text", "se", ix.docs.where("source = 'wiki'"), 10),
          _sql(_cte(), out="SELECT term, count(*) AS df FROM tfs JOIN documents USING (doc_id) WHERE starts_with(term, 'se') AND source = 'wiki' GROUP BY term ORDER BY df DESC, term LIMIT 10"))
    plain("suggest_next", lambda ix: G.suggest_next(ix, "text", "query", 8), _sql(_cte(), out=f"SELECT b.term, count(DISTINCT b.doc_id) AS hits FROM {pos('query', 'a')} JOIN post b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY b.term ORDER BY hits DESC, b.term LIMIT 8"))
    grams = "list_filter(list_transform(range(1, greatest(length(term) - 1, 1)), lambda i: substr(term, i, 3)), lambda g: list_contains(['seg', 'egm', 'gma', 'man', 'ant'], g))"
    plain("did_you_mean", lambda ix: G.did_you_mean(ix, "text", "segmant", 1).select("term", "df", "edits", F.round("score", 6).alias("score")),
          _sql(_cte(), out=f"SELECT term, df, levenshtein(term, 'segmant')::INT AS edits, round(df / (1.0 + levenshtein(term, 'segmant')), 6) AS score FROM dfs WHERE regexp_full_match(term, '[a-z0-9]+') AND term <> 'segmant' AND len({grams}) >= 2 AND levenshtein(term, 'segmant') <= 1 ORDER BY df / (1.0 + levenshtein(term, 'segmant')) DESC, term LIMIT 5"))
    plain("explain_term", lambda ix: H.explain_term(ix, "text", "segment", sim.bm25).select("doc_id", "tf", "dl", "df", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score")),
          _sql(_cte(), out=f"SELECT doc_id, tf, dl, df, round({_IDF}, 6) AS idf, round({BM25}, 6) AS score FROM \"all\" WHERE term = 'segment'"))
    plain("highlight", lambda ix: G.highlight(q.top(q.search(ix, T("segment")), 20).join(ix.docs.select("doc_id", "text"), "doc_id"), "text", ["segment"]).select("doc_id", "fragment"), None)
    pins = {i: i % 12 + 1 for i in range(3, 12)} | {10**12: 15}
    plain("rank_pin", lambda ix: H.pin(q.search(ix, T("query")), pins, 15).select("doc_id", F.col("rank").cast("long").alias("rank")),
          _sql(_cte(), _scores("term = 'query'"), "pins(doc_id, place) AS (VALUES " + ", ".join(f"({d}, {r})" for d, r in pins.items()) + ")",
               "fixed AS (SELECT doc_id, place AS rank FROM pins JOIN sc USING (doc_id))", "places AS (SELECT rank, row_number() OVER (ORDER BY rank) AS o FROM range(1, 40) t(rank) WHERE rank NOT IN (SELECT rank FROM fixed))",
               "free AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS o FROM sc WHERE doc_id NOT IN (SELECT doc_id FROM fixed))",
               out="SELECT doc_id, rank::BIGINT AS rank FROM (SELECT doc_id, rank FROM fixed UNION ALL SELECT doc_id, rank FROM free JOIN places USING (o)) WHERE rank <= 15"))
    plain("score_stage", lambda ix: _rounded(H.score_stage(q.top(q.search(ix, T("query")), 50).join(ix.docs.select("doc_id", "n_chars"), "doc_id"), F.col("n_chars") / 1000.0, "interpolate", 0.25)),
          _sql(_cte(), _scores("term = 'query'"), out="SELECT doc_id, round(0.75 * score + 0.25 * coalesce(n_chars / 1000.0::DOUBLE, 0), 6) AS score FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 50) JOIN documents USING (doc_id)"))

    def metrics(s, d):
        ix = documents_index(s, d)
        runs = None
        for i, t in enumerate(("query", "segment", "facet")):
            ranked = q.top(q.search(ix, T(t)), 10).select(F.lit(i).cast("long").alias("query_id"), "doc_id", F.expr("row_number() over (order by score desc, doc_id)").alias("rank"))
            runs = ranked if runs is None else runs.unionByName(ranked)
        judged = ix.docs.where("doc_id is not null").selectExpr("doc_id", "explode(array(0L, 1L, 2L)) as query_id").selectExpr("query_id", "doc_id", "cast((doc_id + query_id) % 4 as int) as grade")
        return H.ranking_metrics(runs, judged, 10).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ap", "ndcg")])

    run_sql = " UNION ALL ".join(f"SELECT {i} AS query_id, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, {BM25} AS score FROM \"all\" WHERE term = '{t}' ORDER BY score DESC, doc_id LIMIT 10)" for i, t in enumerate(("query", "segment", "facet")))
    metrics_sql = _sql(
        _cte(), f"run AS ({run_sql})", "j AS (SELECT query_id, doc_id, (doc_id + query_id) % 4 AS grade FROM (SELECT unnest([0, 1, 2]) AS query_id) CROSS JOIN (SELECT doc_id FROM documents))",
        "r AS (SELECT run.*, coalesce(grade, 0) AS g, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run.query_id ORDER BY rank) AS hits FROM run LEFT JOIN j USING (query_id, doc_id))",
        "a AS (SELECT query_id, count(*) FILTER (g > 0) AS rel, min(rank) FILTER (g > 0) AS first, sum(CASE WHEN g > 0 THEN hits / rank ELSE 0 END) AS ap, sum((pow(2, g) - 1) / log2(rank + 1)) AS dcg FROM r GROUP BY query_id)",
        "b AS (SELECT query_id, count(*) AS every, sum(CASE WHEN rk <= 10 THEN (pow(2, grade) - 1) / log2(rk + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS rk FROM j WHERE grade > 0) GROUP BY query_id)",
        out="SELECT query_id::BIGINT AS query_id, round(rel / 10, 6) AS precision, round(rel / every, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS rr, round(ap / every, 6) AS ap, round(dcg / idcg, 6) AS ndcg FROM a JOIN b USING (query_id)")
    reg.add("rank_metrics", metrics, metrics_sql)
