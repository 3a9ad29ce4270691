"""Operators on search hits (doc_id, score): order, paging, aggregation, grouping, rescoring, ranking rules, evaluation."""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import hmac
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.query import Query, search
from corpusloom.sources.index import Index

Key = tuple[Column, bool]


def number_key(column: Column, descending: bool = False) -> Key:
    """Sort by a number; missing counts as 0."""
    return F.coalesce(column, F.lit(0)), descending


def text_key(column: Column, descending: bool = False) -> Key:
    """Sort by a string in byte order; missing counts as ''."""
    return F.coalesce(column, F.lit("")), descending


def sort_hits(rows: DataFrame, keys: Sequence[Key], n: int) -> DataFrame:
    """The first n by the keys, then doc_id; a top-n, not a full sort."""
    return rows.orderBy(*[c.desc() if d else c.asc() for c, d in keys], "doc_id").limit(n)


def search_after(rows: DataFrame, keys: Sequence[Key], after: Sequence, n: int) -> DataFrame:
    """The n rows behind a position: the key values and doc_id of the last row seen."""
    columns = [*keys, (F.col("doc_id"), False)]
    behind, equal = F.lit(False), F.lit(True)
    for (c, descending), v in zip(columns, after):
        behind = behind | (equal & (c < F.lit(v) if descending else c > F.lit(v)))
        equal = equal & (c == F.lit(v))
    return sort_hits(rows.where(behind), keys, n)


def sign_cursor(position: Sequence, fingerprint: str, secret: bytes) -> str:
    """An opaque cursor: position and query fingerprint, with an HMAC-SHA256."""
    body = json.dumps([list(position), fingerprint]).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def read_cursor(cursor: str, fingerprint: str, secret: bytes) -> list:
    """The position of a cursor; raises ValueError for a forged one or one of another query."""
    raw = base64.urlsafe_b64decode(cursor)
    if not hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()):
        raise ValueError("the cursor's signature doesn't hold")
    position, of = json.loads(raw[32:])
    if of != fingerprint:
        raise ValueError("the cursor belongs to another query")
    return position


def fingerprint(query: Query) -> str:
    """Identity of a query by its value: the same in every process. Functions count by their code and what they hold."""
    return hashlib.sha256(_value(query).encode()).hexdigest()


def _value(x) -> str:
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return f"{type(x).__name__}({', '.join(f'{f.name}={_value(getattr(x, f.name))}' for f in dataclasses.fields(x))})"
    if isinstance(x, dict):
        return "{" + ", ".join(sorted(f"{_value(k)}: {_value(v)}" for k, v in x.items())) + "}"
    if isinstance(x, (set, frozenset)):
        return "{" + ", ".join(sorted(map(_value, x))) + "}"
    if isinstance(x, (list, tuple)):
        return "(" + ", ".join(map(_value, x)) + ")"
    code = getattr(x, "__code__", None)
    if code is not None:
        held = [c.cell_contents for c in x.__closure__ or ()]
        return f"function({code.co_code.hex()}, {_value([c for c in code.co_consts if not hasattr(c, 'co_code')])}, {[c.co_code.hex() for c in code.co_consts if hasattr(c, 'co_code')]}, {code.co_names}, {_value(held)}, {_value(x.__defaults__ or ())})"
    return repr(x)


# aggregation


def stats(values: DataFrame, column: str) -> DataFrame:
    """(count, min, max, sum, avg); zeros if there is no value. Arrays count by value."""
    if values.schema[column].dataType.typeName() == "array":
        values = values.select(F.explode(column).alias(column))
    v = F.col(column).cast("double")
    zero = F.lit(0.0)
    return values.agg(
        F.count(v).alias("count"), F.coalesce(F.min(v), zero).alias("min"), F.coalesce(F.max(v), zero).alias("max"), F.coalesce(F.sum(v), zero).alias("sum"), F.coalesce(F.avg(v), zero).alias("avg")
    )


def histogram(values: DataFrame, column: str, interval: float = 10.0) -> DataFrame:
    """(bucket, count): dense from floor(min / interval), empty buckets included, the last one possibly empty."""
    interval = interval if interval > 0 else 10.0
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    counts = v.groupBy(F.floor(F.col("v") / interval).alias("b")).agg(F.count("*").alias("count"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = counts.agg(F.min("b").alias("first"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("first is not null")
    start = F.col("first") * interval
    last = F.col("first") + F.ceil((F.col("hi") - start) / interval)
    every = ends.select(F.explode(F.sequence(F.col("first"), last)).alias("b"))
    return every.join(counts.select("b", "count"), "b", "left").select((F.col("b") * interval).alias("bucket"), F.coalesce("count", F.lit(0)).alias("count"))


def facets(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, count) of each column; arrays count by value, empty strings and nulls not at all."""
    lists = []
    for c in columns:  # one pass over the hits, whatever the number of columns
        v = F.col(c) if values.schema[c].dataType.typeName() == "array" else F.array(c)
        name = F.lit(c).alias("field")
        lists.append(F.transform(v.cast("array<string>"), lambda x: F.struct(name, x.alias("value"))))  # noqa: B023
    pairs = values.select(F.explode(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<field:string,value:string>>")) for x in lists]))).alias("p"))
    return pairs.select("p.field", "p.value").where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("count"))


def collapse(rows: DataFrame, key: str, by_least: bool = False) -> DataFrame:
    """The best hit of each key: greatest score (or least), then lowest doc_id. A missing key is a group of its own.

    An aggregation, not a window: it combines before the shuffle, so a key with most of the hits is no hot spot.
    """
    group = F.coalesce(F.col(key).cast("string"), F.lit("__null__"))
    order = F.struct((F.col("score") if by_least else -F.col("score")).alias("o"), F.col("doc_id").alias("doc_id"))
    best = rows.groupBy(group.alias("group")).agg(F.min(order).alias("best"), F.count("*").alias("hits"))
    return best.select("group", F.col("best.doc_id").alias("doc_id"), (F.col("best.o") if by_least else -F.col("best.o")).alias("score"), "hits")


# rescoring and ranking rules


def rescore(index: Index, hits: DataFrame, query: Query, first: float = 1.0, second: float = 1.0, similarity="bm25") -> DataFrame:
    """first * score, plus second * the other query's score where it matches."""
    other = search(index, query, similarity).withColumnRenamed("score", "other")
    return hits.join(other, "doc_id", "left").select("doc_id", (first * F.col("score") + F.coalesce(second * F.col("other"), F.lit(0.0))).alias("score"))


def score_stage(rows: DataFrame, value: Column, mode: str, weight: float = 0.5) -> DataFrame:
    """Combine the score with a value: replace, add, multiply or interpolate."""
    s, v = F.col("score"), F.coalesce(value.cast("double"), F.lit(0.0))
    return rows.withColumn("score", {"replace": v, "add": s + v, "multiply": s * v, "interpolate": (1 - weight) * s + weight * v}[mode])


def pin(hits: DataFrame, pins: dict[int, int], n: int) -> DataFrame:
    """(doc_id, rank): pinned documents (id -> place from 1) at their places if they are candidates, the others around them.

    Only the n best of the others can have a place, and only these are numbered.
    """
    place = F.create_map(*[F.lit(x).cast("long") for kv in pins.items() for x in kv]) if pins else F.lit(None)
    marked = hits.withColumn("place", F.try_element_at(place, F.col("doc_id")) if pins else F.lit(None).cast("long"))
    fixed = marked.where("place is not null").select("doc_id", F.col("place").alias("rank"))
    taken = sorted(set(pins.values()))
    order = F.expr("row_number() over (order by score desc, doc_id)")
    free = marked.where("place is null").orderBy(F.desc("score"), "doc_id").limit(n).withColumn("o", order.cast("long"))
    present = fixed.agg(F.array_sort(F.coalesce(F.collect_set("rank"), F.array().cast("array<bigint>"))).alias("taken"))  # as many as there are pins
    # the o-th free place: o, moved up by each taken place at or below it
    moved = F.aggregate("taken", F.col("o"), lambda r, t: F.when(t <= r, r + 1).otherwise(r))
    rest = free.join(F.broadcast(present)).select("doc_id", moved.alias("rank")) if taken else free.select("doc_id", F.col("o").alias("rank"))
    return fixed.unionByName(rest).where(F.col("rank") <= n)


# evaluation


def ranking_metrics(run: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, rr, ap, ndcg) of run (query_id, doc_id, rank from 1) against judged (query_id, doc_id, grade)."""
    rel = F.coalesce("grade", F.lit(0)) > 0
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    log2 = lambda r: F.log(r + 1) / F.log(F.lit(2.0))
    rows = run.where(F.col("rank") <= k).join(judged, ["query_id", "doc_id"], "left")
    seen = rows.withColumn("hits", F.expr("count(case when grade > 0 then 1 end) over (partition by query_id order by rank)"))
    found = seen.groupBy("query_id").agg(
        F.count(F.when(rel, 1)).alias("relevant"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
        F.sum(F.when(rel, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(gain(F.coalesce("grade", F.lit(0))) / log2(F.col("rank"))).alias("dcg"),
    )
    ideal_rank = F.expr("row_number() over (partition by query_id order by grade desc, doc_id)")
    best = judged.where("grade > 0").withColumn("r", ideal_rank)
    # the window is cut to the first k before the shuffle; how many there are in all is a count
    ideal = best.where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade")) / log2(F.col("r"))).alias("idcg"))
    counts = judged.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("all"))
    both = found.join(ideal, "query_id", "left").join(counts, "query_id", "left")
    part = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    return both.select(
        "query_id",
        (F.col("relevant") / k).alias("precision"),
        part(F.col("relevant"), F.col("all")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        part(F.col("ap_sum"), F.col("all")).alias("ap"),
        part(F.col("dcg"), F.col("idcg")).alias("ndcg"),
    )


def mmr(candidates: DataFrame, n: int, weight: float = 0.7) -> DataFrame:
    """(query_id, doc_id, pick): greedy selection by weight * relevance - (1 - weight) * greatest similarity to the picked.

    candidates: (query_id, doc_id, relevance, vector), a bounded list for each query (a top-k); one task for a query.
    """
    import numpy as np
    import pandas as pd

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        x = np.stack(pdf.vector.to_numpy()).astype(float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
        near, left, out = np.zeros(len(x)), np.ones(len(x), bool), []
        for _ in range(min(n, len(x))):
            gain = np.where(left, weight * pdf.relevance.to_numpy() - (1 - weight) * near, -np.inf)
            i = int(np.argmax(gain))
            left[i] = False
            out.append(i)
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"query_id": pdf.query_id.iloc[out].to_numpy(), "doc_id": pdf.doc_id.iloc[out].to_numpy(), "pick": range(1, len(out) + 1)})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, pick int")


def explain_term(index: Index, field: str, term: str, similarity: Callable) -> DataFrame:
    """(doc_id, tf, dl, df, idf, score) of each document with the term."""
    from corpusloom.functions.similarity import Stats

    df, cf = index.term_info(field, [term]).get(term, (0, 0))
    f = index.field(field)
    s = Stats(F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(float(df)), F.lit(float(cf)), f.n_docs, f.avgdl, f.sum_len)
    rows = index.postings.where((F.col("field") == field) & (F.col("term") == term))
    return rows.select("doc_id", "tf", "dl", F.lit(df).cast("long").alias("df"), s.idf.alias("idf"), similarity(s).alias("score"))
