"""Ranking profiles: a first query, stages that rank its best candidates again, and rules for single requests.

A stage works on the ``budget`` best candidates and leaves the others behind them in their order, so each stage is a
top-n and not a sort of all hits. Rules that fit a request change its candidates (a filter), their scores (a factor for
some documents) or their places (pins), in the order of priority.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import hits as H
from corpusloom.plans.query import Query, search
from corpusloom.sources.index import Index


@dataclass(frozen=True)
class Function:
    """Combine the score with a value of stored columns; mode "order" only sorts by the value and keeps the score."""

    name: str
    value: Callable[[], Column]
    mode: str = "add"
    budget: int = 100
    weight: float = 0.5


@dataclass(frozen=True)
class Rescore:
    name: str
    query: Query
    budget: int = 100
    first: float = 1.0
    second: float = 1.0


def request_key(text: str | None) -> str:
    """A request's text in one form: compatibility characters resolved, lower case, single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text or "").split()).lower()


@dataclass(frozen=True)
class Rule:
    """What to do with requests that match: keep only what a query matches, multiply scores of documents, pin documents.

    request, locale and tags are conditions; None and empty hold for all. A rule holds from ``starts`` until ``ends``.
    """

    id: str
    priority: int = 0
    request: str | None = None
    locale: str | None = None
    tags: frozenset[str] = frozenset()
    starts: datetime | None = None
    ends: datetime | None = None
    only: Query | None = None
    factors: dict[int, float] = field(default_factory=dict)
    pins: dict[int, int] = field(default_factory=dict)

    def holds(self, request: str, locale: str | None, tags: frozenset[str], now: datetime) -> bool:
        inside = (self.starts is None or self.starts <= now) and (self.ends is None or now < self.ends)
        fits = (self.request is None or request_key(self.request) == request_key(request)) and (self.locale is None or self.locale == locale)
        return inside and fits and self.tags <= tags


@dataclass(frozen=True)
class Profile:
    name: str
    version: str
    stages: tuple[Function | Rescore, ...] = ()
    similarity: str = "bm25"

    def fingerprint(self) -> str:
        return H.fingerprint(self)


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("tier", F.desc("key"), "doc_id").limit(n)


def rank(index: Index, query: Query, profile: Profile, n: int = 10, rules: Sequence[Rule] = (), request: str = "", locale: str | None = None, tags: frozenset[str] = frozenset(), now: datetime | None = None) -> DataFrame:
    """(doc_id, score, rank) of the first n. Stages see the stored columns as ``doc``."""
    now = now or datetime.now()
    active = sorted((r for r in rules if r.holds(request, locale, tags, now)), key=lambda r: (-r.priority, r.id))
    found = search(index, query, profile.similarity)
    pins: dict[int, int] = {}
    for r in active:
        if r.only is not None:
            found = found.join(search(index, r.only, scores=False), "doc_id", "left_semi")
        if r.factors:
            by = F.create_map(*[F.lit(x) for k, v in r.factors.items() for x in (int(k), float(v))])
            found = found.withColumn("score", F.col("score") * F.coalesce(F.try_element_at(by, F.col("doc_id").cast("int")), F.lit(1.0)))
        for d, at in r.pins.items():
            if d not in pins and at not in pins.values():  # the higher priority has the place
                pins[d] = at
    widest = max([n + len(pins), *(s.budget for s in profile.stages)])
    rows = _ranked(found.select("doc_id", "score", F.lit(0).alias("tier"), F.col("score").alias("key")), widest)
    if pins:  # pinned candidates take part however low they stand
        rows = rows.unionByName(found.where(F.col("doc_id").isin(*pins)).select("doc_id", "score", F.lit(1).alias("tier"), F.col("score").alias("key"))).dropDuplicates(["doc_id"])
    for s in profile.stages:
        best, rest = _split(rows, s.budget)
        if isinstance(s, Rescore):
            again = H.rescore(index, best.select("doc_id", "score"), s.query, s.first, s.second, profile.similarity)
            again = again.withColumn("key", F.col("score"))
        else:
            doc = best.join(index.docs.select("doc_id", F.struct("*").alias("doc")), "doc_id")
            value = F.coalesce(s.value().cast("double"), F.lit(0.0))
            again = doc.withColumn("key", value) if s.mode == "order" else H.score_stage(doc, value, s.mode, s.weight).withColumn("key", F.col("score"))
        rows = again.select("doc_id", "score", F.lit(0).alias("tier"), "key").unionByName(rest.withColumn("tier", F.lit(1)))
    order = "row_number() over (order by tier, key desc, doc_id)"
    first = _ranked(rows, widest)  # a top list, so numbering it takes one task
    if not pins:
        return _ranked(first, n).withColumn("rank", F.expr(order)).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))
    placed = H.pin(first.select("doc_id", (-F.expr(order)).cast("double").alias("score")), pins, n)
    return placed.join(first.select("doc_id", "score"), "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _split(rows: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("at", F.expr("row_number() over (order by tier, key desc, doc_id)"))
    return marked.where(F.col("at") <= budget).drop("at"), marked.where(F.col("at") > budget).drop("at")


def feature_log(ranked: DataFrame, features: dict[str, Column], request: str, profile: Profile, version: str = "1") -> DataFrame:
    """One row for each feature of each shown document; null and NaN are written as null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature_name"), F.when(~F.isnan(v.cast("double")), v.cast("double")).alias("feature_value")) for k, v in features.items()])
    rows = ranked.select("doc_id", F.col("rank").alias("shown_rank"), F.explode(pairs).alias("f"))
    return rows.select(F.lit(request).alias("request_identity"), "doc_id", "shown_rank", F.lit(profile.fingerprint()).alias("profile_fingerprint"), F.lit(version).alias("schema_version"), "f.feature_name", "f.feature_value")
