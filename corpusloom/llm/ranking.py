"""One ranking from scores of different scales, by distance to an ideal point.

Within a request each score is turned so that more is better, winsorised at two quantiles, measured from its mean, and
divided by the length of its vector over the candidates (the root of the mean square, so that the number of candidates
that have the score doesn't matter). The ideal point has the best value of every score, the anti-ideal the
worst. Distances to both are weighted (all scores alike, if no weights are given) and candidates are sorted by relative
closeness, worst / (best + worst), ties by document_identity.

The length is what makes scores comparable: it takes range and unit out, as measuring from the mean takes the offset
out and winsorising the tails. It isn't the range: of two scores with one range, that in which few candidates
stand out tells these more apart than that in which half of all candidates are near the best.

Quantiles are sketches and all sums combine before the shuffle, so a request with a third of the rows is aggregated in
parallel; joins back are on (request, score), where adaptive execution splits a hot key. Ranks of whole requests are
counted over sorted ranges of rows, so a large request is spread over tasks; the first n need no such thing, as the limit
is applied before the shuffle.

Defined cases: null, NaN and infinite values are missing, and a missing score says nothing about its candidate: the
distances are means over the scores present. A score that is constant within a request says nothing about anyone. A
candidate without any score comes last. Rows that stand twice count once (of different values the greatest). A feature
that isn't in the catalogue counts as better when higher. Rows without request or document are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import written

RELEVANCE = "relevance"


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def candidate_scores(features: DataFrame, selections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(request_identity, document_identity, score, value): the scores in use, more being better; null where missing."""
    direction = catalogue.groupBy("feature_name").agg(F.max("higher_is_better").alias("up"))
    used = features.where("used_for_scoring and feature_name is not null").select("request_identity", "document_identity", "feature_name", "feature_value")
    value = _finite(F.col("feature_value"))
    turned = used.join(direction, "feature_name", "left").select(
        "request_identity", "document_identity", F.concat(F.lit("f:"), "feature_name").alias("score"), F.when(F.coalesce("up", F.lit(True)), value).otherwise(-value).alias("value")
    )
    relevance = selections.select("request_identity", "document_identity", F.lit(RELEVANCE).alias("score"), _finite(F.col("relevance")).alias("value"))
    return (
        turned.unionByName(relevance)
        .where("request_identity is not null and document_identity is not null")
        .groupBy("request_identity", "document_identity", "score")
        .agg(F.max("value").alias("value"))
    )


def closeness(scores: DataFrame, *, tail: float = 0.05, accuracy: int = 10_000, weights: dict[str, float] | None = None) -> DataFrame:
    """(request_identity, document_identity, closeness) of every candidate of ``candidate_scores``; 0 without any score."""
    by = ["request_identity", "score"]
    bounds = scores.groupBy(*by).agg(F.percentile_approx("value", [tail, 1 - tail], accuracy).alias("q"))
    low, high = F.element_at("q", 1), F.element_at("q", 2)
    clipped = scores.join(bounds, by).select(*by, "document_identity", F.when(F.col("value").isNotNull(), F.greatest(low, F.least("value", high))).alias("value"))
    lengths = clipped.groupBy(*by).agg(F.stddev_pop("value").alias("length"), F.avg("value").alias("mean"), F.max("value").alias("top"), F.min("value").alias("bottom"))
    # a constant score has no length: it is null here and takes no part in the means
    normed = clipped.join(lengths, by)
    length = F.when((F.col("length") > 0) & (F.col("top") > F.col("bottom")), F.col("length"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("score")], F.lit(1.0)) if weights else F.lit(1.0)
    here, best, worst = ((F.col(c) - F.col("mean")) / length for c in ("value", "top", "bottom"))
    counted = F.sum(F.when(here.isNotNull(), weight))
    toward = lambda point: F.sqrt(F.sum(weight * F.pow(here - point, 2)) / counted)
    distances = normed.groupBy("request_identity", "document_identity").agg(toward(best).alias("from_best"), toward(worst).alias("from_worst"))
    both = F.col("from_best") + F.col("from_worst")
    return distances.select("request_identity", "document_identity", F.when(both > 0, F.col("from_worst") / both).when(F.coalesce(both == 0, F.lit(False)), 0.5).otherwise(F.lit(0.0)).alias("closeness"))


def ideal_point_ranking(scores: DataFrame, **options) -> DataFrame:
    """(request_identity, document_identity, closeness, rank) of every candidate.

    Rows are sorted in ranges over all tasks and numbered in place; the place of a request's first row in each range then
    gives the ranks, so no task holds a whole request.
    """
    rows = closeness(scores, **options)
    order = [F.asc("request_identity"), F.desc("closeness"), F.asc("document_identity")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranking")
    part = F.shiftrightunsigned("at", 33)
    runs = placed.groupBy("request_identity", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("request_identity").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each request and range
    starts = runs.select("request_identity", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.withColumn("part", part).join(starts, ["request_identity", "part"])
    return ranked.select("request_identity", "document_identity", "closeness", (F.col("before") + F.col("at") - F.col("first") + 1).alias("rank"))


def first_candidates(scores: DataFrame, n: int = 3, **options) -> DataFrame:
    """(request_identity, document_identity, closeness, rank) of the first n; the limit is applied before the shuffle."""
    rank = F.expr("row_number() over (partition by request_identity order by closeness desc, document_identity)")
    return closeness(scores, **options).withColumn("rank", rank).where(F.col("rank") <= n)
