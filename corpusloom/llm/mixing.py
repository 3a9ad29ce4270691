"""Mixing sources to target shares of all tokens.

Tokens are summed by source (combined before the shuffle, so a hot source costs a row a task), and give each source a
rate: target_share * total / its tokens, at most max_repeats, where total counts the tokens of all documents whose
source has a target once. A document is then emitted floor(rate) times, and once more with a probability of the
fraction, drawn by hashing its id with the seed: no state, no shuffle, and the same draw on every run and cluster.

Defined cases: documents without a source, or with one that has no target, aren't mixed. A source of which there is no
token has rate max_repeats and cannot reach a positive share. Empty and null texts have no tokens and are emitted like
others of their source. Without max_repeats a source isn't capped. Targets that stand twice count once (the greatest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _targets(targets: DataFrame) -> DataFrame:
    return targets.where("source is not null and target_share is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def source_rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, documents, total, rate, reachable), a row for each target."""
    sums = counts.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = _targets(targets).join(sums, "source", "left").fillna(0, ["tokens", "documents"])
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))  # one row
    wanted = F.col("target_share") * F.col("total")
    cap = F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf")))
    rate = F.when(F.col("tokens") > 0, F.least(cap, wanted / F.col("tokens"))).otherwise(F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0)))
    return (
        rows.join(F.broadcast(total))
        .withColumn("rate", rate)
        .withColumn("reachable", F.when(F.col("tokens") == 0, wanted <= 0).otherwise(F.col("tokens") * cap >= wanted))
    )


def unreachable(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source) of the targets for which even max_repeats copies of every text fall short."""
    return source_rates(counts, targets).where("not reachable").select("source")


def mix(counts: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, copy, n_tokens): the mixture, copies numbered from 1."""
    draw = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    floor = F.floor("rate").cast("int")
    copies = floor + (draw < F.col("rate") - floor).cast("int")
    rows = counts.join(rates.select("source", "rate"), "source").withColumn("copies", copies).where("copies > 0")
    return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")


def reached_shares(counts: DataFrame, rates: DataFrame, seed: int = 1) -> DataFrame:
    """(source, target_share, rate, copies, tokens, share): what the mixture really holds."""
    mixed = mix(counts, rates, seed).groupBy("source").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("mixed_tokens"))
    rows = rates.select("source", "target_share", "rate").join(mixed, "source", "left").fillna(0, ["copies", "mixed_tokens"])
    total = rows.agg(F.sum("mixed_tokens").alias("mixed_total"))
    share = F.when(F.col("mixed_total") > 0, F.col("mixed_tokens") / F.col("mixed_total")).otherwise(0.0)
    return rows.join(F.broadcast(total)).select("source", "target_share", F.round("rate", 9).alias("rate"), "copies", F.col("mixed_tokens").alias("tokens"), F.round(share, 9).alias("share"))
