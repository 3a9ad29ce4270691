"""Queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import mixing, neighbours, ranking, residue, tokens
from corpusloom.plans.registry import Registry, table
from corpusloom.sources.shared import spread, written

PAIRS = neighbours.Search(k=10, min_cosine=0.9)
#: One vector in a hundred is looked up here, so each may visit far more leaves, and every shard of its field.
KNN = neighbours.Search(k=10, probes=400, routes=None)


def _documents(s, d):
    """The corpus, read by as many tasks as there are cores even if it is one small file."""
    return spread(table(s, d, "documents"))


def register(reg: Registry) -> None:
    """Add this module's queries."""

    def p1_found(s, d):
        return neighbours.similar_pairs(table(s, d, "vector_queries"), table(s, d, "index_fields"), PAIRS)

    def p1_knn(s, d):
        found = neighbours.links(table(s, d, "vector_queries"), table(s, d, "index_fields"), KNN, "query_id % 100 = 0")
        return found.select("query_id", "neighbour_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))

    reg.add("p1_found", p1_found)
    reg.add("p1_knn", p1_knn)

    def p3_scores(s, d):
        return ranking.candidate_scores(table(s, d, "ranking_features"), table(s, d, "mmr_selections"), table(s, d, "feature_catalogue"))

    reg.add("p3_found", lambda s, d: ranking.first_candidates(p3_scores(s, d)).select("request_identity", "document_identity"))

    def p3_ranking(s, d):
        rows = ranking.ideal_point_ranking(p3_scores(s, d))
        return rows.select("request_identity", "document_identity", F.col("rank").cast("long").alias("rank"), F.round("closeness", 6).alias("closeness"))

    reg.add("p3_ranking", p3_ranking)

    reg.add("p6_ids", lambda s, d: tokens.encode(_documents(s, d)))
    reg.add("p7_found", lambda s, d: mixing.unreachable(tokens.count_tokens(_documents(s, d)), table(s, d, "mix_targets")))

    def p7_parts(s, d):
        counts = written(tokens.count_tokens(_documents(s, d)), "token-counts")
        return counts, mixing.source_rates(counts, table(s, d, "mix_targets"))

    reg.add("p7_mix", lambda s, d: mixing.mix(*p7_parts(s, d)))
    reg.add("p7_shares", lambda s, d: mixing.reached_shares(*p7_parts(s, d)))

    reg.add("p8_found", lambda s, d: residue.residue_documents(_documents(s, d)))
    reg.add("p8_clean", lambda s, d: residue.without_residue(_documents(s, d)).select("doc_id", "source", "lang"))

    def p8_templates(s, d):
        return residue.templates(_documents(s, d)).withColumn("company", F.round("company", 6))

    reg.add("p8_templates", p8_templates)
