"""Suggestions, spelling, highlighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.index import Index


def suggest(index: Index, field: str, prefix: str, n: int) -> DataFrame:
    """(term, df): the most frequent terms with a prefix; ties by term."""
    rows = index.term_stats.where((F.col("field") == field) & F.col("term").startswith(prefix))
    return rows.select("term", "df").orderBy(F.desc("df"), "term").limit(n)


def suggest_within(index: Index, field: str, prefix: str, context: DataFrame, n: int) -> DataFrame:
    """The same, documents counted only within a context (doc_id)."""
    rows = index.postings.where((F.col("field") == field) & F.col("term").startswith(prefix)).select("term", "doc_id")
    return rows.join(context.select("doc_id"), "doc_id", "left_semi").groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(n)


def suggest_next(index: Index, field: str, term: str, n: int) -> DataFrame:
    """(term, hits): the terms that most often follow a given one, by the number of documents; ties by term."""
    here = index.postings.where(F.col("field") == field)
    starts = here.where(F.col("term") == term).select("doc_id", F.col("positions").alias("first"))
    after = here.join(starts, "doc_id").where(F.exists("first", lambda x: F.array_contains("positions", x + 1)))
    return after.groupBy("term").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "term").limit(n)


def trigrams(word: Column) -> Column:
    """A word's trigrams, repeats kept; none for a shorter word."""
    n = F.length(word)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(word, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def did_you_mean(index: Index, field: str, term: str, max_edits: int = 2, n: int = 5) -> DataFrame:
    """(term, df, edits, score): near terms by df / (1 + edits), the term itself left out.

    A term qualifies if it shares max(1, t - 3 * max_edits) of the query's t trigrams, repeats counted.
    """
    grams = [term[i : i + 3] for i in range(len(term) - 2)]
    edits = F.levenshtein(F.col("term"), F.lit(term), max_edits)
    rows = index.term_stats.where((F.col("field") == field) & (F.col("term") != term) & F.length("term").between(len(term) - max_edits, len(term) + max_edits))
    if grams:
        shared = F.size(F.filter(trigrams(F.col("term")), lambda g: g.isin(*grams)))
        rows = rows.where(shared >= max(1, len(grams) - 3 * max_edits))
    near = rows.withColumn("edits", edits).where("edits >= 0")
    return near.select("term", "df", "edits", (F.col("df") / (1 + F.col("edits"))).alias("score")).orderBy(F.desc("score"), "term").limit(n)


def highlight(hits: DataFrame, text: str, terms: list[str], length: int = 100, pre: str = "<b>", post: str = "</b>") -> DataFrame:
    """The hits with a column ``fragment``: the window with most matches of the terms, each marked.

    Matches are whole words in any letter case. A window begins a quarter of its length before a match. For a page of
    results; texts without a match give their start. Null texts give null.
    """
    import pandas as pd
    import regex

    found = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, terms)) + r")(?![\p{L}\p{N}])", regex.I)

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        spans = [m.span() for m in found.finditer(s)]
        starts = [max(0, a - length // 4) for a, _ in spans] or [0]
        best = max(starts, key=lambda b: (sum(b <= x and y <= b + length for x, y in spans), -b))
        piece = found.sub(lambda m: f"{pre}{m.group(0)}{post}", s[best : best + length])
        return ("..." if best else "") + piece + ("..." if best + length < len(s) else "")

    mark = F.pandas_udf(lambda column: pd.Series([one(s) for s in column], dtype=object), "string")
    return hits.withColumn("fragment", mark(F.col(text)))
