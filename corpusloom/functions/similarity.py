"""Ten relevance formulas as column expressions over the statistics of a posting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """Columns or numbers: occurrences in the document, its length, documents and occurrences of the term, and of the field."""

    tf: Column
    dl: Column
    df: Column
    cf: Column
    n: float
    avgdl: float
    sum_len: float

    @property
    def idf(self) -> Column:
        return F.log(1 + (F.lit(float(self.n)) - self.df + 0.5) / (self.df + 0.5))

    @property
    def idf_classic(self) -> Column:
        return 1 + F.log(F.lit(float(self.n)) / (self.df + 1))

    @property
    def p(self) -> Column:
        return self.cf / F.lit(max(float(self.sum_len), 1.0))

    @property
    def rel(self) -> Column:
        """Length over mean length; 1 in a field without tokens."""
        return self.dl / F.lit(self.avgdl) if self.avgdl > 0 else F.lit(1.0)


def _saturated(s: Stats, k1: float, b: float) -> Column:
    return s.tf * (k1 + 1) / (s.tf + k1 * (1 - b + b * s.rel))


def bm25(s: Stats, k1: float = 1.2, b: float = 0.75) -> Column:
    return s.idf * _saturated(s, k1, b)


def bm25_plus(s: Stats, k1: float = 1.2, b: float = 0.75, delta: float = 1.0) -> Column:
    return s.idf * (_saturated(s, k1, b) + delta)


def bm25_l(s: Stats, k1: float = 1.2, b: float = 0.75, delta: float = 0.5) -> Column:
    return s.idf * (_saturated(s, k1, b) + delta * s.tf / (1 + s.tf))


def tf_idf(s: Stats) -> Column:
    return F.sqrt(s.tf) * s.idf_classic / F.sqrt(s.dl)


def tf_idf_augmented(s: Stats, k: float = 0.5) -> Column:
    return (k + (1 - k) * s.tf / (s.tf + k)) * s.idf_classic / F.sqrt(s.dl)


def tf_idf_double(s: Stats, k: float = 0.5, slope: float = 0.2) -> Column:
    return (k + (1 - k) * s.tf / (s.tf + k)) * s.idf_classic / ((1 - slope) + slope * s.rel)


def tf_idf_pivoted(s: Stats, slope: float = 0.2) -> Column:
    return F.sqrt(s.tf) * s.idf_classic / ((1 - slope) + slope * s.rel)


def dirichlet(s: Stats, mu: float = 2000.0) -> Column:
    return F.log((s.tf + mu * s.p) / (s.dl + mu))


def jelinek_mercer(s: Stats, weight: float = 0.1) -> Column:
    return F.log((1 - weight) * s.tf / s.dl + weight * s.p)


def absolute_discount(s: Stats, d: float = 0.7) -> Column:
    return F.log((F.greatest(s.tf - d, F.lit(0.0)) + d * s.dl * s.p) / s.dl)


SIMILARITIES = {
    "bm25": bm25,
    "bm25plus": bm25_plus,
    "bm25l": bm25_l,
    "tfidf": tf_idf,
    "tfidf_aug": tf_idf_augmented,
    "tfidf_double": tf_idf_double,
    "tfidf_pivoted": tf_idf_pivoted,
    "dirichlet": dirichlet,
    "jm": jelinek_mercer,
    "absdisc": absolute_discount,
}
