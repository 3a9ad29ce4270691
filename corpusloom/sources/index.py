"""A search index as Parquet tables.

    docs        doc_id and the stored columns
    postings    field, term, doc_id, tf, positions, dl; one folder for each field, sorted by term within it
    term_stats  field, term, df, cf; laid out like postings
    fields      field, n_docs, sum_len (a row for each field)

A term lookup prunes to the field's folder and skips row groups by the least and greatest term of each. Postings are
range partitioned by (term, doc_id), so a term that every document holds spreads over many files. N counts all
documents, the mean length too; a document without tokens has length 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.analysis import Tokens
from corpusloom.sources.shared import delete, scratch_path, spread

POSTINGS = "term string, doc_id long, tf long, positions array<int>, dl long, field string"
TERM_STATS = "term string, df long, cf long, field string"


@dataclass(frozen=True)
class FieldStats:
    n_docs: int
    sum_len: int

    @property
    def avgdl(self) -> float:
        return self.sum_len / self.n_docs if self.n_docs else 0.0


@dataclass(frozen=True)
class Index:
    """An open index. stats has a row for each field, read once."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    stats: dict[str, FieldStats]
    #: field -> (stored column, analyser), where the index was opened with them
    sources: dict[str, tuple[str, Tokens]] = field(default_factory=dict)

    def field(self, name: str) -> FieldStats:
        return self.stats.get(name, FieldStats(0, 0))

    def term_info(self, field: str, terms: list[str]) -> dict[str, tuple[int, int]]:
        """(df, cf) of a query's own terms: as many rows as the query has terms."""
        rows = self.term_stats.where((F.col("field") == field) & F.col("term").isin(*terms)).collect() if terms else []
        return {r.term: (r.df, r.cf) for r in rows}


_ROWS = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32())), ("dl", pa.int64()), ("field", pa.string())])
_BLOCK = 1 << 16


def _group_tokens(names: list[str]):
    """Arrow function: (doc_id, tokens of each field) to postings. A document is one row, so nothing is shuffled."""

    def run(batches):
        out: list[list] = [[] for _ in _ROWS]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for name, column in zip(names, batch.columns[1:]):
                # a document's tokens at a time, so that no more than one is held as Python values
                for doc, tokens in zip(ids, column):
                    tokens = tokens.as_py()
                    if not tokens:
                        continue
                    at: dict[str, list[int]] = {}
                    for i, t in enumerate(tokens):
                        if t is not None:
                            at.setdefault(t, []).append(i)
                    for c, values in zip(out, (at.keys(), [doc] * len(at), map(len, at.values()), at.values(), [len(tokens)] * len(at), [name] * len(at))):
                        c.extend(values)
                    if len(out[0]) >= _BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)
                        out = [[] for _ in _ROWS]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _ROWS)], schema=_ROWS)

    return run


def postings_of(docs: DataFrame, fields: dict[str, tuple[str, Tokens]]) -> DataFrame:
    """The postings of the given fields, all from one scan. Null and empty texts have none."""
    tokens = docs.where(F.col("doc_id").isNotNull()).select("doc_id", *[analyse(F.col(column)).alias(f"_{i}") for i, (column, analyse) in enumerate(fields.values())])
    return tokens.mapInArrow(_group_tokens(list(fields)), POSTINGS)


def build(docs: DataFrame, fields: dict[str, tuple[str, Tokens]], path: str | None = None) -> Index:
    """Write the index of the given fields (name -> column and analyser) and open it."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "index")
    docs = spread(docs)
    docs.write.parquet(f"{path}/docs")
    # written once unsorted, as finding the ranges reads the rows a second time and analysis is the dear part
    postings_of(docs, fields).write.parquet(f"{path}/unsorted")
    rows = spark.read.schema(POSTINGS).parquet(f"{path}/unsorted")
    order = ("field", "term", "doc_id")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("field").parquet(f"{path}/postings")
    stats = rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/term_stats")
    delete(spark, f"{path}/unsorted")
    return replace(open_index(spark, path), sources=dict(fields))


def open_index(spark: SparkSession, path: str) -> Index:
    docs = spark.read.parquet(f"{path}/docs")
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    term_stats = spark.read.schema(TERM_STATS).parquet(f"{path}/term_stats")
    n = docs.where("doc_id is not null").count()
    sums = term_stats.groupBy("field").agg(F.sum("cf").alias("cf")).collect()  # a row for each field
    return Index(docs, postings, term_stats, {r.field: FieldStats(n, r.cf) for r in sums})


def combined(indexes: list[Index], apart: bool = True) -> Index:
    """Several indexes as one, with the statistics of all: document frequencies, lengths and counts are global.

    apart: their ids may clash, so each index's ids are moved behind those of the ones before it; ``index_no`` and
    ``local_id`` of the documents say where they come from. Otherwise ids are unique already and stay.
    """
    docs, postings, base = [], [], 0
    for i, x in enumerate(indexes):
        move = F.col("doc_id") + base
        docs.append(x.docs.withColumns({"index_no": F.lit(i), "local_id": F.col("doc_id"), "doc_id": move}))
        postings.append(x.postings.withColumn("doc_id", move))
        if apart:
            base += (x.docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    stats = reduce(DataFrame.unionByName, [x.term_stats for x in indexes]).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    names = {n for x in indexes for n in x.stats}
    n_docs = sum(max([f.n_docs for f in x.stats.values()], default=0) for x in indexes)
    totals = {n: FieldStats(n_docs, sum(x.field(n).sum_len for x in indexes)) for n in names}
    sources = {k: v for x in reversed(indexes) for k, v in x.sources.items()}
    return Index(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), docs), reduce(DataFrame.unionByName, postings), stats, totals, sources)
