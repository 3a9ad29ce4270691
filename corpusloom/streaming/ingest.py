"""Streams of documents: ingestion into a store and standing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.analysis import Tokens
from corpusloom.sources import shared
from corpusloom.sources.store import DocumentStore


def parquet_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 64) -> DataFrame:
    """A table's Parquet files as a stream; files_at_once bounds a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    if any(n.endswith(".parquet") for n in shared.list_names(spark, path)) and not shared.is_file(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ingest(stream: DataFrame, store: DocumentStore, checkpoint: str, name: str = "documents") -> None:
    """Append a stream's rows to a store until all that is there has been read.

    Each micro-batch is one version, recorded under its number; a batch that is replayed after a failure is skipped.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.append(batch, (name, number))

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()
    query.awaitTermination()


def standing_queries(stream: DataFrame, column: str, analyse: Tokens, wanted: dict[str, list[str]]) -> DataFrame:
    """(doc_id, query): for each document the named queries all of whose terms it holds. Stateless."""
    tokens = stream.select("doc_id", analyse(F.col(column)).alias("tokens"))

    def hit(name: str, terms: list[str]) -> Column:
        return F.when(F.size(F.array_intersect("tokens", F.array(*[F.lit(t) for t in terms]))) == len(set(terms)), F.lit(name))

    return tokens.select("doc_id", F.explode(F.array_compact(F.array(*[hit(n, t) for n, t in wanted.items()]))).alias("query"))


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window, rows later than the watermark being dropped in a stream."""
    marked = stream.withWatermark("ts", late)
    counts = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
