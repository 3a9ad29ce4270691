"""Exactly one copy of each message that was delivered at least once.

``WinnerStore`` keeps the winning delivery of every identity in arrival partitions, beside an identifier index
(identity -> partition), which lies in hash buckets. A batch of incoming messages

1. is reduced to one winner for each identity (combined before the shuffle, so a hot identity costs a row a task);
2. looks up in the buckets of the index that it hits which historical partitions hold any of its identities;
3. is combined with the rows of those partitions only, and the single winner of each identity is recomputed;
4. overwrites exactly those partitions, and adds new ones: files of a new version are written first, then a manifest
   that names the current files of every partition is renamed into place. Readers see the old state or the new one.

The deliveries that lost go to a ledger in the same commit. The lowest delivery id wins, so the result doesn't depend
on how the stream was cut into batches, and a batch that is applied again changes nothing. A version that was begun and
not committed leaves files that no manifest names; they are in nobody's way and ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.keys import effective_key, identity128
from corpusloom.operators.changes import with_request
from corpusloom.sources import shared

WINNER = "h1 bigint, h2 bigint, delivery_id bigint, part bigint"


class WinnerStore:
    """Winners by arrival partition, the identifier index and the ledger of dropped deliveries, under one folder."""

    def __init__(self, spark: SparkSession, root: str, rows_per_partition: int = 1 << 19, buckets: int = 64):
        self.spark, self.root, self.rows, self.buckets = spark, root.rstrip("/"), rows_per_partition, buckets

    def _bucket(self) -> Column:
        return F.expr(f"pmod(h1, {self.buckets})")

    def _lookup(self, folders: list[str], incoming: DataFrame) -> list[int]:
        """The partitions that hold an identity of a batch; only the buckets of the index that the batch hits are read."""
        hit = [r.b for r in incoming.select(self._bucket().alias("b")).distinct().collect()]  # at most one number for each bucket
        index = None
        for at in folders:
            # the bucket is the folder's name, so the others are never listed as files to read
            part = self.spark.read.schema("h1 bigint, h2 bigint, part bigint, b bigint").parquet(at).where(F.col("b").isin(hit))
            index = part if index is None else index.unionByName(part)
        found = index.join(incoming.select("h1", "h2"), ["h1", "h2"], "left_semi").select("part").distinct()
        return [r.part for r in found.collect()]  # one number for each partition of the store at most

    def _manifest(self) -> dict:
        names = [n for n in shared.list_names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "parts": {}, "index": [], "ledger": []}
        return json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{names[-1]}"))

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ingest(self, batch: DataFrame) -> None:
        """Apply a batch (h1, h2, delivery_id), both hashes of an identity being set."""
        state = self._manifest()
        version = state["version"] + 1
        at = f"{self.root}/v{version:08d}-{uuid.uuid4().hex[:8]}"
        scratch: list[DataFrame] = []
        part = F.expr(f"delivery_id div {self.rows}")
        incoming = batch.groupBy("h1", "h2").agg(F.min("delivery_id").alias("delivery_id"))
        if state["index"]:
            incoming = incoming.withColumn("part", part)
            incoming = shared.written(incoming, "incoming")
            scratch.append(incoming)
            affected = self._lookup(state["index"], incoming)
            old = self._read([p for a in affected for p in state["parts"].get(str(a), [])], WINNER)
            tagged = old.withColumn("home", F.col("part")).unionByName(incoming.withColumn("home", F.lit(None).cast("bigint")))
            # an identity stays in the partition that has it; a new one goes where its winner arrived
            winners = tagged.groupBy("h1", "h2").agg(
                F.min("delivery_id").alias("delivery_id"),
                F.coalesce(F.max("home"), F.min("part")).alias("part"),
                F.max("home").isNull().alias("fresh"),
            )
            contenders = batch.select("delivery_id").unionByName(old.select("delivery_id"))
        else:
            affected = []
            winners = incoming.withColumn("part", part).withColumn("fresh", F.lit(True))
            contenders = batch.select("delivery_id")
        winners = shared.written(winners, "winners")
        scratch.append(winners)
        # rows of one partition lie together, so a partition is written by few tasks
        winners.drop("fresh").withColumn("p", F.col("part")).repartition("p").write.partitionBy("p").parquet(f"{at}/data")
        winners.where("fresh").select("h1", "h2", "part", self._bucket().alias("b")).repartition("b").write.partitionBy("b").parquet(f"{at}/index")
        contenders.distinct().join(winners.select("delivery_id"), "delivery_id", "left_anti").write.parquet(f"{at}/ledger")
        parts = dict(state["parts"])
        for name in shared.list_names(self.spark, f"{at}/data"):
            if name.startswith("p="):
                p = name[2:]
                new, kept = [f"{at}/data/{name}"], parts.get(p, [])
                parts[p] = new if int(p) in affected else [*kept, *new]  # untouched rows of a partition that only grew stay
        state = {"version": version, "parts": parts, "index": [*state["index"], f"{at}/index"], "ledger": [*state["ledger"], f"{at}/ledger"]}
        shared.write_text_atomically(self.spark, f"{self.root}/manifest/{version:08d}.json", json.dumps(state))
        for frame in scratch:
            shared.discard(frame)

    def vacuum(self) -> list[str]:
        """Remove the files that the current manifest doesn't name: replaced ones and those of versions never committed.

        Not while others read or write; gives the paths removed.
        """
        state = self._manifest()
        used = {p for ps in state["parts"].values() for p in ps} | set(state["index"]) | set(state["ledger"])
        gone = []
        for name in shared.list_names(self.spark, self.root):
            if not name.startswith("v"):
                continue
            at = f"{self.root}/{name}"
            parts = [f"{at}/data/{p}" for p in shared.list_names(self.spark, f"{at}/data") if p.startswith("p=")]
            gone += [p for p in [*parts, f"{at}/index", f"{at}/ledger"] if p not in used and shared.exists(self.spark, p)]
        for p in gone:
            shared.delete(self.spark, p)
        return gone

    def winners(self) -> DataFrame:
        return self._read([p for ps in self._manifest()["parts"].values() for p in ps], WINNER)

    def dropped(self) -> DataFrame:
        """(delivery_id) of every delivery that is a copy of a kept one."""
        return self._read(self._manifest()["ledger"], "delivery_id bigint").distinct()


def delivery_identities(operations: DataFrame, requests: DataFrame) -> DataFrame:
    """(h1, h2, delivery_id) of the deliveries that have a key, a document and an index.

    Two deliveries are copies if index, document_id and key agree, the key being the operation's own or else the
    request's, without outer white space and letter case. Without a key a delivery is never a copy, and nor is one
    whose index, document or delivery id is null.
    """
    rows = with_request(operations.where(F.col("delivery_id").isNotNull() & F.col("document_id").isNotNull()), requests, [F.col("document_id"), F.col("delivery_id"), F.col("idempotency_key").alias("own_key")])
    key = effective_key(F.col("own_key"), F.col("request_key"))
    keyed = rows.select("index_name", "document_id", "delivery_id", key.alias("key")).where("key is not null and index_name is not null")
    h1, h2 = identity128(F.col("index_name"), F.col("document_id"), F.col("key"))
    return keyed.select(h1.alias("h1"), h2.alias("h2"), "delivery_id")


def dropped_copies(operations: DataFrame, requests: DataFrame, *, history_share: float = 0.75, rows_per_partition: int = 1 << 13) -> DataFrame:
    """(delivery_id) of the copies to drop, found by loading the earlier arrivals and then applying the later ones.

    history_share: the part of the delivery ids that counts as history. It changes the cost, not the result.
    An empty feed gives no rows.
    """
    spark = operations.sparkSession
    ids = shared.written(delivery_identities(operations, requests), "identities")
    lo, hi = ids.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    store = WinnerStore(spark, shared.scratch_path(spark, "winner-store"), rows_per_partition)
    if lo is None:
        return ids.select("delivery_id")
    cut = lo + int((hi - lo) * history_share)
    store.ingest(ids.where(F.col("delivery_id") <= cut))
    store.ingest(ids.where(F.col("delivery_id") > cut))
    store.vacuum()
    shared.discard(ids)
    return store.dropped()
