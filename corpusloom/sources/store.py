"""A table of documents in immutable versions.

A version is a manifest: the data folders it consists of, each with the version that wrote it, and the folders of
tombstones. Writers put files into new folders first and then rename the manifest into place, so a reader sees a whole
version or the one before, and of two writers that race for a number one fails. A tombstone (doc_id) removes the rows
that older versions wrote; an update is a tombstone and a new row in one version. Reading anti-joins the tombstones by
doc_id; compaction writes the live rows into one folder and drops them.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import shared
from corpusloom.sources.merging import Policy


class Conflict(RuntimeError):
    """Another writer took the version."""


class DocumentStore:
    """Documents under one folder, identified by doc_id."""

    def __init__(self, spark: SparkSession, root: str, *, sort_by: tuple[str, ...] = (), compression: str = "zstd"):
        self.spark, self.root, self.sort_by, self.compression = spark, root.rstrip("/"), sort_by, compression

    # versions

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in shared.list_names(self.spark, f"{self.root}/manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "data": [], "tombstones": [], "batches": {}, "schema": None}
        return json.loads(shared.read_text(self.spark, f"{self.root}/manifest/{version or known[-1]:08d}.json"))

    def _write(self, df: DataFrame, path: str, files: int | None = None) -> None:
        if self.sort_by:  # rows of a range lie together, so that row groups can be skipped by their least and greatest value
            ranges = df.repartitionByRange(files, *self.sort_by) if files else df.repartitionByRange(*self.sort_by)
            df = ranges.sortWithinPartitions(*self.sort_by)
        elif files:
            df = df.repartition(files)
        df.write.option("compression", self.compression).parquet(path)

    def prepare(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, batch: tuple[str, int] | None = None, files: int | None = None) -> dict:
        """First phase: write the files of the next version, which nobody sees yet. Give the result to commit or rollback."""
        state = self.manifest()
        version = state["version"] + 1
        at = f"{self.root}/files/{version:08d}-{time.time_ns():x}"
        new = dict(state, version=version, folder=at, data=list(state["data"]), tombstones=list(state["tombstones"]), batches=dict(state["batches"]))
        if deleted is not None:
            deleted.select("doc_id").distinct().write.parquet(f"{at}/tombstones")
            new["tombstones"].append([version, f"{at}/tombstones"])
        if rows is not None:
            self._write(rows, f"{at}/data", files)
            new["data"].append([version, f"{at}/data"])
            new["schema"] = new["schema"] or rows.schema.json()
        if batch is not None:
            new["batches"][batch[0]] = batch[1]
        return new

    def commit(self, prepared: dict) -> int:
        """Second phase: make the prepared version the current one."""
        try:
            shared.write_text_atomically(self.spark, f"{self.root}/manifest/{prepared['version']:08d}.json", json.dumps(prepared))
        except FileExistsError:
            self.rollback(prepared)
            raise Conflict(f"version {prepared['version']} exists") from None
        return prepared["version"]

    def rollback(self, prepared: dict) -> None:
        """Throw a prepared version away."""
        shared.delete(self.spark, prepared["folder"])

    # changes

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows. A (stream, number) batch that was committed before is skipped, so a retry changes nothing."""
        state = self.manifest()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return state["version"]
        return self.commit(self.prepare(rows, batch=batch))

    def delete(self, ids: DataFrame) -> int:
        """Remove documents by (doc_id)."""
        return self.commit(self.prepare(deleted=ids))

    def delete_where(self, condition: Column) -> int:
        return self.delete(self.read().where(condition))

    def update(self, rows: DataFrame) -> int:
        """Replace or add documents, one row for each doc_id."""
        return self.commit(self.prepare(rows, deleted=rows))

    def update_where(self, condition: Column, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace exactly the documents that satisfy a condition."""
        return self.update(change(self.read().where(condition)))

    def soft_delete(self, condition: Column, at: Column) -> int:
        """Mark documents as deleted; they stay until ``purge``."""
        return self.update_where(condition, lambda rows: rows.withColumn("deleted_at", at))

    def purge(self, before: Column) -> int:
        return self.delete_where(F.col("deleted_at") < before)

    def add_store(self, other: "DocumentStore") -> int:
        """Import another store's documents, their ids moved behind the own ones."""
        top = self.read().agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first().m
        return self.append(other.read().withColumn("doc_id", F.col("doc_id") + top))

    def compact(self, files: int | None = None) -> int:
        """Rewrite the live rows of the current version into one folder without tombstones."""
        state, rows = self.manifest(), self.read()
        new = self.prepare(rows, files=files)
        new["data"], new["tombstones"] = new["data"][len(state["data"]) :], []
        return self.commit(new)

    def merge(self, policy: Policy) -> list[list[str]]:
        """Rewrite the groups of folders that a policy chooses into one folder each; gives the groups."""
        groups = policy([(p, shared.size(self.spark, p)) for _, p in self.manifest()["data"]])
        for group in groups:
            state = self.manifest()
            new = self.prepare(self.read(only=set(group)))
            new["data"] = [x for x in new["data"] if x[1] not in group]
            oldest = min(v for v, _ in new["data"])
            # a tombstone is done with once no folder is older than it
            new["tombstones"] = [t for t in state["tombstones"] if t[0] > oldest]
            self.commit(new)
        return groups

    # reading

    def read(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The live documents of a version (the current one by default), or those of some of its folders."""
        state = self.manifest(version)
        if only is not None:
            state["data"] = [x for x in state["data"] if x[1] in only]
        if not state["data"]:
            raise FileNotFoundError(f"{self.root} holds no documents")
        if not state["tombstones"]:  # no version rules to follow: all folders are one scan
            return self.spark.read.option("mergeSchema", "true").parquet(*[p for _, p in state["data"]])
        parts = [self.spark.read.parquet(p).withColumn("_v", F.lit(v)) for v, p in state["data"]]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if state["tombstones"]:
            dead = reduce(DataFrame.unionByName, [self.spark.read.parquet(p).withColumn("_t", F.lit(v)) for v, p in state["tombstones"]])
            last = dead.groupBy("doc_id").agg(F.max("_t").alias("_t"))
            rows = rows.join(last, (rows.doc_id == last.doc_id) & (rows["_v"] < last["_t"]), "left_anti")
        return rows.drop("_v")

    def keep_last(self, n: int, pinned: tuple[int, ...] = ()) -> list[int]:
        """Forget all but the last n versions and the pinned ones; gives the versions dropped. Files in use stay."""
        known = self.versions()
        kept = set(known[-n:]) | set(pinned)
        used = {p for v in kept & set(known) for _, p in self.manifest(v)["data"] + self.manifest(v)["tombstones"]}
        dropped = [v for v in known if v not in kept]
        for v in dropped:
            for _, p in self.manifest(v)["data"] + self.manifest(v)["tombstones"]:
                if p not in used:
                    shared.delete(self.spark, p)
            shared.delete(self.spark, f"{self.root}/manifest/{v:08d}.json")
        return dropped

    # care

    def inspect(self) -> DataFrame:
        """(file, rows) of the current version's data files."""
        paths = [p for _, p in self.manifest()["data"]]
        return self.spark.read.parquet(*paths).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))

    def checksum(self, version: int | None = None) -> str:
        """A fingerprint of a version's content, independent of row order and layout."""
        rows = self.read(version)
        columns = sorted(rows.columns)
        one = rows.agg(F.count("*").alias("n"), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in columns)}))"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        return hashlib.sha256(f"{columns}{one.n}{one.x}{one.s}".encode()).hexdigest()

    def backup(self, to: str) -> str:
        """Copy the current version into a new store and verify it; gives the checksum."""
        other = DocumentStore(self.spark, to, sort_by=self.sort_by, compression=self.compression)
        other.append(self.read())
        mine, theirs = self.checksum(), other.checksum()
        if mine != theirs:
            raise RuntimeError("the backup differs from the store")
        return mine

    def validate(self) -> dict[str, int]:
        """Counts of problems: rows without doc_id, doc_ids that stand more than once, tombstones without a document."""
        rows = self.read()
        nulls = rows.where("doc_id is null").count()
        repeated = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count()
        return {"null_ids": nulls, "repeated_ids": repeated}
