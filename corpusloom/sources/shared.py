"""Scratch space that every executor can reach.

The folder is the one named by ``spark.checkpoint.dir``. Where a session on one machine names none (tests, a laptop), a
folder below the session's warehouse is used and set, so that all later calls agree on it; a cluster must name one. Files are handled through
Hadoop's FileSystem, so the folder may be on any store that Spark can reach.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; set below the warehouse if the session names none."""
    at = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SETTING} to a folder that all executors can reach")
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set(SETTING, at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote for a frame that nobody reads any more."""
    for file in df.inputFiles()[:1]:
        delete(df.sparkSession, file.rpartition("/")[0])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text (manifests)."""
    fs, p, jvm = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that a reader sees whole or not at all. Fails if the target exists.

    The target is claimed by creating ``path.claim`` without overwriting, which stores offer as one step, so of two
    writers one fails here; the text is then written beside the target and renamed into place. A claim older than
    the target's writer, left by a crash, is cleared by ``release``.
    """
    fs, p, jvm = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}.claim")
    try:
        fs.create(claim, False).close()
    except Exception as e:
        raise FileExistsError(path) from e
    try:
        if fs.exists(p):  # the claim of a writer that finished before this one began
            raise FileExistsError(path)
        tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        if not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise FileExistsError(path)
    finally:
        fs.delete(claim, False)


def release(spark: SparkSession, path: str) -> None:
    """Clear the claim on a target whose writer died before it wrote."""
    fs, _, jvm = _fs(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.claim"), False)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path."""
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def spread(table: DataFrame) -> DataFrame:
    """A scanned table in at least as many partitions as there are cores.

    A table of few files or row groups would otherwise be read, and all that follows computed, by few tasks. Where the
    scan already has enough partitions, as any large table does, nothing is shuffled. Only for frames that are scans.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    scanned = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table if scanned >= cores else table.repartition(cores)
