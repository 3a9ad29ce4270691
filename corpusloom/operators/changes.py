"""Rebuilding the current state of a table from a change feed.

A change carries the number that its commit got. Numbers give the order, whatever the order of arrival. The replay

1. assembles transactions: the changes of one request, complete once every ordinal 0..n-1 has arrived;
2. collapses copies of one change to a single change with the lowest number that a copy has;
3. finds the contiguous committed watermark: the highest number below which nothing is outstanding;
4. applies, for each key by itself, the changes up to the watermark in the order of their numbers.

As every change replaces or removes a whole document, step 4 is one aggregation by key (the change with the highest
number decides), which combines before the shuffle: a key with a third of all rows costs one row for each task.
Keys never wait for each other. The numbers are one log over all indexes, so there is one watermark for all; changes
above it are held. A closed log takes the same steps. Its end record says that nothing more will arrive up to a number,
which settles the gaps and the incomplete transactions up to there: what is missing was never committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.jsons import is_complete_object
from corpusloom.functions.keys import effective_key

DELETE = "delete"
PUTS = ("index", "update")


def one_request_each(requests: DataFrame) -> DataFrame:
    """(request_id, index_name, request_key), each request once.

    A request that stands several times counts once; if its rows disagree, the greatest (index_name, key) holds,
    nulls being least. Rows without a request_id are left out.
    """
    return (
        requests.where(F.col("request_id").isNotNull())
        .groupBy("request_id")
        .agg(F.max(F.struct("index_name", "idempotency_key")).alias("r"))
        .select("request_id", F.col("r.index_name").alias("index_name"), F.col("r.idempotency_key").alias("request_key"))
    )


def with_request(operations: DataFrame, requests: DataFrame, columns: list[Column]) -> DataFrame:
    """The given columns of the operations, with the index_name and request_key of their request.

    An operation whose request is unknown belongs to no index and is left out. Columns of the two tables that share
    a name don't clash: only the named columns are taken.
    """
    return operations.select("request_id", *columns).join(one_request_each(requests), "request_id", "inner")


def committed_changes(operations: DataFrame, requests: DataFrame) -> DataFrame:
    """Changes with a commit number, copies collapsed: (index_name, document_id, sequence_number, is_delete, effective).

    A delivery without a number was never committed. Copies (same index, document and key) are one change with their
    lowest number; it is effective if it deletes or if a copy holds one complete JSON object. Kinds other than index,
    update and delete (in any letter case) change nothing, and nor does an operation without document_id.
    """
    kind = F.lower(F.trim("op_kind"))
    rows = operations.where(F.col("sequence_number").isNotNull() & F.col("document_id").isNotNull() & kind.isin(DELETE, *PUTS))
    deletes = kind == DELETE
    flat = with_request(
        rows,
        requests,
        [
            F.col("document_id"),
            F.col("sequence_number"),
            F.col("delivery_id"),
            F.col("idempotency_key").alias("own_key"),
            deletes.alias("is_delete"),
            (deletes | is_complete_object(F.when(~deletes, F.col("document_json")))).alias("effective"),
        ],
    )
    key = effective_key(F.col("own_key"), F.col("request_key"))
    keyed = flat.select("index_name", "document_id", key.alias("key"), F.when(key.isNull(), F.col("delivery_id")).alias("single"), "sequence_number", "is_delete", "effective")
    return (
        keyed.groupBy("index_name", "document_id", "key", "single")
        .agg(F.min("sequence_number").alias("sequence_number"), F.max("is_delete").alias("is_delete"), F.max("effective").alias("effective"))
        .drop("key", "single")
    )


def transactions(operations: DataFrame) -> DataFrame:
    """(request_id, ops, committed, complete, first_number, last_number) of each request.

    complete: every ordinal from 0 to the highest has arrived, in whatever order and however often.
    """
    return (
        operations.where(F.col("request_id").isNotNull())
        .groupBy("request_id", "op_ordinal")
        .agg(F.min("sequence_number").alias("number"))
        .groupBy("request_id")
        .agg(
            F.count("op_ordinal").alias("ops"),
            F.count("number").alias("committed"),
            (F.count("op_ordinal") == F.max("op_ordinal") + 1).alias("complete"),
            F.min("number").alias("first_number"),
            F.max("number").alias("last_number"),
        )
    )


def end_record(operations: DataFrame) -> DataFrame:
    """(settled): one row, the end of a closed log, up to which nothing more will arrive; null for an empty log."""
    return operations.agg(F.max("sequence_number").alias("settled"))


def _with_end(rows: DataFrame, end: DataFrame | None) -> DataFrame:
    """The rows with the settled number of the end record; null without a record."""
    return rows.withColumn("settled", F.lit(None).cast("long")) if end is None else rows.join(F.broadcast(end), how="cross")


def contiguous_watermark(numbers: DataFrame, by: list[str], number: str, step: int = 1, block: int = 1 << 20, end: DataFrame | None = None) -> DataFrame:
    """(*by, watermark): the highest number up to which each is at most ``step`` above the one before it.

    What is missing up to the number of an end record was never committed, so a gap only counts beyond that number.
    Numbers are cut into blocks of ``block``; each block finds its own first gap, and only one summary row of a block
    takes part in the search over blocks, so that no task ever holds all numbers of a log.
    """
    n = F.col(number)
    blocks = numbers.where(n.isNotNull()).select(*by, n.alias("n"), F.floor(n / block).alias("b")).distinct()
    inside = Window.partitionBy(*by, "b").orderBy("n")
    gaps = _with_end(blocks.withColumn("before", F.lag("n").over(inside)), end)

    def stop(before: str, at: str) -> Column:
        reached = F.greatest(before, "settled")
        return F.when(F.col(before).isNotNull() & (F.col(at) - reached > step), reached)

    summary = gaps.groupBy(*by, "b").agg(
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.min(stop("before", "n")).alias("stop"),
        F.max("settled").alias("settled"),
    )
    over = Window.partitionBy(*by).orderBy("b")
    ends = summary.withColumn("prev_hi", F.lag("hi").over(over)).withColumn("stop", F.coalesce(stop("prev_hi", "lo"), "stop"))
    return ends.groupBy(*by).agg(F.coalesce(F.min("stop"), F.max("hi")).alias("watermark"))


def accounted_numbers(operations: DataFrame, step: int = 2) -> DataFrame:
    """(number): the numbers of the log that aren't outstanding, committed or not.

    Besides the committed ones these are the places of operations that arrived without a number, or took another one
    when they were tried again. A request takes its numbers in a row, ``step`` apart in the order of its ordinals, so
    an ordinal's place follows from where more than half of its request's numbered operations agree that the row begins.
    Requests without such a majority account only for the numbers they have.
    """
    committed = operations.where(F.col("sequence_number").isNotNull()).select(F.col("sequence_number").alias("number"))
    ops = operations.where("request_id is not null and op_ordinal is not null").groupBy("request_id", "op_ordinal").agg(F.min("sequence_number").alias("n"))
    begin = (
        ops.where("n is not null")
        .groupBy("request_id", (F.col("n") - step * F.col("op_ordinal")).alias("begin"))
        .agg(F.count("*").alias("votes"))
        .groupBy("request_id")
        .agg(F.max(F.struct("votes", "begin")).alias("most"), F.sum("votes").alias("all"))
        .where("2 * most.votes > `all`")
        .select("request_id", F.col("most.begin").alias("begin"))
    )
    places = ops.join(begin, "request_id").select((F.col("begin") + step * F.col("op_ordinal")).alias("number"))
    ends = committed.agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    inside = places.join(F.broadcast(ends), F.col("number").between(F.col("lo"), F.col("hi"))).select("number")
    return committed.unionByName(inside).distinct()


def log_watermark(operations: DataFrame, *, closed: bool, step: int = 2) -> DataFrame:
    """(watermark): one row, the number up to which the log over all indexes holds; null for an empty log.

    It is the contiguous watermark, below the first number of every transaction that isn't complete. closed: the log has
    an end record, so gaps and incomplete transactions hold only what lies beyond its number.
    """
    end = end_record(operations) if closed else None
    pending = _with_end(transactions(operations).where(~F.col("complete")), end).where("settled is null or last_number > settled")
    held = pending.agg(F.min("first_number").alias("held_from"))
    mark = contiguous_watermark(accounted_numbers(operations, step), [], "number", step, end=end)
    return mark.join(F.broadcast(held), how="cross").select(F.least("watermark", F.col("held_from") - 1).alias("watermark"))


def replay(operations: DataFrame, requests: DataFrame, *, closed: bool = True, step: int = 2) -> DataFrame:
    """(index_name, document_id, sequence_number): the documents that exist, with the last change that took effect.

    Only deliveries up to the watermark of the log count (see log_watermark); those above it don't take part in copies
    either. closed: the log has an end record, which settles its gaps and incomplete transactions. Otherwise what lies
    behind a gap or in an incomplete transaction is held. Empty inputs give no rows; a null index_name or document_id
    is no document.
    """
    mark = F.broadcast(log_watermark(operations, closed=closed, step=step).withColumnRenamed("watermark", "_watermark"))
    reached = operations.join(mark, F.col("sequence_number") <= F.col("_watermark")).drop("_watermark")
    return (
        committed_changes(reached, requests)
        .where("effective and index_name is not null")
        .groupBy("index_name", "document_id")
        .agg(F.max(F.when(~F.col("is_delete"), F.col("sequence_number"))).alias("put"), F.max(F.when(F.col("is_delete"), F.col("sequence_number"))).alias("gone"))
        .where("put > gone or gone is null")
        .select("index_name", "document_id", F.col("put").alias("sequence_number"))
    )
