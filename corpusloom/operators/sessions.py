"""Paging over one state of an index, kept results, and searches that may stop early."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import hits as H
from corpusloom.plans.query import Query, search
from corpusloom.sources.index import Index


class Session:
    """Pages of one query over one index, whose tables never change: a cursor holds as long as the session does.

    keys: (column, descending) by name, of stored columns or score. A cursor carries the last row's place, the query's
    fingerprint and the time at which it ends, signed; it works in any process that knows the secret.
    """

    def __init__(self, index: Index, query: Query, keys: Sequence[tuple[str, bool]], secret: bytes, lease: float = 300.0):
        self.index, self.query, self.keys, self.secret, self.lease = index, query, list(keys), secret, lease
        self.identity = H.fingerprint((query, tuple(self.keys), tuple(sorted(index.stats.items()))))

    def page(self, n: int, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """The next n rows (doc_id and the keys), and the cursor behind them; None at the end."""
        found = search(self.index, self.query)
        names = [k for k, _ in self.keys]
        stored = [k for k in names if k not in ("score", "doc_id")]
        rows = found.join(self.index.docs.select("doc_id", *stored), "doc_id") if stored else found
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in names) or "true").select("doc_id", *names)
        keys = [(F.col(k), d) for k, d in self.keys]
        if cursor is None:
            out = H.sort_hits(rows, keys, n)
        else:
            *place, ends = H.read_cursor(cursor, self.identity, self.secret)
            if time.time() > ends:
                raise ValueError("the cursor has ended")
            out = H.search_after(rows, keys, place, n)
        page = out.collect()  # one page
        if not page:
            return out, None
        last = page[-1]
        behind = [last[k] for k in names] + [last.doc_id, time.time() + self.lease]
        shown = found.sparkSession.createDataFrame(page, out.schema)
        return shown, H.sign_cursor(json.loads(json.dumps(behind, default=str)), self.identity, self.secret) if len(page) == n else None


class ResultCache:
    """Top lists of queries over one index, the least recently used going first. Index tables never change, so they hold."""

    def __init__(self, index: Index, size: int = 128):
        self.index, self.size, self.hits, self.misses, self._kept = index, size, 0, 0, OrderedDict()

    def top(self, query: Query, n: int = 10, similarity: str = "bm25") -> list[tuple[int, float]]:
        key = (H.fingerprint(query), n, similarity)
        if key in self._kept:
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]
        self.misses += 1
        rows = [(r.doc_id, r.score) for r in search(self.index, query, similarity).orderBy(F.desc("score"), "doc_id").limit(n).collect()]
        self._kept[key] = rows
        if len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return rows


def limited(hits: DataFrame, most: int) -> DataFrame:
    """(doc_id, score, is_partial): at most ``most`` hits, whichever are there first, and whether there were more.

    Spark reads partitions until it has one more than wanted and stops.
    """
    some = hits.limit(most + 1)
    total = some.agg(F.count("*").alias("_n"))
    return some.limit(most).join(F.broadcast(total), how="cross").select(*hits.columns, (F.col("_n") > most).alias("is_partial"))


def collected(hits: DataFrame, **collectors: Column) -> DataFrame:
    """Any aggregates over all hits in one pass (a custom collector is an aggregate expression)."""
    return hits.agg(*[c.alias(name) for name, c in collectors.items()])


def streamed(hits: DataFrame):
    """Hits one by one, as partitions come in; no more than a partition is held by the reader."""
    return hits.toLocalIterator(prefetchPartitions=True)
