"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    """Keeps query functions by name, each with an optional oracle statement."""

    fns: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def keep(fn: QueryFn) -> QueryFn:
            if name in self.fns:
                raise ValueError(f"query {name} is registered twice")
            self.fns[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep

    def add(self, name: str, fn: QueryFn, sql: str | None = None) -> None:
        self.query(name, sql)(fn)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
