"""Schemas: validation of rows, JSON documents as columns, token budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FieldRule:
    """A field's type and whether it must be there."""

    name: str
    type: str
    required: bool = False


class SchemaError(ValueError):
    """Columns are missing, unknown or of another type."""


def check_columns(df: DataFrame, rules: list[FieldRule], strict: bool = False) -> None:
    """Raise SchemaError for a missing required column, a type that differs, or (strict) an unknown column."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{r.name} is missing" for r in rules if r.required and r.name not in have]
    wrong += [f"{r.name} is {have[r.name]}, not {r.type}" for r in rules if r.name in have and have[r.name] != r.type]
    if strict:
        wrong += [f"{n} is unknown" for n in have if n not in {r.name for r in rules}]
    if wrong:
        raise SchemaError("; ".join(wrong))


def violations(df: DataFrame, rules: list[FieldRule]) -> Column:
    """The names of the required fields that a row lacks."""
    missing = [F.when(F.col(r.name).isNull(), F.lit(r.name)) for r in rules if r.required]
    return F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")


def flatten(df: DataFrame, separator: str = ".", depth: int = 10) -> DataFrame:
    """Struct columns as columns with dotted names; arrays stay as they are."""
    for _ in range(depth):
        nested = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)}
        if not nested:
            break
        columns = []
        for f in df.schema.fields:
            if f.name in nested:
                columns += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{separator}{g.name}") for g in f.dataType.fields]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def from_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The other columns, and the JSON of one as flat columns."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    return flatten(df.select(*rest, F.from_json(column, schema).alias(column)))


def token_budget(tokens: Column, most: int, reject: bool = False) -> Column:
    """The first ``most`` tokens; or an error for a document that has more."""
    if reject:
        return F.when(F.size(tokens) > most, F.raise_error(F.lit("token budget exceeded"))).otherwise(tokens)
    return F.slice(tokens, 1, most)
