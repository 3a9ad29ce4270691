"""Strict JSON: exactly one complete value, as RFC 8259 has it."""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class NotJson(ValueError):
    """The text isn't one complete JSON value."""


def _no_constant(name: str):
    raise NotJson(name)


_decoder = json.JSONDecoder(parse_constant=_no_constant)


def parse_strict(text: str):
    """The value of a JSON text. NaN and Infinity, trailing text and a leading byte order mark aren't JSON.

    Raises NotJson for those, for damaged text, and for nesting beyond what the interpreter's stack can hold.
    """
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError) as e:
        raise NotJson(str(e)) from None


def _is_object(text) -> bool:
    if text is None:
        return False
    try:
        return isinstance(parse_strict(text), dict)
    except NotJson:
        return False


def _complete_object(texts: pd.Series) -> pd.Series:
    return pd.Series([_is_object(t) for t in texts], dtype=bool)


@cache
def _complete_object_udf():
    """Made at its first use: a type can only be parsed where there is a session, which a worker doesn't have."""
    return F.pandas_udf(_complete_object, "boolean")


def is_complete_object(col: Column) -> Column:
    """True where the text is one complete JSON object; false for null and everything else.

    Texts that don't begin with a brace and end with one are settled in the JVM and never reach Python.
    """
    candidate = F.coalesce(F.trim(F.regexp_replace(col, r"[\t\r\n]", " ")).rlike(r"(?s)^\{.*\}$"), F.lit(False))
    return candidate & _complete_object_udf()(F.when(candidate, col))
