"""Coordinates as sortable integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps in a half and a whole turn, and the least integer of 32 bits.
STEPS, LEAST = 2**32 - 1, -(2**31)


def _encode(degrees: Column, half: float) -> Column:
    return (F.floor((degrees + half) * (STEPS / (2 * half))) + LEAST).cast("int")


def encode_latitude(degrees: Column) -> Column:
    """-90..90 as a 32-bit integer that sorts alike; null for null and what lies outside."""
    return F.when(degrees.between(-90.0, 90.0), _encode(degrees, 90.0))


def encode_longitude(degrees: Column) -> Column:
    return F.when(degrees.between(-180.0, 180.0), _encode(degrees, 180.0))


def decode_latitude(code: Column) -> Column:
    return (code.cast("long") - LEAST) / (STEPS / 180.0) - 90.0


def decode_longitude(code: Column) -> Column:
    return (code.cast("long") - LEAST) / (STEPS / 360.0) - 180.0
