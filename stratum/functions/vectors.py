"""Vectors as triples of column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
AXES = "xyz"


def of(prefix: str, frame: str = "") -> Vec:
    """The three flat columns of a vector, optionally of an aliased table."""
    head = f"{frame}.{prefix}" if frame else prefix
    return tuple(F.col(head + k) for k in AXES)


def lit(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def named(a: Vec, prefix: str) -> list[Column]:
    return [x.alias(prefix + k) for x, k in zip(a, AXES, strict=True)]


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
