"""Gaps and islands: consecutive values of a column within a key form one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_island(rows: DataFrame, key: list[str], cross: str, ties: list[str]) -> DataFrame:
    """Number the runs of each key; a run continues only when `cross` grows by exactly one."""
    order = Window.partitionBy(*key).orderBy(cross, *ties)
    starts = F.when(F.col(cross) == F.lag(cross).over(order) + 1, F.lit(0)).otherwise(F.lit(1))
    return rows.withColumn("_start", starts).withColumn("island", F.sum("_start").over(order)).drop("_start")


def ends(cross: str, names: list[str], ties: list[str], last: bool) -> Column:
    """The named columns of a run's first or last row, as one struct."""
    pick = F.max_by if last else F.min_by
    return pick(F.struct(*names), F.struct(cross, *ties))
