"""Shared helpers of the text operators: worker import path, shared scratch tables,
Arrow batch plumbing and the null-safe column selection every operator starts from."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, materialize, prepare

__all__ = ["discard", "documents", "focus", "map_batches", "materialize", "prepare", "remembers", "utf8", "with_counts"]

#: What each operator keeps in a Python worker between tasks, as functions that let it go.
_kept: dict[str, list[Callable[[], None]]] = {}


#: Modules that work with another one's memory.
OWNERS = {"windows": "shingles", "packing": "bpe"}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Register how to let go of an operator's worker-wide memory."""
    _kept.setdefault(owner, []).append(forget)


#: The operator that last ran in this worker.
_last = [""]


def focus(owner: str) -> None:
    """Workers outlive stages; the operator that runs now frees what others left in its worker."""
    for name, forgets in _kept.items():
        if name != owner:
            for forget in forgets:
                forget()
    if owner != _last[0]:
        _last[0] = owner
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library may have no such call
            ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, pruned to the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


#: Rows of one key that an ordinary join leaves in one task.
HOT_ROWS = 10_000


def with_counts(rows: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Join rows with a table of one row per key, whose n tells how many of the rows hold the key.

    Keys of more than a thousandth of the rows, which are fewer than a thousand, are broadcast, so that
    their rows stay where they are; the others are joined as usual."""
    counted = materialize(rows.sparkSession, counted)
    most = max(HOT_ROWS, (counted.agg(F.sum("n").alias("n")).first().n or 0) // 1000)
    hot = counted.where(F.col("n") > most)
    names = [r[0] for r in hot.select(key).collect()]  # fewer than a thousand
    if not names:
        return rows.join(counted, key)
    there = F.col(key).isin(names)
    return rows.where(there).join(F.broadcast(hot), key).unionByName(rows.where(~there).join(counted.where(F.col("n") <= most), key))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply fn to each Arrow batch; batches for which it returns None vanish."""
    owner = fn.__module__.rpartition(".")[2]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus(OWNERS.get(owner, owner))
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""
