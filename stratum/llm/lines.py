"""Line dedup over content-defined chunks of lines.

Every line is hashed; a rolling hash over the last `window` line hashes puts a chunk boundary
where it is divisible by `divisor`, so a repeated block of lines is cut at the same places
wherever it stands. Chunks of several lines that occur more than once in the corpus are removed
except for their first occurrence (least doc_id, then place), after their bytes were compared.

Hashes are counted with partial sums before the shuffle; bytes travel only for chunks whose hash
repeats. Defined results: null and empty texts have no chunk and stay; a text without a line
break is one line and stays; rows equal in id and text count as one document; equal hashes with
different bytes are not repeats; null ids sort first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, utf8, with_counts
from .suffixes import keyed, packed_texts


@dataclass(frozen=True)
class LineConfig:
    """window: lines the rolling hash covers; divisor: mean lines between boundaries beyond the
    least; least_lines: lines of a chunk before a boundary may close it, and of one that may go."""

    window: int = 2
    divisor: int = 2
    least_lines: int = 2


MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def chunks(data: bytes, config: LineConfig) -> Iterator[tuple[int, int, int, int]]:
    """(first line, lines, first byte, end byte without the last line break) of each chunk."""
    hashes: list[int] = []
    lines = data.split(b"\n")
    first = at = begin = 0
    power = pow(STEP, config.window, 1 << 64)
    rolling = 0
    for k, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        hashes.append(h)
        rolling = (rolling * STEP + h) & MASK
        if k >= config.window:
            rolling = (rolling - power * hashes[k - config.window]) & MASK
        at += len(line) + 1
        if k - first + 1 >= config.least_lines and (rolling >> 32) % config.divisor == 0 or k == len(lines) - 1:
            yield first, k - first + 1, begin, at - 1
            first, begin = k + 1, at


def chunk_table(docs: DataFrame, config: LineConfig) -> DataFrame:
    """kid, doc_id, k, h (16 bytes) of every chunk of several lines."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        kids, ids, ks, hs = [], [], [], []
        for kid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = utf8(text)
            for k, (_, lines, b, e) in enumerate(chunks(data, config)):
                if lines >= config.least_lines:
                    kids.append(kid)
                    ids.append(doc_id)
                    ks.append(k)
                    hs.append(xxhash.xxh3_128_digest(data[b:e]))
        if not kids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(kids, pa.int64()), pa.array(ids, batch.schema.field(1).type), pa.array(ks, pa.int32()), pa.array(hs, pa.binary())], names=["kid", "doc_id", "k", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(keyed(docs), run, f"kid bigint, doc_id {kind}, k int, h binary")


def repeated_chunks(docs: DataFrame, config: LineConfig) -> DataFrame:
    """kid, ks: the chunks to remove, each proved equal in bytes to an earlier one."""
    spark = docs.sparkSession
    table = materialize(spark, chunk_table(docs, config))
    twice = table.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "kid", "k")).alias("first")).where("n > 1")
    marked = with_counts(table, twice, "h").select("kid", "k", "h", ((F.col("kid") == F.col("first.kid")) & (F.col("k") == F.col("first.k"))).alias("first"))
    wanted = materialize(spark, marked.groupBy("kid").agg(F.collect_set(F.struct("k", "h", "first")).alias("wanted")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        rows = []
        for kid, z, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = unpack.decompress(z)
            place = [(b, e) for _, _, b, e in chunks(data, config)]
            rows += [(kid, w["k"], w["h"], w["first"], data[slice(*place[w["k"]])]) for w in want]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kid", "k", "h", "first", "data"])

    cut = packed_texts(docs).hint("merge").join(wanted, "kid").select("kid", "z", "wanted")
    cut = materialize(spark, map_batches(cut, run, "kid bigint, k int, h binary, first boolean, data binary"))
    firsts = cut.where("first").select("h", F.col("data").alias("kept")).dropDuplicates(["h"])
    proved = cut.where("not first").join(firsts, "h").where(F.col("data") == F.col("kept"))
    return proved.groupBy("kid").agg(F.collect_set("k").alias("ks"))


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """kid, doc_id, text (what is left), n_lines, n_removed (lines), n_chunks (removed) and the
    named other columns of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = materialize(docs.sparkSession, repeated_chunks(docs, config))
    joined = packed_texts(docs, carry).hint("merge").join(gone, "kid", "left").select("kid", "doc_id", "z", "ks", *carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        texts, total, removed, count = [], [], [], []
        for z, ks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            data = unpack.decompress(z)
            drop = set(ks or ())
            kept, lost = [data], 0
            if drop:
                kept = []
                for k, (_, lines, b, e) in enumerate(chunks(data, config)):
                    if k in drop:
                        lost += lines
                    else:
                        kept.append(data[b:e])
            texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
            total.append(data.count(b"\n") + 1 if data else 0)
            removed.append(lost)
            count.append(len(drop))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in (total, removed, count)), *batch.columns[4:]],
            names=["kid", "doc_id", "text", "n_lines", "n_removed", "n_chunks", *carry],
        )

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return map_batches(joined, run, ", ".join(["kid bigint", f"doc_id {kind}", "text string", "n_lines bigint", "n_removed bigint", "n_chunks bigint", *kinds]))


def brute_force(docs: list[tuple[int, str | None]], config: LineConfig = LineConfig()) -> dict[int, str]:
    """doc_id -> text left, by one pass in id order over chunk bytes; for tests with unique ids."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, text in sorted(docs):
        data, kept = utf8(text), []
        for _, lines, b, e in chunks(data, config):
            if lines >= config.least_lines and data[b:e] in seen:
                continue
            if lines >= config.least_lines:
                seen.add(data[b:e])
            kept.append(data[b:e])
        out[doc_id] = b"\n".join(kept).decode()
    return out
