"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents of a task are laid end to end in table order. Window cuts may fall at document ends,
sentence ends and, inside long stretches without either, at regular places. The cuts minimise
padding plus a penalty for each cut inside a document: best[j] is the least over the boundaries
i within one window before j of best[i] + place[i], so a monotone queue gives every transition
in constant amortised time.

What is left at the end of a task, less than one window, is packed in a second pass together with
that of neighbouring tasks, so the padding does not depend on the number of partitions.

Defined results: a null or empty text is one end-of-document id; a text longer than a window is
spread over consecutive windows; an empty table gives no pieces; repeated rows are packed each
on their own; ids are whole numbers. Sequence ids are unique, not gapless across tasks.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMORY_WORDS, load
from .common import focus, materialize, prepare


@dataclass(frozen=True)
class PackingConfig:
    """length: ids per window; end_id: closes every document; sentence_penalty and
    stretch_penalty: cost, in padded ids, of a cut at a sentence end or inside a stretch;
    stretch: ids without a boundary after which cuts become possible; segment: ids that one
    pass of the dynamic programme covers, which bounds a task's memory; tails: ends of tasks that
    one task of the second pass takes, less than a window each; memory: words an encoder remembers."""

    length: int = 4096
    end_id: int = 2
    sentence_penalty: int = 12
    stretch_penalty: int = 96
    stretch: int = 256
    segment: int = 1_500_000
    tails: int = 256
    memory: int = MEMORY_WORDS

    def __post_init__(self) -> None:
        if not 1 <= self.stretch <= self.length:
            raise ValueError("stretch must lie between 1 and length, or a window might have no cut")
        if self.segment < self.length or self.tails < 1:
            raise ValueError("segment must hold a window, and tails one end")


#: Marks that close a sentence.
STOPS = set(".!?…")


def sentence_ids(token: dict[int, str], end: str) -> np.ndarray:
    """True for every id whose token is the end of a word made of stops only."""
    out = np.zeros(max(token) + 1, bool)
    for i, t in token.items():
        body = t.removesuffix(end)
        out[i] = t.endswith(end) and body != "" and set(body) <= STOPS
    return out


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, config: PackingConfig) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut places (ids before the cut) and their penalties, place 0 and the end included."""
    ends = np.unique(np.concatenate(([0], np.flatnonzero(closes[ids]) + 1, doc_ends)))
    gaps = np.diff(ends)
    long = np.flatnonzero(gaps > config.stretch)
    extra = [np.arange(ends[k] + config.stretch, ends[k + 1], config.stretch) for k in long]
    places = np.unique(np.concatenate([ends, *extra]))
    cost = np.full(places.size, config.stretch_penalty)
    cost[np.searchsorted(places, ends)] = config.sentence_penalty
    cost[np.searchsorted(places, doc_ends)] = 0
    cost[0] = 0
    return places, cost


def cuts(places: np.ndarray, cost: np.ndarray, length: int, last: bool) -> list[int]:
    """Cut places of a cheapest division into windows of at most length ids.

    The last cut is the end of the stretch if last, else whichever place less than one window
    from the end is cheapest to reach, so that the rest can start the next pass; there is none if
    all places are that near."""
    at, pen = places.tolist(), cost.tolist()
    n = len(at)
    best, origin = [0] * n, [0] * n
    value = [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        low = at[j] - length
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best[j] = value[i] + length - at[j] + pen[j]
        origin[j] = i
        v = value[j] = best[j] + at[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        j = min((k for k in range(n - 1, -1, -1) if at[k] > at[-1] - length), key=lambda k: best[k], default=n - 1)
    out = []
    while j:
        out.append(at[j])
        j = origin[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents; pieces come out as tuples in sequence order."""

    def __init__(self, closes: np.ndarray, config: PackingConfig, first_sequence: int) -> None:
        self.closes, self.config, self.sequence = closes, config, first_sequence
        #: id, ids not yet packed, ids of the document before them, ids of the whole document
        self.docs: list[tuple[object, np.ndarray, int, int]] = []
        self.held = 0

    def add(self, doc_id: object, packed: bytes) -> list[tuple]:
        ids = np.frombuffer(packed + self.config.end_id.to_bytes(4, "little"), "<u4")
        return self.resume(doc_id, ids, 0, ids.size)

    def resume(self, doc_id: object, ids: np.ndarray, before: int, total: int) -> list[tuple]:
        """Take the rest of a document of which some ids were packed elsewhere."""
        self.docs.append((doc_id, ids, before, total))
        self.held += ids.size
        return self.flush(False) if self.held >= self.config.segment else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        ids = np.concatenate([x for _, x, _, _ in self.docs])
        stops = np.cumsum([x.size for _, x, _, _ in self.docs])
        out, k, used, begin = [], 0, 0, 0
        for cut in cuts(*boundaries(ids, stops, self.closes, self.config), self.config.length, last):
            offset = 0
            while begin < cut:
                doc_id, x, before, total = self.docs[k]
                n = int(min(cut, stops[k]) - begin)
                out.append((doc_id, before + used, n, zlib.crc32(x[used : used + n].tobytes()), total, self.sequence, offset, None))
                offset, begin, used = offset + n, begin + n, used + n
                if begin == stops[k]:
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if rest:
            doc_id, x, before, total = rest[0]
            rest[0] = (doc_id, x[used:], before + used, total)
        self.docs, self.held = rest, int(ids.size - begin)
        return out

    def tail(self) -> list[tuple]:
        """What is not packed yet, less than a window after a flush, as rows that carry their ids."""
        return [(doc_id, before, x.size, 0, total, self.sequence, k, x.tobytes()) for k, (doc_id, x, before, total) in enumerate(self.docs)]


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NAMES, "ids"])


def pack_documents(docs: DataFrame, vocabulary: str, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs the documents of its own partition in their stored order. Only the ends of
    the tasks are shuffled, at most one window each; of config.tails of them one sequence can be
    far from full."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("bpe")
        bpe = load(vocabulary, config.memory, library=True)
        context = TaskContext.get()
        packer = Packer(sentence_ids(bpe.token, bpe.end), config, (context.partitionId() if context else 0) << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := packer.add(doc_id, bpe.encode_packed(text)):
                    yield batch_of(rows)
        if rows := packer.flush(False) + packer.tail():
            yield batch_of(rows)

    def join(table: pa.Table) -> pa.Table:
        focus("bpe")
        bpe = load(vocabulary, config.memory, library=True)
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        # its first task used fewer sequence ids than this
        packer = Packer(sentence_ids(bpe.token, bpe.end), config, (rows[0]["sequence_id"] >> 40 << 40) + (1 << 39))
        out = []
        for r in rows:
            out += packer.resume(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
        return pa.Table.from_batches([batch_of(out + packer.flush(True))]).drop_columns(["ids"])

    pieces = materialize(spark, docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary"))
    ends = pieces.where("ids is not null").withColumn("some", F.expr(f"shiftright(sequence_id, 40) div {config.tails}"))
    return pieces.where("ids is null").drop("ids").unionByName(ends.groupBy("some").applyInArrow(join, SCHEMA))
