"""Removal of long repeated byte strings by a distributed, common-prefix-aware suffix sort.

Every start of a `length`-byte string belongs to one anchor: the leftmost position of least
8-byte hash among the `window` positions from it. Equal strings have equal anchors, so only the
suffixes at anchors need sorting. The sort runs as an external merge sort over the cluster:

1. anchors whose first `length - window + 1` bytes occur once cannot be in a repeat; counting
   hashes of those bytes (partial sums before the shuffle) removes them;
2. each task sorts the remaining suffixes (extended by their reversed left context) into runs,
   puts equal ones together, front-codes them (common-prefix length and tail) and sends blocks by
   prefix hash, so equal prefixes meet; of equal suffixes of a run one is sent, as the others'
   strings are known to be repeats;
3. each block group is merged by a loser tree that keeps the common-prefix length of every
   loser with its winner: longer known prefixes win without a look at the bytes, and bytes are
   compared only behind a known common prefix;
4. the merged common-prefix array gives, for each offset x before the anchor, the classes of
   equal right parts; the left contexts sorted likewise give the classes of equal left parts.
   A string occurs again exactly if another anchor shares both classes.

The result is exact: strings are compared by bytes, overlapping and same-document repeats count.
Rows go by a 64-bit hash of id and text.

A core (the bytes that all strings of an anchor share) with very many suffixes is not one group:
its offsets are cut into slices, and within a slice only suffixes that agree on all the bytes that
the slice's strings share meet, at 24 offsets a slice 376 of 400 bytes.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than
`length` are kept; repeated rows are repeats of each other; null ids are kept as ids; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, focus, map_batches, materialize, prepare, remembers, utf8, with_counts


@dataclass(frozen=True)
class SuffixConfig:
    """length: bytes of a string that counts as repeated; window: positions an anchor is chosen
    from; run_rows: suffixes sorted at once in a task; block_rows: suffixes per merge group; words:
    if not 0, strings of that many words and fewer than `length` bytes are sought instead; keep_one:
    of equal strings the one of the least row hash, then place, is no repeat; hot_rows: suffixes of
    one core above which its offsets are sliced, into so many slices."""

    length: int = 400
    window: int = 192
    run_rows: int = 60_000
    block_rows: int = 30_000
    words: int = 0
    keep_one: bool = False
    hot_rows: int = 100_000
    slices: int = 8

    @property
    def core(self) -> int:
        """Bytes after an anchor that every string it stands for contains."""
        return self.length - self.window + 1

    @property
    def key(self) -> int:
        """Bytes of a sort key: the suffix's first `length` bytes and its reversed left context."""
        return self.length + self.window - 1


GRAM = 8
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
remembers("suffixes", _powers.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, grown when a longer text comes."""
    if "up" not in _powers or _powers["up"].size < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def anchors(data: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions with the least and greatest offset x of the starts that belong to them."""
    n = data.size
    if n < config.length:
        none = np.zeros(0, np.int64)
        return none, none, none
    held = n - config.length + config.window
    grams = np.ndarray((held,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(held, dtype=np.uint64)
    span = 1
    while span < config.window:
        step = min(span, config.window - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    at = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [at.size])) - 1
    a = at[first]
    return a, a - last, a - first


def core_hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of the `size` bytes at the given positions."""
    up, down = powers(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    h = (sums[at + size] - sums[at]) * up[at]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two equally long keys that agree in the first `known` bytes."""
    if a[known : known + 8] != b[known : known + 8]:
        while a[known] == b[known]:
            known += 1
        return known
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of equally long keys, each given as (keys, common prefixes with the key before)."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = runs
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
        self.known = [0] * size
        self.at = [0] * size
        self.losers = [0] * size
        winners = [0] * size + [*range(size)]
        for node in range(size - 1, 0, -1):
            winners[node], self.losers[node] = self.play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if size > 1 else 0

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; known prefixes (with the last key put out) decide if they differ."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.known[a], self.known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if p == len(x):
            return (a, b) if a < b else (b, a)
        k = common_prefix(x, y, p)
        if k == len(x):
            a, b = (a, b) if a < b else (b, a)
        elif x[k] > y[k]:
            a, b = b, a
        self.known[b] = k
        return a, b

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in the run, common prefix with the key before) in sorted order."""
        size, losers, play = self.size, self.losers, self.play
        while True:
            r = self.winner
            if self.head[r] is None:
                return
            keys, prefixes = self.runs[r]
            i = self.at[r]
            yield r, i, self.known[r]
            i += 1
            self.at[r] = i
            if i < len(keys):
                self.head[r], self.known[r] = keys[i], prefixes[i]
            else:
                self.head[r] = None
            node = (size + r) // 2
            while node:
                r, losers[node] = play(r, losers[node])
                node //= 2
            self.winner = r


def row_prefixes(m: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a byte matrix with the row before (0 for the first)."""
    out = np.zeros(m.shape[0], np.int64)
    for s in range(1, m.shape[0], 8192):
        e = min(s + 8192, m.shape[0])
        differ = m[s:e] != m[s - 1 : e - 1]
        out[s:e] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return out


def front_code(keys: np.ndarray, kid: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray) -> bytes:
    """A sorted block: common prefixes, tails, the suffixes' places and whether others equal them, compressed."""
    prefix = row_prefixes(keys)
    tails = keys[np.arange(keys.shape[1])[None, :] >= prefix[:, None]].tobytes()
    parts = [x.astype(kind).tobytes() for x, kind in zip((prefix, kid, at, low, high, many), FIELDS, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", keys.shape[0]) + b"".join(parts) + tails)


#: Types of the columns of a block.
FIELDS = ("<u2", "<i8", "<i4", "<u2", "<u2", "u1")


def front_decode(block: bytes, width: int) -> tuple[list[bytes], list[int], list[np.ndarray]]:
    """Keys, common prefixes, and kid, at, low, high, many of a block."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    (n,) = struct.unpack_from("<I", raw)
    cols, o = [], 4
    for kind in FIELDS:
        cols.append(np.frombuffer(raw, kind, n, o))
        o += cols[-1].nbytes
    keys, key = [], b""
    for p in cols[0].tolist():
        end = o + width - p
        key = key[:p] + raw[o:end]
        keys.append(key)
        o = end
    return keys, cols[0].tolist(), cols[1:]


def repeated_offsets(
    prefix: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, many: np.ndarray, rank: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in sorted order: runs of offsets x whose string occurs at another suffix too.

    prefix: common prefix of each key with the one before; left: reversed left contexts;
    low, high: offsets that belong to each anchor; many: whether more suffixes equal this one. Returns
    (member's group, first x, last x) of each run and the group of every member; members with one
    key and range form a group. With a rank, only strings that occur at a suffix of lesser rank
    count, and every member is a group of its own."""
    width = length + left.shape[1]
    same = np.cumsum(prefix < width)
    if rank is None:
        _, first, group, count = np.unique((same * 4096 + low) * 4096 + high, return_index=True, return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(group, many, count.size) > 0)
    else:
        first = group = np.arange(same.size)
        many = np.zeros(same.size, bool)
    # groups come in key order, as the key number leads
    own, left, low, high = same[first], left[first], low[first], high[first]
    starts = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1])))
    right = np.where(np.concatenate(([True], own[1:] != own[:-1])), np.minimum(prefix[starts][own - own[0]], length), length)
    m = own.size
    order = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    left_prefix = row_prefixes(left[order])
    found = np.zeros((m, int(high.max()) + 2), bool)
    classes = np.empty(m, np.int64)
    for x in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= x) & (x <= high))
        if not here.size:
            continue
        classes[order] = np.cumsum(left_prefix < x)
        key = (np.cumsum(right < length - x) * (m + 1) + classes)[here]
        by = np.argsort(key, kind="stable") if rank is None else np.lexsort((rank[here], key))
        sorted_key = key[by]
        equal = sorted_key[1:] == sorted_key[:-1]
        again = np.zeros(here.size, bool)
        again[by[1:]] |= equal
        if rank is None:
            again[by[:-1]] |= equal
        found[here, x] = again | many[here]
    edges = np.diff(found.astype(np.int8), axis=1, prepend=0)
    who, begin = np.nonzero(edges == 1)
    _, stop = np.nonzero(edges == -1)
    return who, begin, stop - 1, group


def merge_blocks(blocks: list[bytes], config: SuffixConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge front-coded runs and return (kid, first byte, end) of the repeated ranges."""
    runs = [front_decode(b, config.key) for b in blocks]
    order = list(LoserTree([(r[0], r[1]) for r in runs]).merged())
    run, place, prefix = (np.array(c, np.int64) for c in zip(*order, strict=True))
    offset = np.concatenate(([0], np.cumsum([len(r[0]) for r in runs])))[:-1]
    source = offset[run] + place
    kid, at, low, high, many = (np.concatenate([r[2][k] for r in runs])[source].astype(np.int64) for k in range(5))
    left = np.frombuffer(b"".join([runs[r][0][i][config.length :] for r, i, _ in order]), np.uint8).reshape(len(order), -1)
    rank = None
    if config.keep_one:
        rank = np.empty(kid.size, np.int64)
        rank[np.lexsort((at, kid))] = np.arange(kid.size)
    who, begin, stop, group = repeated_offsets(prefix, left, low, high, config.length, many, rank)
    members = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    each = sizes[who]
    inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    row = members[np.repeat(start[who], each) + inner]
    return kid[row], at[row] - np.repeat(stop, each), at[row] - np.repeat(begin, each) + config.length


def keyed(docs: DataFrame) -> DataFrame:
    """kid (hash of id and text; equal rows share it), doc_id, text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("kid"), "doc_id", "text")


def find_anchors(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """kid, at, h of every anchor."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        kids, ats, hashes = [], [], []
        for kid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(utf8(text), np.uint8)
            a, _, _ = anchors(data, config)
            if a.size:
                kids.append(np.full(a.size, kid, np.int64))
                ats.append(a)
                hashes.append(core_hashes(data, a, config.core).view(np.int64))
        if not kids:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kids)), pa.array(np.concatenate(ats).astype(np.int32)), pa.array(np.concatenate(hashes))], names=["kid", "at", "h"])

    return map_batches(keyed(docs).select("kid", "text"), run, "kid bigint, at int, h bigint")


def packed_texts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """kid, doc_id, z and the named other columns: texts compressed one by one, so that shuffles
    carry fewer bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        z = pa.array([pack(utf8(t)) for t in batch.column(2).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), z, *batch.columns[3:]], names=["kid", "doc_id", "z", *carry])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("kid"), "doc_id", "text", *carry)
    return map_batches(rows, run, ", ".join(["kid bigint", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", "z binary", *kinds]))


def sorted_runs(candidates: DataFrame, groups: int, config: SuffixConfig) -> DataFrame:
    """pid, block: front-coded runs of the candidate suffixes (rows: kid, z, ats); from pid `groups` on,
    ranges already known to be repeats (kids, begins, stops)."""

    def blocks(chunks: list[tuple]) -> pa.RecordBatch:
        keys, kid, at, low, high, pid = (np.concatenate(c) for c in zip(*chunks, strict=True))
        big = lambda x, kind, n: x.astype(kind).view(np.uint8).reshape(-1, n)
        led = np.concatenate((big(pid, ">u4", 4), keys, big(low, ">u2", 2), big(high, ">u2", 2)), axis=1)
        rows = led.tobytes()
        width = led.shape[1]
        order = np.array(sorted(range(kid.size), key=[rows[i * width : (i + 1) * width] for i in range(kid.size)].__getitem__))
        # equal suffixes with equal offsets: the one of least hash and place goes on, all are repeats
        number = np.cumsum(row_prefixes(led[order]) < width) - 1
        order = order[np.lexsort((at[order], kid[order], number))]
        size = np.bincount(number)
        lead = np.concatenate(([0], np.cumsum(size)))[:-1]
        gone = size[number] > 1
        if config.keep_one:
            gone[lead] = False
            size = np.ones(size.size, np.int64)
        known, order = order[gone], order[lead]
        pids = pid[order]
        cuts = np.flatnonzero(np.concatenate(([True], pids[1:] != pids[:-1], [True])))
        out = [(int(pids[s]), front_code(keys[o := order[s:e]], kid[o], at[o], low[o], high[o], size[s:e] > 1)) for s, e in zip(cuts, cuts[1:], strict=False)]
        if known.size:
            ranges = np.stack((kid[known], at[known] - high[known], at[known] - low[known] + config.length))
            out.append((groups + int(kid[known[0]] % groups), zstandard.ZstdCompressor(level=1).compress(ranges.astype("<i8").tobytes())))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["pid", "block"])

    def sort_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        padded = np.concatenate((np.zeros(config.window - 1, np.uint8), data, np.zeros(config.length, np.uint8)))
        view = np.lib.stride_tricks.sliding_window_view(padded, config.key)[at]
        return np.concatenate((view[:, config.window - 1 :], view[:, config.window - 2 :: -1]), axis=1)

    def parts(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        """keys, at, low, high, pid of suffixes; of hot ones once for each slice of their offsets."""
        for s in range(0, at.size, config.run_rows):
            p = slice(s, s + config.run_rows)
            a, l, h = (x[p][~hot[p]] for x in (at, low, high))
            yield sort_keys(data, a), a, l, h, core_hashes(data, a, config.core)
        step = -(-config.window // config.slices)
        for s in range(0, at.size if hot.any() else 0, config.run_rows):
            p = slice(s, s + config.run_rows)
            for first in range(0, config.window, step):
                last = min(first + step, config.window) - 1
                some = hot[p] & (low[p] <= last) & (high[p] >= first)
                a, l, h = at[p][some], np.maximum(low[p][some], first), np.minimum(high[p][some], last)
                keys = sort_keys(data, a)
                # beyond these bytes no string of the slice reaches
                keys[:, config.length - first : config.length] = 0
                keys[:, config.length + last :] = 0
                name = core_hashes(data, a - first, config.length - last + first)
                yield keys, a, l, h, name + np.uint64(first) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        focus("suffixes")
        unpack = zstandard.ZstdDecompressor()
        chunks, rows = [], 0
        for batch in batches:
            for kid, z, ats in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = np.frombuffer(unpack.decompress(z), np.uint8)
                a, low, high = anchors(data, config)
                wanted = np.array([x["at"] for x in ats])
                keep = np.isin(a, wanted)
                a, low, high = a[keep], low[keep], high[keep]
                hot = np.isin(a, wanted[[x["hot"] for x in ats]])
                for keys, at, l, h, name in parts(data, a, low, high, hot):
                    if not at.size:
                        continue
                    pid = (name % np.uint64(groups)).astype(np.int64)
                    chunks.append((keys, np.full(at.size, kid, np.int64), at, l, h, pid))
                    rows += at.size
                    if rows >= config.run_rows:
                        yield blocks(chunks)
                        chunks, rows = [], 0
        if chunks:
            yield blocks(chunks)

    return candidates.select("kid", "z", "ats").mapInArrow(run, "pid int, block binary")


def short_strings(data: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, np.ndarray]:
    """Begins and stops of the strings of `words` words with fewer than `length` bytes."""
    word = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    begin, stop = edges[::2], edges[1::2]
    begin, stop = begin[: max(0, begin.size - config.words + 1)], stop[config.words - 1 :]
    short = stop - begin < config.length
    return begin[short], stop[short]


def short_repeats(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """kid and ranges as in repeated_ranges, of the short strings that occur again. They are few and
    are grouped as they are."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for kid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = utf8(text)
            begin, stop = short_strings(np.frombuffer(data, np.uint8), config)
            out += [(kid, b, e, data[b:e]) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
        if not out:
            return None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["kid", "begin", "stop", "w"])

    found = materialize(docs.sparkSession, map_batches(keyed(docs).select("kid", "text"), run, "kid bigint, begin bigint, stop bigint, w binary"))
    twice = found.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("kid", "begin")).alias("first")).where("n > 1")
    again = with_counts(found, twice, "w")
    if config.keep_one:
        again = again.where((F.col("kid") != F.col("first.kid")) | (F.col("begin") != F.col("first.begin")))
    return again.groupBy("kid").agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))


def repeated_ranges(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """kid and the ranges (array of begin, stop) of its text that are covered by repeated strings."""
    spark = docs.sparkSession
    prepare(spark)
    marks = materialize(spark, find_anchors(docs, config))
    twice = marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    place = F.struct("at", (F.col("n") > config.hot_rows).alias("hot"))
    ats = materialize(spark, with_counts(marks, twice, "h").groupBy("kid").agg(F.collect_set(place).alias("ats")))
    discard(marks)
    sliced = F.size(F.filter("ats", lambda x: x["hot"])) * (config.slices - 1)
    total = ats.agg(F.sum(F.size("ats") + sliced).alias("n")).first().n or 0
    groups = max(1, -(-total // config.block_rows))
    runs = sorted_runs(packed_texts(docs).hint("merge").join(ats, "kid"), groups, config)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        if key[0].as_py() >= groups:
            unpack = zstandard.ZstdDecompressor().decompress
            kid, begin, stop = np.concatenate([np.frombuffer(unpack(b), "<i8").reshape(3, -1) for b in blocks], axis=1)
        else:
            kid, begin, stop = merge_blocks(blocks, config)
        return pa.table({"kid": kid, "begin": begin.astype(np.int64), "stop": stop.astype(np.int64)})

    found = runs.groupBy("pid").applyInArrow(merge, "kid bigint, begin bigint, stop bigint")
    return found.groupBy("kid").agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))


def united(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges that the given ones cover together."""
    out: list[tuple[int, int]] = []
    for begin, stop in sorted((r["begin"], r["stop"]) for r in ranges or []):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((begin, stop))
    return out


def remove_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges), kept (remaining bytes) and the named
    other columns of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialize(docs.sparkSession, (short_repeats if config.words else repeated_ranges)(docs, config))
    # a broadcast of few ranges would put two Python workers into one task
    joined = packed_texts(docs, carry).hint("merge").join(found, "kid", "left").select("doc_id", "z", "ranges", *carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        sizes, spans, kept = [], [], []
        for z, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = unpack.decompress(z)
            cover = united(ranges)
            edges = [0, *(e for r in cover for e in r), len(data)]
            sizes.append(len(data))
            spans.append([{"begin": b, "stop": e} for b, e in cover])
            kept.append(b"".join([data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)]))
        span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
        own = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([*own, *batch.columns[3:]], names=["doc_id", "n_bytes", "spans", "kept", *carry])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry]
    return map_batches(joined, run, ", ".join([f"doc_id {kind}", "n_bytes bigint", "spans array<struct<begin:bigint,stop:bigint>>", "kept binary", *kinds]))


def brute_force(texts: list[str | None], length: int, order: list[int] | None = None) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 by a table of all strings; for tests. With an order
    (rank of each text) the first occurrence of a string stays."""
    places: dict[bytes, list[tuple[int, int]]] = {}
    raw = [utf8(t) for t in texts]
    rank = order or [0] * len(raw)
    for k, b in zip(rank, raw, strict=True):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((k, i))
    out = []
    for k, b in zip(rank, raw, strict=True):
        again = [i for i in range(len(b) - length + 1) if len(p := places[b[i : i + length]]) > 1 and (order is None or min(p) != (k, i))]
        cover = united([{"begin": i, "stop": i + length} for i in again])
        edges = [0, *(e for r in cover for e in r), len(b)]
        kept = b"".join(b[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
        out.append((len(b), len(b) - len(kept), len(cover), hashlib.sha256(kept).hexdigest()))
    return out
