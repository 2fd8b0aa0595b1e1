"""Language identification with language-bitmask n-gram filters.

The model is a bit-sliced Bloom filter: every position holds a bit mask with one bit per
language, so hashing an n-gram to a few positions and and-ing their masks returns all the
languages that contain it at once. A text's hits are counted per language (popcounts), each
count is corrected for that language's false-positive rate, and the largest decides.

Defined results: `und` with score 0.0 for a null text, a text without a letter, or when no
labelled row was there to learn from; a text with letters of which no n-gram is known gets the
most frequent learned language with score 0.0; ties go to the alphabetically first language. Every
language with a labelled row is learned, however rare. A null id counts as held out.
Whole texts are read; repeated rows and extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import focus, map_batches, prepare

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageConfig:
    """sample_rows: labelled rows to learn from per language, expected number, of which equal texts
    count once; grams: n-gram sizes in letters; min_share: share of a language's sampled texts an
    n-gram must occur in; contrast: least ratio of that share to the n-gram's largest share in any
    language; few: with fewer sampled texts a language keeps all its n-grams, whatever their share,
    and has no say in the contrast of others; max_grams: n-grams kept per language, most widespread
    first; bits: log2 of the filter's positions; hashes: positions per n-gram."""

    sample_rows: int = 3_000
    grams: tuple[int, ...] = (3, 4)
    min_share: float = 0.002
    contrast: float = 0.3
    few: int = 50
    max_grams: int = 30_000
    bits: int = 20
    hashes: int = 3


_letters: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """True at every code point that is a letter; one table per worker."""
    if "t" not in _letters:
        _letters["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _letters["t"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed multipliers of a public splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of all letter n-grams; every run of other characters counts as one blank.

    Empty when the text has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    out = []
    for n in sizes:
        if x.size < n:
            continue
        h = np.full(x.size - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + x[k : x.size - n + 1 + k]
        out.append(h)
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


@dataclass
class LanguageFilters:
    """languages, sorted; masks: positions x words of 64 languages; false_rate, by language;
    prior: index of the most frequent language."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    prior: int
    config: LanguageConfig

    def positions(self, h: np.ndarray):
        size = np.uint64((1 << self.config.bits) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(self.config.hashes):
            yield ((h + np.uint64(k) * step) & size).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the bit mask of the languages that contain it."""
        out = None
        for at in self.positions(h):
            out = self.masks[at] if out is None else out & self.masks[at]
        return out

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Occurrences that each language knows, corrected for false positives."""
        found = self.lookup(h)
        hits = np.array([np.count_nonzero(found[:, k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(self.languages))], np.float64)
        return np.maximum(0.0, (hits - h.size * self.false_rate) / (1.0 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, its share among the corrected counts, and the share of the text's n-grams it knows."""
        h = gram_hashes(text, self.config.grams) if text and self.languages else np.zeros(0, np.uint64)
        if not h.size:
            return UNDETERMINED, 0.0, 0.0
        n = self.counts(h)
        total = float(n.sum())
        if total <= 0.0:
            return self.languages[self.prior], 0.0, 0.0
        best = int(n.argmax())
        return self.languages[best], min(1.0, float(n[best]) / total), min(1.0, float(n[best]) / h.size)


def held_out(doc_id: Column) -> Column:
    """Rows that must not be learned from: crc32 of the id as text divisible by five, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit(rows: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageFilters:
    """Learn from rows (text, lang). Of a language with many rows about config.sample_rows are used,
    chosen by a hash of the text so that every run and every layout picks the same ones; equal
    texts of a language count once.

    N-gram document frequencies are summed per task before the shuffle; the driver receives at
    most max_grams hashes per language."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    shares = [(lang, int(min(1.0, config.sample_rows / n) * (1 << 32))) for lang, n in sizes.items()]
    kept = rows.sparkSession.createDataFrame(shares, "lang string, kept bigint")  # one row per language
    h = F.xxhash64("text")
    rows = rows.join(F.broadcast(kept), "lang").where(F.pmod(h, F.lit(1 << 32)) < F.col("kept"))
    rows = rows.groupBy("lang", h.alias("h")).agg(F.first("text").alias("text")).select("text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(np.unique(gram_hashes(text, config.grams)))
        langs, hashes, counts = [], [], []
        for lang, found in by.items():
            h, n = np.unique(np.concatenate(found), return_counts=True)
            langs += [lang] * (h.size + 1)
            hashes.append(np.append(h.view(np.int64), 0))
            counts.append(np.append(n, 0))
            # the row of hash 0 with null n-gram below carries the number of texts
            counts[-1][-1] = len(found)
        last = np.cumsum([x.size for x in hashes]) - 1
        mask = np.zeros(len(langs), bool)
        mask[last] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(hashes), pa.int64(), mask=mask), pa.array(np.concatenate(counts), pa.int64())],
            names=["lang", "gram", "n"],
        )

    from pyspark.sql import Window

    grams = map_batches(rows, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    texts = grams.where("gram is null").select("lang", F.col("n").alias("texts"))
    widest = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rare = F.col("texts") < config.few
    known = (
        grams.where("gram is not null").join(F.broadcast(texts), "lang")  # one row per language
        .withColumn("share", F.col("n") / F.col("texts"))
        .where(rare | (F.col("n") >= 2) & (F.col("share") >= config.min_share))
        .withColumn("top", F.max(F.when(~rare, F.col("share"))).over(Window.partitionBy("gram")))
        .where(rare | (F.col("share") >= F.col("top") * config.contrast))
        .withColumn("r", F.row_number().over(widest)).where(F.col("r") <= config.max_grams)
        .groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    )
    found = {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in known.collect()}
    return build({lang: found.get(lang, np.zeros(0, np.uint64)) for lang in sizes}, sizes, config)


def build(grams: dict[str, np.ndarray], sizes: dict[str, int], config: LanguageConfig) -> LanguageFilters:
    """Bit-sliced filter of the n-gram hashes of each language."""
    languages = sorted(grams)
    masks = np.zeros((1 << config.bits, max(1, -(-len(languages) // 64))), np.uint64)
    prior = max(range(len(languages)), key=lambda k: (sizes.get(languages[k], 0), -k), default=0)
    out = LanguageFilters(languages, masks, np.zeros(len(languages)), prior, config)
    for k, lang in enumerate(languages):
        for at in out.positions(grams[lang]):
            masks[at, k >> 6] |= np.uint64(1 << (k & 63))
    for k in range(len(languages)):
        filled = np.count_nonzero(masks[:, k >> 6] & np.uint64(1 << (k & 63))) / masks.shape[0]
        out.false_rate[k] = filled**config.hashes
    return out


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """doc_id, lang_pred, score, coverage of every row of docs; a map without a shuffle.

    The broadcast model has a fixed size: positions times one word per 64 languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64())))],
            names=["doc_id", "lang_pred", "score", "coverage"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, lang_pred string, score double, coverage double")


def keep_identified(docs: DataFrame, model: LanguageFilters, least_coverage: float = 0.25) -> DataFrame:
    """The rows, with all their columns, whose language can be told: the text has letters and its
    language knows at least least_coverage of its n-grams. A model without languages keeps every
    text that has a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for t in batch.column(text).to_pylist():
            if shared.value.languages:
                lang, _, coverage = shared.value.predict(t)
                keep.append(lang != UNDETERMINED and coverage >= least_coverage)
            else:
                keep.append(bool(t) and any(c.isalpha() for c in t))
        return batch.filter(pa.array(keep, pa.bool_()))

    prepare(docs.sparkSession)

    def filtered(batches):
        focus("langid")
        yield from map(run, batches)

    return docs.mapInArrow(filtered, docs.schema)
