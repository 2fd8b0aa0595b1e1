"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

Terms are the lower-cased words of a text, weighted 1 + ln(count). For every term and sample
number, hashes give r and c (gamma distributed with shape 2) and beta (uniform). With
t = floor(ln(weight) / r + beta) the sample of a text is the term of least
ln(c) - r * (t - beta + 1), together with t: two texts draw the same sample with a probability
equal to their generalised Jaccard similarity. A fingerprint holds SAMPLES of them.

One shuffle deals the documents into ranges of ids, one range to a task, with the first document
of the next range as a visitor at the end. So the next document is a window function away, and
every later grouping (by range and document) finds its rows in place. The ranges hold about equal
numbers of rows, however uneven the ids: their bounds are quantiles of the ids, and rows of one id
or of none are cut by a hash of the text.

Defined results: null texts count as empty; a text without words has an empty fingerprint, alike
to another empty one (1.0) and to no other (0.0); the edit of a text shorter than four code
points changes nothing; ids are whole numbers, ordered ascending, null first, ties by a hash of the
text; repeated rows each get a row; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
LANES = 4
#: Documents that share one range of ids, about, and most ranges; larger ranges are spilled sorts.
RANGE_ROWS = 4000
MOST_RANGES = 10_000
#: What of ln(a) is kept below the decimal point, and bits of a sample's name.
STEPS, NAME_BITS = 1 << 20, 24


def ranged(rows: DataFrame) -> tuple[DataFrame, int]:
    """bin of every row (doc_id, h, ...) and the number of bins. Bins are numbered from 0 in the
    order of (doc_id, h), and none is empty."""
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, part = ends.low if ends.low is not None else 0, F.col("h") / F.lit(float(1 << 32))
    # never falls in the order of (doc_id, h): whole numbers stay exact, or go without the hash
    above = (F.col("doc_id") - F.lit(low)).cast("double") + 1
    exact = ends.high is None or ends.high - low < 1 << 53
    key = F.when(F.col("doc_id").isNull(), part).otherwise(above * (1 << 32) + F.col("h") if exact else above)
    rows = rows.withColumn("key", key)
    count = min(MOST_RANGES, -(-ends.n // RANGE_ROWS))
    cuts: list[float] = []
    if count > 1:
        found = rows.agg(F.min("key").alias("least"), F.percentile_approx("key", [k / count for k in range(1, count)], 20 * count).alias("cuts")).first()
        cuts = sorted({x for x in found.cuts if x > found.least})
    # a cut is found among every tenth or so, then inside that stretch
    step = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    at = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<double>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("key")))
    if not cuts:
        return rows.withColumn("bin", F.lit(0)), 1
    rows = rows.withColumn("stretch", F.greatest(below(at([x[0] for x in stretches])) - 1, F.lit(0)))
    inside = F.element_at(F.array(*[at(x) for x in stretches]), F.col("stretch") + 1)
    # never null, so that the plan needs no filter on it and both readers share one shuffle
    return rows.withColumn("bin", F.coalesce((F.col("stretch") * step + below(inside)).cast("int"), F.lit(0))), len(cuts) + 1


def dealt(docs: DataFrame) -> DataFrame:
    """bin, place, visitor, doc_id, text, lead (text of the next document) of every row; a visitor is
    the next bin's first row, shown once more at the end."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 32).alias("h"))
    rows, bins = ranged(rows)
    rows = rows.select("bin", F.lit(False).alias("visitor"), "doc_id", "h", "text")
    head = rows.groupBy("bin").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h", "text")).alias("head"))
    heads = head.select(F.coalesce(F.pmod(F.col("bin") - 1, F.lit(bins)).cast("int"), F.lit(0)).alias("bin"), F.lit(True).alias("visitor"), "head.doc_id", "head.h", "head.text")
    own = Window.partitionBy("bin").orderBy("visitor", "doc_id", "h", "text")
    placed = rows.unionByName(heads).repartitionById(bins, "bin")
    return placed.withColumn("place", F.row_number().over(own)).withColumn("lead", F.lead("text").over(own))


def drawn(term: Column, weight: Column, k: Column) -> Column:
    """Sample k of a weighted term as one integer: ln(a) in the high bits, a name of (term, t) below."""
    def uniform(h: Column, part: int) -> Column:
        return (F.shiftrightunsigned(h, 21 * part).bitwiseAND((1 << 21) - 1) + F.lit(0.5)) / F.lit(float(1 << 21))

    first, second = F.xxhash64(term, k), F.xxhash64(term, k, F.lit(1))
    r = -F.log(uniform(first, 0) * uniform(first, 1))
    c = -F.log(uniform(second, 0) * uniform(second, 1))
    beta = uniform(first, 2)
    t = F.floor(F.log(weight) / r + beta)
    value = F.log(c) - r * (t - beta + 1)
    return F.floor(value * STEPS).cast("long") * (1 << NAME_BITS) + F.xxhash64(term, t).bitwiseAND((1 << NAME_BITS) - 1)


def fingerprints(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys and fingerprint of every row of texts that has words. Rows with equal keys are one text."""
    words = texts.select(*keys, F.explode(F.split(F.lower(column), r"[\s\p{Punct}]+")).alias("word")).where("word <> ''")
    terms = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))
    lanes = terms.select(*keys, "term", (F.lit(1.0) + F.log(F.col("n"))).alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // LANES - 1))).alias("k"))
    mins = lanes.groupBy(*keys, "k").agg(*[F.min(drawn(F.col("term"), F.col("weight"), F.col("k") * LANES + j)).alias(f"s{j}") for j in range(LANES)])
    name = lambda c: F.lpad(F.lower(F.hex(F.col(c).bitwiseAND((1 << NAME_BITS) - 1))), NAME_BITS // 4, "0")
    parts = mins.select(*keys, F.struct("k", F.concat(*[name(f"s{j}") for j in range(LANES)]).alias("p")).alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["p"]), "").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    size = NAME_BITS // 4
    equal = sum(((F.substring(a, 1 + size * k, size) == F.substring(b, 1 + size * k, size)).cast("int") for k in range(SAMPLES)), F.lit(0))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(equal / F.lit(float(SAMPLES)))


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = dealt(docs.select("doc_id", "text"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("lead", F.lit("")), F.lit(1), cut))
    both = rows.select("bin", "place", "visitor", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(~F.col("visitor"), edited).alias("edited"))
    sides = both.select("bin", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprints(sides.select("bin", "place", F.col("x.side").alias("side"), F.col("x.text").alias("text")).where("text is not null"), ["bin", "place", "side"])
    pairs = prints.groupBy("bin", "place").agg(F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("f"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("e"))
    whole = both.select("bin", "place", "visitor", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(pairs, ["bin", "place"], "left")
    whole = whole.withColumn("fingerprint", F.coalesce("f", F.lit(""))).withColumn("edited_fingerprint", F.coalesce("e", F.lit("")))
    after = whole.withColumn("after", F.lead("fingerprint").over(Window.partitionBy("bin").orderBy("place")))
    return after.where("not visitor").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )
