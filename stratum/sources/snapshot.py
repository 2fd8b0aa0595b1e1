"""Text snapshots of surface samples: a magic line, a count line, then `x y z clearance blocked`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format: magic lines of the two versions.
MAGIC_V1, MAGIC_V2 = "NVGNSURF1", "NVGNSURF2"


def snapshot_lines(surfels: DataFrame) -> DataFrame:
    """One text line per sample; the count line is what a reader may check, header lines come first."""
    rows = surfels.select(F.format_string("%.3f %.3f %.3f %.2f %d", "px", "py", "pz", "clearance", F.coalesce("blocked", F.lit(0))).alias("value"))
    return rows


def write_snapshot(surfels: DataFrame, path: str, version: int = 2) -> None:
    """Write a snapshot folder: the header in its own first file, samples in as many parts as the
    data has. Concatenated in name order the files are one snapshot text."""
    spark = surfels.sparkSession
    n = surfels.count()
    head = spark.createDataFrame([(f"{MAGIC_V2 if version == 2 else MAGIC_V1}\n{n}",)], "value string")
    head.coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    rows = snapshot_lines(surfels) if version == 2 else surfels.select(F.format_string("%.3f %.3f %.3f %.2f", "px", "py", "pz", "clearance").alias("value"))
    rows.write.mode("overwrite").text(f"{path}/1-samples")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Samples from text lines (value). Blank lines are skipped, a missing mask counts as 0."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(part.alias("f")).where(F.size("f") >= 4)
    number = lambda k: F.try_element_at("f", F.lit(k)).try_cast("double")
    return rows.select(*[number(k + 1).alias(f"p{a}") for k, a in enumerate("xyz")], number(4).alias("clearance"), F.coalesce(F.try_element_at("f", F.lit(5)).try_cast("int"), F.lit(0)).alias("blocked"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Read a snapshot folder of this writer, or one plain snapshot file of either version."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/0-header")
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        head, lines = spark.read.text(f"{path}/0-header"), spark.read.text(f"{path}/1-samples")
    else:
        head = lines = spark.read.text(path)
    if not head.where(F.col("value").isin(MAGIC_V1, MAGIC_V2)).limit(1).count():
        raise ValueError("not a sample snapshot")
    # magic and count lines hold one field and fall away with the short lines
    return parse_lines(lines)
