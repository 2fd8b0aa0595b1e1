"""Session-level helpers: worker import path and tables in the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Folder that holds the package; Python workers started from elsewhere import it from here.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Rows of an Arrow batch. Spark's default would make batches of tens of megabytes of text, held
#: several times over on both sides; a session that sets another number keeps it.
BATCH_ROWS, DEFAULT_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


#: Whether Spark deletes the shuffle files of a finished command.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers of this session import the package: by path where they see the driver's
    folder, else from an archive that Spark sends along with the tasks. Batches for them are small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_ROWS, ROWS)
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in paths:
        return
    context.environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    if not is_local(spark):
        context.addPyFile(archive())


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def archive() -> str:
    """The package as a zip file in the driver's temporary folder."""
    path = os.path.join(tempfile.mkdtemp(prefix="stratum-"), "stratum.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "stratum")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    return path


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by spark.checkpoint.dir; a local one only where none is set and the
    session runs in one process (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/stratum-checkpoints"


def scratch_path(spark: SparkSession) -> str:
    """A new name in the scratch folder."""
    return f"{scratch_dir(spark)}/stratum-{uuid.uuid4().hex}"


#: How scratch tables are written: part files only. In a local folder Hadoop forks a chmod for every file,
#: checksum file and folder, and a JVM that forks counts twice for a moment where memory is read by process.
SCRATCH = {
    "compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back.

    The files outlive any executor, so a lost one never forces the stages above to rerun. What was
    shuffled for them goes at once, not when the driver next collects its garbage."""
    path = scratch_path(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**SCRATCH).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by shuffles only.

    Spark guesses sizes from compressed files and does not count the rows that explode adds, so
    that millions of rows may look small enough to be gathered on the driver and sent to all."""
    return left.join(right.hint("merge"), on, how)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
