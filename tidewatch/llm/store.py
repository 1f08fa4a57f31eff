"""Where intermediate tables go, and session limits for Arrow batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker; a longer text is a batch of its own.
BATCH_ROWS = 256
BATCH_BYTES = 2 << 20
#: Bytes of a Parquet row group, which its writer holds in memory.
GROUP_BYTES = 16 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where it is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quoted(name: str) -> str:
    """A column name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A name for an own column that none of df's has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with the session."""
    path = f"{shared_folder(spark)}/tidewatch/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """df as it is where it gives the same rows in the same order each time it is read: where its rows come from files,
    ranges or an RDD without a shuffle. Anything else is staged, such as a cached table, whose lost parts may be made anew."""
    plans = df._jdf.queryExecution()
    leaves = plans.optimizedPlan().collectLeaves()

    def steady(leaf) -> bool:
        kind = leaf.getClass().getSimpleName()
        return "Shuffle" not in leaf.rdd().toDebugString() if kind == "LogicalRDD" else kind in ("LogicalRelation", "Range", "LocalRelation", "OneRowRelation$")

    return df if all(steady(leaves.apply(i)) for i in range(leaves.size())) and "Exchange" not in plans.executedPlan().toString() else staged(df)


def freed(*tables: DataFrame) -> None:
    """Deletes staged tables whose every consumer has been staged itself, or given its rows to the driver."""
    for df in tables:
        entry = (df.sparkSession, df._staged_at)
        _written.remove(entry)
        _delete(*entry)


def mark() -> int:
    """To be given to freed_since()."""
    return len(_written)


def freed_since(start: int, kept: DataFrame) -> None:
    """Deletes what has been staged since the mark but for one table, in which all of it has been used up."""
    for entry in _written[start:]:
        if entry[1] != kept._staged_at:
            _written.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jvm is None:
                return
            _delete(spark, path)
        except Exception:  # the session has ended: nothing to clean with
            return
