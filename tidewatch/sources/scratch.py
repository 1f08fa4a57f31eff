"""New folders for tables that a query writes and reads back; they go with the session at the latest."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession) -> str:
    """Under `spark.checkpoint.dir`; a temporary one only where it is unset and the master local."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
    if not _made:
        atexit.register(_at_exit)
    _made.append((spark, path := f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read as often as it is used; for tables much smaller than what they come from."""
    df.write.parquet(path := new_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """To be given to release()."""
    return len(_made)


def release(since: int = 0) -> None:
    """Deletes the folders made since the mark: when the results that read them have been written or taken."""
    for spark, path in _made[since:]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _made[since:]


def _at_exit() -> None:
    try:
        if _made and _made[0][0].sparkContext._jvm is not None:
            release()
    except Exception:  # the session has ended: nothing to delete with
        return
