"""Tables and folders that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own if Spark is one local process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path there, deleted with the others."""
    path = f"{root(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet and read again: later steps and lost executors only repeat reads."""
    path = folder(frame.sparkSession, name)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.scratch_path = path
    return out


def free(frame: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more."""
    _delete(frame.scratch_path)


def tables() -> set[str]:
    """What is there now."""
    return set(_made)


def clean(keep: set[str] | frozenset[str] = frozenset()) -> None:
    """Deletes what was made but for ``keep``; results that read it must be written by then."""
    for path in set(_made) - keep:
        _delete(path)


def _delete(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(clean)
