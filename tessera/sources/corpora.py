"""Named corpora, Parquet globs, held-out shards, guarded writes and checkpoint folders."""

from __future__ import annotations

import logging
import os.path
import uuid
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Corpus:
    """``root`` has a folder for each split; ``glob`` picks its files."""

    root: str
    glob: str = "*.parquet"


class Catalog:
    """Corpora by name."""

    def __init__(self, corpora: dict[str, Corpus]):
        self.corpora = dict(corpora)

    def scan(self, spark: SparkSession, name: str, *, config: str | None = None, split: str = "train") -> DataFrame:
        if name not in self.corpora:
            raise ValueError(f"no corpus {name!r}; there are {', '.join(sorted(self.corpora))}")
        corpus = self.corpora[name]
        at = "/".join(x for x in (corpus.root.rstrip("/"), config, split) if x)
        return spark.read.option("pathGlobFilter", corpus.glob).parquet(at)


def matching(spark: SparkSession, pattern: str | list[str]) -> int:
    """Number of files and folders that a pattern matches; a warning for each pattern without any."""
    jvm, found = spark.sparkContext._jvm, 0
    for one in [pattern] if isinstance(pattern, str) else pattern:
        at = jvm.org.apache.hadoop.fs.Path(one)
        n = len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or [])
        if n == 0:
            LOG.warning("%s matches no file", one)
        found += n
    return found


def scan_glob(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """All matching files are one split; held-out shards have to be kept out by the pattern."""
    matching(spark, pattern)
    return spark.read.parquet(*([pattern] if isinstance(pattern, str) else pattern))


def shards(df: DataFrame) -> int:
    """Number of files that a scan reads."""
    return df.select(F.col("_metadata.file_path").alias("f")).distinct().count()


def ordered(df: DataFrame) -> DataFrame:
    """Adds order_key: file path and position in the file, for corpora without an id."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("order_key"))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a file scan in order of files and places, without a sort: only the files that hold them are read.

    Rows are counted by file without reading a column; the driver sees a name
    and a count a file, and the last file is cut by its rows' numbers.
    """
    spark, file = df.sparkSession, F.col("_metadata.file_path")
    counts = sorted((r["f"], r["n"]) for r in df.groupBy(file.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect())
    whole, left = [], n
    for name, rows in counts:
        if left <= 0:
            break
        whole.append((name, min(rows, left)))
        left -= rows
    if not whole:
        return df.limit(0)
    read = lambda names: spark.read.schema(df.schema).parquet(*names)
    *full, (last, rest) = whole
    cut = read([last]).where(F.col("_metadata.row_index") < rest)
    return read([name for name, _ in full]).unionByName(cut) if full else cut


def place(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Scheme, store and folders of a path, as the file system that it belongs to names it; local links and ``..`` are resolved."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.expanduser(path))
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    local = uri.getScheme() == "file"
    folders = Path(uri.getPath()).resolve().parts if local else PurePosixPath(os.path.normpath(uri.getPath() or "/")).parts
    return (uri.getScheme(), uri.getAuthority() or "", *folders)


def write_guarded(df: DataFrame, path: str, *, protected: list[str], overwrite: bool = False) -> None:
    """Refuses roots, the home and working folders, protected folders and every folder above these, however a path spells them.

    A table is replaced by renaming: the new one is written beside it, and a
    write that fails leaves the old one whole. What the new one is read from
    cannot be replaced by it.
    """
    spark = df.sparkSession
    target = place(spark, path)
    if len(target) <= 3:
        raise ValueError(f"{path} is a root folder")
    for name in [Path.home().as_uri(), Path.cwd().as_uri(), *protected]:
        if place(spark, name)[: len(target)] == target:
            raise ValueError(f"{path} holds {name}; choose another folder")
    if not overwrite:
        df.write.mode("errorifexists").parquet(path)
        return
    if any(place(spark, name)[: len(target)] == target for name in df.inputFiles()):
        raise ValueError(f"{path} is read by what is to replace it")
    jvm = spark.sparkContext._jvm
    name = lambda suffix: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{suffix}")
    mark = uuid.uuid4().hex
    final, new, old = name(""), name(f".new-{mark}"), name(f".old-{mark}")
    store = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
        if store.exists(final) and not store.rename(final, old):
            raise OSError(f"{path} cannot be renamed")
        if not store.rename(new, final):
            store.rename(old, final)
            raise OSError(f"{path} cannot be put in place")
        store.delete(old, True)
    finally:
        store.delete(new, True)


def checkpoint_steps(spark: SparkSession, root: str) -> list[int]:
    """All-digit folder names in ascending order; a missing root has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(n) for n in names if n.isascii() and n.isdigit())


def resolve_step(steps: list[int], step: int | None) -> int | None:
    if step is not None and steps and step not in steps:
        raise ValueError(f"step {step} was not written; there are {', '.join(map(str, steps))}")
    return step


def log_table(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a table log; missing ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
