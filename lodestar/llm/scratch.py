"""Tables written to the folder that all executors share.

Lineage is cut by writing a Parquet table and reading it again: a lost executor then costs a
re-read, never a recomputation of everything before it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class _Written(threading.local):
    """Tables written by this thread: queries in other threads keep theirs."""

    def __init__(self):
        self.paths: list[str] = []


_WRITTEN = _Written()


def unused(stem: str, *columns: str) -> str:
    """``stem``, lengthened until no column has that name, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in a local session."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lodestar-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that only already materialised ones were made from."""
    for table in tables:
        if (path := getattr(table, "scratch_path", None)) in _WRITTEN.paths:
            _WRITTEN.paths.remove(path)
            _delete(table.sparkSession, path)


def written() -> int:
    """A mark of what has been written so far, for ``discard_since``."""
    return len(_WRITTEN.paths)


def discard_since(mark: int, spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the tables written after ``mark`` but ``keep``, from which everything still to come is made."""
    kept = {t.scratch_path for t in keep if hasattr(t, "scratch_path")}
    for path in [p for p in _WRITTEN.paths[mark:] if p not in kept]:
        _WRITTEN.paths.remove(path)
        _delete(spark, path)

