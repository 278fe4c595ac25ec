"""Tables that several frames read: written once as Parquet where every executor can read them, and state between queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset in a local session, an error on a cluster."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not told and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if told:
        return told.rstrip("/")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lodestar-"))
    return f"file://{_LOCAL[0]}"


def stored(df: DataFrame) -> DataFrame:
    """A scan of ``df`` written to the shared folder: later frames see its size and read only the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; others are left alone."""
    for table in tables:
        if path := getattr(table, "stored_path", None):
            place = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            table.stored_path = None


def state_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stored state, within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
