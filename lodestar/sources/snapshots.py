"""Snapshots of a graph on disk: tables beside each other, and numbered manifests of which the newest counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators.fingerprints import root
from lodestar.sources.versions import newest, publish

FORMAT = 1


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the current snapshot is; None where there is none."""
    return newest(spark, folder)


def payload_fingerprint(tables: dict[str, DataFrame]) -> str:
    """One line for all tables: the root of each one's hash tree, all columns being its key."""
    return ";".join(f"{name}:{root(frame.distinct(), frame.columns)}" for name, frame in sorted(tables.items()))


def write_snapshot(spark: SparkSession, folder: str, tables: dict[str, DataFrame], source: str, built_at: str) -> dict:
    """Write ``tables`` beside those of earlier snapshots, then let the manifest name them; readers see the old or the new one.

    ``source`` is the fingerprint of what the tables were made from.  ``Conflict`` if another writer came first.
    """
    before = newest(spark, folder) or {"version": 0}
    path = f"data-{uuid.uuid4().hex}"
    for name, frame in tables.items():
        frame.write.parquet(f"{folder}/{path}/{name}")
    written = {name: spark.read.parquet(f"{folder}/{path}/{name}") for name in tables}
    told = {"format": FORMAT, "source": source, "payload": payload_fingerprint(written), "built_at": built_at, "tables": sorted(tables), "path": path}
    return publish(spark, folder, told, before["version"] + 1)


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables that the manifest names."""
    told = manifest(spark, folder)
    return told and {name: spark.read.parquet(f"{folder}/{told['path']}/{name}") for name in told["tables"]}


def freshness(spark: SparkSession, folder: str, source: str) -> str:
    """``absent``, ``stale`` (another source, format or changed tables) or ``fresh``."""
    told = manifest(spark, folder)
    if told is None:
        return "absent"
    if (told["format"], told["source"]) != (FORMAT, source):
        return "stale"
    return "fresh" if payload_fingerprint(read_snapshot(spark, folder)) == told["payload"] else "stale"


def ensure_snapshot(spark: SparkSession, folder: str, build: Callable[[], dict[str, DataFrame]], source: str, built_at: str) -> dict[str, DataFrame]:
    """The current tables, built by ``build`` (a function without arguments) only where they are not fresh."""
    if freshness(spark, folder, source) != "fresh":
        write_snapshot(spark, folder, build(), source, built_at)
    return read_snapshot(spark, folder)
