"""Expansion runs that survive their driver: each level is written, then committed by one manifest.

A run's folder holds one version a level (``sources.versions``).  A level that was written but not
committed is never read, so a run resumed after any failure walks it again and gets the same rows.  Which
candidates count as new is told by the shared pool as it was when the run began, and by the run's own levels.
The pool is merged after each commit; merging a level again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import expansion
from lodestar.sources.versions import KeyedTable, newest, publish

STOP_REASONS = ("budget_reached", "frontier_exhausted", "user_stop")
RECORD = ("title", "year", "doi", "openalex", "arxiv")


def _first_known(old: DataFrame, new: DataFrame) -> DataFrame:
    """Candidates of both, what the older one knows before what the newer one does."""
    both = old.alias("o").join(new.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")
    either = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in RECORD]
    return both.select(F.coalesce("o.key", "n.key").alias("key"), *either, (F.coalesce("o.verified", F.lit(False)) | F.coalesce("n.verified", F.lit(False))).alias("verified"))


class Pool:
    """Candidates of all runs, where they were met, and what each scope decided of them: three keyed tables."""

    def __init__(self, spark: SparkSession, state: str, parts: int = 64):
        table = lambda name, keys: KeyedTable(spark, f"{state}/expansion/{name}", keys, parts)
        self.candidates = table("candidates", ["key"])
        self.occurrences = table("occurrences", ["key", "run", "via", "direction", "depth"])
        self.decisions = table("decisions", ["key", "scope"])

    def upsert(self, met: DataFrame, records: DataFrame, run_id: str) -> None:
        """Merge what a level met (``key, via, direction, depth``) and its ``records`` (``key`` and ``RECORD``); idempotent."""
        ids = F.col("doi").isNotNull() | F.col("openalex").isNotNull() | F.col("arxiv").isNotNull()
        known = records.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(*[F.min(c).alias(c) for c in RECORD])
        self.candidates.merge(known.withColumn("verified", ids), _first_known)
        self.occurrences.merge(met.select("key", F.lit(run_id).alias("run"), "via", "direction", "depth").distinct())

    def decide(self, made: DataFrame, batch: DataFrame, scope: str) -> None:
        """Record the decisions ``made`` (``key, decision, exploratory``) on a reviewed ``batch`` (``key``) for a scope, within the rules of ``expansion.apply_decisions``."""
        before = self.decisions.read()
        empty = made.select("key", F.lit(scope).alias("scope"), "decision", "exploratory").limit(0)
        expansion.apply_decisions(empty if before is None else before, made, batch, scope)  # raises where a rule is broken
        self.decisions.merge(made.select("key", F.lit(scope).alias("scope"), "decision", "exploratory"))


class ExpansionRun:
    """One bounded walk, level by level; ``start`` it once, ``resume`` it by its id from any driver."""

    def __init__(self, spark: SparkSession, state: str, run_id: str, pool_parts: int = 64):
        self.spark, self.state, self.run_id = spark, state.rstrip("/"), run_id
        self.folder = f"{self.state}/expansion/runs/{run_id}"
        self.pool = Pool(spark, self.state, pool_parts)
        self.told: dict = {}

    @classmethod
    def start(cls, spark: SparkSession, state: str, run_id: str, scope: str, seeds: DataFrame, depth: int = expansion.DEPTH, max_new: int = expansion.MAX_NEW, pool_parts: int = 64) -> ExpansionRun:
        """A new run from ``seeds`` (``node, seq``); ``Conflict`` if there is one of that id."""
        if not run_id or not scope:
            raise ValueError("run_and_scope_required")
        if not 1 <= int(depth) <= expansion.DEPTH or not 1 <= int(max_new) <= expansion.MAX_NEW:
            raise ValueError("out_of_bounds")
        if seeds.isEmpty():
            raise ValueError("no_seeds")
        run = cls(spark, state, run_id, pool_parts)
        data = f"data-{uuid.uuid4().hex}"
        frontier = seeds.groupBy("node").agg(F.array(F.min("seq").cast("long")).alias("at"))
        frontier.write.parquet(f"{run.folder}/{data}/frontier")
        told = {"scope": scope, "depth": int(depth), "max_new": int(max_new), "pool_version": run.pool.candidates.version(), "levels": [], "frontiers": [data], "used": 0, "stop_reason": None}
        run.told = publish(spark, run.folder, told, 1)
        return run

    @classmethod
    def resume(cls, spark: SparkSession, state: str, run_id: str, records: DataFrame | None = None, pool_parts: int = 64) -> ExpansionRun:
        """The run as its newest manifest tells it; its last level is merged into the pool again if ``records`` are given."""
        run = cls(spark, state, run_id, pool_parts)
        told = newest(spark, run.folder)
        if told is None:
            raise ValueError("unknown_run")
        run.told = told
        if records is not None and told["levels"]:
            run.pool.upsert(run._read(told["levels"][-1], "met"), records, run_id)
        return run

    def _read(self, data: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{data}/{name}")

    def _all(self, places: list[str], name: str) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{p}/{name}" for p in places]) if places else None

    @property
    def stopped(self) -> str | None:
        return self.told["stop_reason"]

    def found(self) -> DataFrame | None:
        """``kind, item, via, direction, depth, at`` of all committed levels; None before the first."""
        return self._all(self.told["levels"], "found")

    def warnings(self) -> DataFrame | None:
        """``warning`` of all committed levels."""
        return self._all(self.told["levels"], "warnings")

    def expanded(self) -> DataFrame | None:
        """``node`` of those walked to their end."""
        return self._all(self.told["levels"], "expanded")

    def frontier(self) -> DataFrame:
        """``node, at`` of what would be walked next."""
        return self._read(self.told["frontiers"][-1], "frontier")

    def write_level(self, neighbours: DataFrame, identified: DataFrame | None = None) -> dict:
        """Walk and write the next level without committing it; returns the manifest that would."""
        told, n = self.told, len(self.told["levels"]) + 1
        pinned = self.pool.candidates.read(told["pool_version"])
        own = self.found()
        keys = [f.select("key") for f in (pinned, own and own.where("kind <> 'hit'").withColumnRenamed("item", "key")) if f is not None]
        known = keys[0].union(keys[1]) if len(keys) == 2 else keys[0] if keys else None
        walked = self._all(told["frontiers"], "frontier").select("node").distinct()
        met = expansion.level(self.frontier(), neighbours, n, told["max_new"] - told["used"], known, walked, identified, n == told["depth"])
        data = f"data-{uuid.uuid4().hex}"
        for name in ("found", "met", "warnings", "expanded", "frontier"):
            getattr(met, name).write.parquet(f"{self.folder}/{data}/{name}")
        used = told["used"] + met.used
        over = n == told["depth"] or self._read(data, "frontier").isEmpty()
        reason = "budget_reached" if used >= told["max_new"] else "frontier_exhausted" if over else None
        return told | {"levels": [*told["levels"], data], "frontiers": [*told["frontiers"], data], "used": used, "stop_reason": reason}

    def step(self, neighbours: DataFrame, records: DataFrame | None = None, identified: DataFrame | None = None) -> bool:
        """Walk, commit and merge one level; False once the run has stopped.  ``Conflict`` if another driver committed it."""
        if self.stopped:
            return False
        self.told = publish(self.spark, self.folder, self.write_level(neighbours, identified), self.told["version"] + 1)
        if records is not None:
            self.pool.upsert(self._read(self.told["levels"][-1], "met"), records, self.run_id)
        return not self.stopped

    def execute(self, neighbours: DataFrame, records: DataFrame | None = None, identified: DataFrame | None = None) -> str:
        """Walk until the run stops; the reason."""
        while self.step(neighbours, records, identified):
            pass
        return self.stopped

    def stop(self, reason: str = "user_stop") -> None:
        """Commit that the run has stopped."""
        if reason not in STOP_REASONS:
            raise ValueError("stop_reason")
        self.told = publish(self.spark, self.folder, self.told | {"stop_reason": reason}, self.told["version"] + 1)

    def review_batch(self) -> DataFrame:
        """``key, title, n_occurrences, decision, max_new, used, stop_reason`` of the run's new verified candidates, from the pool."""
        seen = self.pool.occurrences.read().groupBy("key").agg(F.count(F.lit(1)).alias("n_occurrences"))
        candidates = self.pool.candidates.read().join(seen, "key")
        decisions = self.pool.decisions.read()
        none = candidates.select("key", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("decision")).limit(0)
        batch = expansion.review_batch(self.found(), candidates, none if decisions is None else decisions, self.told["scope"], self.told["max_new"])
        return batch.withColumn("stop_reason", F.lit(self.stopped))

    def apply_decisions(self, made: DataFrame) -> None:
        """Decisions on this run's batch, for its scope."""
        self.pool.decide(made, self.found().where("kind = 'new'").select(F.col("item").alias("key")), self.told["scope"])
