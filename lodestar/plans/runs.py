"""Queries of expansion runs with state: resumed after a failure, reviewed, and sharing one pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.runs import ExpansionRun
from lodestar.plans.changes import AT, NEIGHBOURS, SEEDS, WALK, neighbours, seeds, walk_sql
from lodestar.plans.registry import query
from lodestar.sources.star import Star
from lodestar.sources.stored import state_folder, stored

OTHER_SEEDS = [7, 30, 31]
RECORDS = "rec AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'title:' ELSE 'doi:10.1/' END || p_partkey AS key, p_name AS title FROM part)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """``key`` and what is known of each part as a record."""
    part = Star(spark, d).table("part")
    number, none = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    doi = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("10.1/"), number))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("title:"), number))
    return part.select(key.alias("key"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"), doi.alias("doi"), none.alias("openalex"), none.alias("arxiv"))


@query(f"WITH {WALK} {AT}")
def g7_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run whose driver is lost twice, after a level was written but not committed and after one was: the rows of an unbroken walk."""
    near, records, state = stored(neighbours(spark, d)), _records(spark, d), state_folder(spark, "expansion")
    lost = ExpansionRun.start(spark, state, "run", "all", seeds(spark, SEEDS), pool_parts=4)
    lost.write_level(near)
    ExpansionRun.resume(spark, state, "run", pool_parts=4).step(near, records)
    run = ExpansionRun.resume(spark, state, "run", records, pool_parts=4)
    run.execute(near, records)
    return run.found().withColumn("at", F.array_join("at", "."))


@query(f"""WITH {WALK}, {RECORDS}, seen AS (SELECT key, count(*) AS n_occurrences FROM walk_met GROUP BY key), new AS (SELECT item AS key, row_number() OVER (ORDER BY pos) AS r FROM walk WHERE kind = 'new')
SELECT key, title, n_occurrences, CASE WHEN r <= 2 THEN 'selected' WHEN r % 2 = 0 THEN 'deferred' END AS decision, 50 AS max_new, (SELECT count(*) FROM new) AS used,
  CASE WHEN (SELECT count(*) FROM new) >= 50 THEN 'budget_reached' ELSE 'frontier_exhausted' END AS stop_reason FROM new JOIN rec USING (key) JOIN seen USING (key)""")
def q7_reviewed_run(spark: SparkSession, d: str) -> DataFrame:
    """The batch of a finished run, after decisions on some of it: the first two as exploratory picks."""
    run = ExpansionRun.start(spark, state_folder(spark, "expansion"), "run", "all", seeds(spark, SEEDS), pool_parts=4)
    run.execute(stored(neighbours(spark, d)), _records(spark, d))
    found = [r.item for r in run.found().where("kind = 'new'").orderBy("at").select("item").collect()]  # the budget's length
    made = [(key, "selected", True) if i < 3 else (key, "deferred", False) for i, key in enumerate(found, 1) if i < 3 or i % 2 == 0]
    run.apply_decisions(spark.createDataFrame(made, "key string, decision string, exploratory boolean"))
    return run.review_batch()


@query(f"""WITH {NEIGHBOURS}, {walk_sql("a", SEEDS)}, {walk_sql("b", OTHER_SEEDS, "SELECT DISTINCT key FROM a_met")}, {RECORDS},
met AS (SELECT *, 'a' AS run FROM a_met UNION ALL SELECT *, 'b' FROM b_met)
SELECT key, any_value(title) AS title, bool_or(key LIKE 'doi:%') AS verified, count(DISTINCT run) AS runs, count(*) AS n_occurrences FROM met JOIN rec USING (key) GROUP BY key""")
def k13_shared_pool(spark: SparkSession, d: str) -> DataFrame:
    """Two runs that share a pool: the second counts nothing as new that the first met, and adds its occurrences."""
    near, records, state = stored(neighbours(spark, d)), _records(spark, d), state_folder(spark, "expansion")
    for name, keys in (("a", SEEDS), ("b", OTHER_SEEDS)):
        run = ExpansionRun.start(spark, state, name, "all", seeds(spark, keys), pool_parts=4)
        run.execute(near, records)
    seen = run.pool.occurrences.read().groupBy("key").agg(F.count_distinct("run").alias("runs"), F.count(F.lit(1)).alias("n_occurrences"))
    return run.pool.candidates.read().join(seen, "key").select("key", "title", "verified", "runs", "n_occurrences")
