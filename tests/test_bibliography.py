"""Readers of provider answers on broken and partial payloads, the cache, and snapshots that drift."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar import plans
from lodestar.operators import fingerprints
from lodestar.plans import records
from lodestar.sources import providers, snapshots, versions


@pytest.mark.parametrize("name", sorted(providers.READERS))
def test_payloads_that_say_nothing_give_nulls(spark, name):
    empty = "<feed/>" if name == "arxiv" else "{}"
    rows = spark.createDataFrame([(empty,), (None,)], "p string").select(providers.READERS[name](F.col("p")).alias("r")).collect()
    for row in rows:
        assert row.r is None or all(row.r[c] in (None, "arXiv", True, []) for c in providers.FIELDS)


def test_openalex_fields(spark):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/X", "display_name": "T", "publication_year": 2020, "cited_by_count": 3, "primary_location": None, "citation_normalized_percentile": {"value": 0.5}, "topics": [{"display_name": "a"}, {"display_name": None}, {}], "referenced_works": ["https://openalex.org/W2", "W3"], "unknown": {"x": 1}}
    frame = spark.createDataFrame([(json.dumps(work),)], "p string")
    r = frame.select(providers.openalex(F.col("p")).alias("r"), providers.references("openalex", F.col("p")).alias("x")).first()
    assert (r.r.openalex, r.r.doi, r.r.percentile, r.r.categories, r.r.preprint, r.r.venue) == ("W1", "10.1/x", 50.0, ["a"], None, None)
    assert [x.openalex for x in r.x] == ["W2", "W3"]
    with pytest.raises(ValueError, match="no references"):
        providers.references("arxiv", F.col("p"))


def test_arxiv_feed_with_a_namespace(spark):
    feed = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v3</id><published>2024-01-02T00:00:00Z</published><title>Two\n  lines</title></entry></feed>'
    r = spark.createDataFrame([(feed,)], "p string").select(providers.arxiv(F.col("p")).alias("r")).first().r
    assert (r.arxiv, r.title, r.year, r.preprint) == ("2401.00001", "Two lines", 2024, True)


def test_cache_keeps_what_a_failed_fetch_would_lose(spark):
    schema = "provider string, url string, fetched_at string, payload string"
    none = spark.createDataFrame([], "provider string, url_sha string, " + schema[len("provider string, ") :])
    cache = providers.with_answers(none, spark.createDataFrame([("p", "u", "1", "old"), ("p", "v", "1", "kept"), ("p", "u", "2", "newer")], schema))
    cache = providers.with_answers(cache, spark.createDataFrame([("p", "u", "3", None), ("p", "w", "3", "new")], schema))
    assert sorted((r.url, r.payload) for r in cache.collect()) == [("u", "newer"), ("v", "kept"), ("w", "new")]
    wanted = spark.createDataFrame([("p", "u"), ("p", "x"), ("q", "u")], "provider string, url string")
    assert sorted((r.provider, r.url, r.payload) for r in providers.answered(wanted, cache).collect()) == [("p", "u", "newer"), ("p", "x", None), ("q", "u", None)]


def test_snapshots_are_built_once_and_drift_is_seen(spark, tmp_path):
    folder, built = f"file://{tmp_path}", []

    def build():
        built.append(1)
        return {"nodes": spark.createDataFrame([(1, "a"), (2, None)], "id int, label string")}

    assert snapshots.read_snapshot(spark, folder) is None
    for _ in range(2):
        tables = snapshots.ensure_snapshot(spark, folder, build, "s1", "t")
    assert len(built) == 1 and tables["nodes"].count() == 2 and snapshots.freshness(spark, folder, "s1") == "fresh"
    path = snapshots.manifest(spark, folder)["path"]
    spark.createDataFrame([(1, "other"), (2, None)], "id int, label string").write.mode("overwrite").parquet(f"{folder}/{path}/nodes")
    assert snapshots.freshness(spark, folder, "s1") == "stale"
    snapshots.ensure_snapshot(spark, folder, build, "s2", "t")
    assert len(built) == 2 and snapshots.freshness(spark, folder, "s2") == "fresh"


def test_hash_trees_see_values_and_not_partitions(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))).alias("x"))
    whole = fingerprints.root(a, ["k"])
    assert whole == fingerprints.root(a.orderBy(F.desc("k")).repartition(13), ["k"])
    swapped = a.withColumn("x", F.when(F.col("k") == 1, "v2").when(F.col("k") == 2, "v1").otherwise(F.col("x")))
    assert len({whole, fingerprints.root(swapped, ["k"]), fingerprints.root(a.na.fill(""), ["k"]), fingerprints.root(a.where("k > 0"), ["k"]), fingerprints.root(a.limit(0), ["k"])}) == 5
    tree = fingerprints.tree(a, ["k"], 2)
    sizes = {r.level: r["count"] for r in tree.groupBy("level").count().collect()}
    assert sizes[0] == 1 and sizes[1] == 256 and sizes[2] > 2000
    differing = tree.join(fingerprints.tree(swapped, ["k"], 2).withColumnRenamed("hash", "other"), ["level", "node"]).where("hash <> other")
    assert {r.level: r["count"] for r in differing.groupBy("level").count().collect()} == {0: 1, 1: 2, 2: 2}


def test_marks_of_parts(spark):
    a = spark.range(500).select(F.col("id").alias("k"), F.lit("x").alias("x"))
    b = a.withColumn("x", F.when(F.col("k") == 77, "y").otherwise(F.col("x")))
    marks = lambda rows: {r.part: r.hash for r in fingerprints.part_marks(rows, ["k"], 16).collect()}
    one, two = marks(a), marks(b.repartition(3))
    assert len(one) == 16 and sum(one[p] != two[p] for p in one) == 1


def test_a_snapshot_is_one_version_or_the_next(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    table = lambda n: {"t": spark.range(n)}
    assert snapshots.manifest(spark, folder) is None and snapshots.freshness(spark, folder, "a") == "absent"
    snapshots.write_snapshot(spark, folder, table(3), "a", "t1")
    old = snapshots.read_snapshot(spark, folder)["t"]
    snapshots.write_snapshot(spark, folder, table(5), "b", "t2")
    assert old.count() == 3 and snapshots.read_snapshot(spark, folder)["t"].count() == 5
    assert snapshots.freshness(spark, folder, "a") == "stale" and snapshots.freshness(spark, folder, "b") == "fresh"
    with pytest.raises(versions.Conflict):
        versions.publish(spark, folder, {}, 2)
    assert versions.newest(spark, folder)["built_at"] == "t2"


def test_tree_queries_have_the_levels_of_their_sql(spark, monkeypatch):
    """Beyond 256 to the third rows, SQL's leaves grow; here with four for 256."""
    monkeypatch.setattr(fingerprints, "FAN", 4)
    db, d = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("orders", *records.PAYLOAD):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    for name in ("k4_orders_fingerprint", "k4_payload_fingerprint"):
        want = db.execute(plans.SQL[name].replace("<= 256", "<= 4").replace("65536", "16")).fetchall()
        assert sorted(map(tuple, plans.QUERIES[name](spark, d).collect())) == sorted(want)
