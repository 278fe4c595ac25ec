"""Small set, scope and lookup operators that pipelines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ranking import numbered


def in_scope(cards: DataFrame, scope: str) -> DataFrame:
    """Cards (``slug, domains``) of a scope: ``all``, ``domain:<slug>``, or one card's slug."""
    if scope == "all":
        return cards
    return cards.where(F.array_contains("domains", scope.partition(":")[2])) if scope.startswith("domain:") else cards.where(F.col("slug") == scope)


def children(parents: DataFrame) -> DataFrame:
    """``parent, child, place``: children of each parent in order, as rows; no parent's children are gathered in one task."""
    return numbered(parents.select("parent", "child").distinct(), ["parent"], ["child"]).withColumn("place", F.col("place").cast("int"))


def resolved(references: DataFrame, works: DataFrame) -> DataFrame:
    """``ref, slug, kind``: what a reference (``ref``) is in the library (``id, slug``), else a source of the project."""
    hit = references.join(works.select(F.col("id").alias("ref"), "slug"), "ref", "left")
    return hit.select("ref", "slug", F.when(F.col("slug").isNull(), "project-source").otherwise("work").alias("kind"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; all of a row's columns come from it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_first", place).where("_first = 1").drop("_first")


def drilled(works: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """``claim, place, total``: claims of ranked works (``work, place``) by the works' places and then by id, ``most`` of ``total``; only edges called claims count."""
    found = edges.where("kind = 'claims'").join(F.broadcast(works), F.col("src") == F.col("work")).select(F.col("dst").alias("claim"), "place")
    total = found.count()
    return found.orderBy("place", "claim").limit(most).withColumn("total", F.lit(total).cast("long"))


def misplaced_observations(observations: DataFrame, judgments: DataFrame, materials: DataFrame) -> DataFrame:
    """``observation, problem``: observations (``observation, judgment, material``) of a judgment or a material that the project does not declare; a project is sound where there is none."""
    told = observations.join(judgments.select("judgment", F.lit(True).alias("j")), "judgment", "left").join(materials.select("material", F.lit(True).alias("m")), "material", "left")
    return told.select("observation", F.when(F.col("j").isNull(), "judgment").when(F.col("m").isNull(), "material").alias("problem")).where("problem is not null")


def domains_of(groups: DataFrame, closure: DataFrame) -> DataFrame:
    """``group, domain``: every domain that some member (``group, node``) of a group stands under."""
    return groups.join(closure, "node").select("group", "domain").distinct()


def split_by(ids: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """``key, chosen``: ids in a selection, and those beside it."""
    hit = selected.select(key).distinct().withColumn("_hit", F.lit(True))
    return ids.select(key).distinct().join(hit, key, "left").select(key, F.col("_hit").isNotNull().alias("chosen"))


def receipt_state(receipts: DataFrame) -> DataFrame:
    """``request, state``: quarantined for a mismatch, claim material only when acquired, verified and ready, else what is wanting first."""
    state = (
        F.when(F.coalesce("quarantined", F.lit(False)) | (F.col("identity_status") == "mismatch"), "quarantined").when(F.col("acquisition_status") != "acquired", "not_acquired")
        .when(F.col("identity_status") != "verified", "unverified").when(F.col("text_status") != "ready", "no_text").otherwise("eligible")
    )
    return receipts.select("request", state.alias("state"))
