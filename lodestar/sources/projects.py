"""Project folders as rows ``project, path, text``: manifests, plans, materials, notes and revisions, joined to one context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import cards as C
from lodestar.sources.vault import CardTable

# Where a project keeps what, and the form of a revision's name.
MANIFEST, PLAN, MATERIALS, NOTES, ANALYSIS = "project.yaml", "outline/brief.json", "materials/materials.json", "research.md", "outline/manuscript-analysis.md"
REVISION = r"^sections/([^/]+)/r(\d{3,})\.md$"
PLAN_FIELDS = "sections array<struct<name:string,depends_on:array<string>>>, evidence array<struct<ref:string,quote:string,anchor:string>>, materials array<string>, style_profile string"
MATERIAL_FIELDS = "array<struct<id:string,path:string,kind:string,vault_claim_eligible:boolean>>"
PROVENANCE = "user observation; review proposal, not a literature Claim"


class Projects:
    """Lazy tables over the files of many projects."""

    def __init__(self, files: DataFrame):
        self.files = files
        notes = files.where(F.col("path") == NOTES).select(F.concat(F.lit("briefs/"), "project", F.lit(".md")).alias("path"), "text")
        self._notes = CardTable(notes)

    def _file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path).select("project", "text")

    def manifests(self) -> DataFrame:
        """``project, fields``: a map of the manifest's flat lines; the first of a repeated key stays."""
        return self._file(MANIFEST).select("project", F.transform_values(C.head_map(C.lines(F.col("text"))), lambda _, v: C.as_scalar(v)).alias("fields"))

    def plans(self) -> DataFrame:
        """``project`` and the fields of its writing brief."""
        return self._file(PLAN).select("project", F.from_json("text", PLAN_FIELDS).alias("b")).select("project", "b.*")

    def materials(self) -> DataFrame:
        """``project, material, path, kind, vault_claim_eligible``."""
        rows = self._file(MATERIALS).select("project", F.explode(F.from_json("text", MATERIAL_FIELDS)).alias("m"))
        return rows.select("project", F.col("m.id").alias("material"), "m.path", "m.kind", "m.vault_claim_eligible")

    def revisions(self) -> DataFrame:
        """``project, section, n, path`` of every stored revision."""
        rows = self.files.where(F.rlike("path", F.lit(REVISION)))
        return rows.select("project", F.regexp_extract("path", REVISION, 1).alias("section"), F.regexp_extract("path", REVISION, 2).cast("int").alias("n"), "path")

    def latest(self) -> DataFrame:
        """``project, section, n, path`` of the newest revision of each section."""
        return self.revisions().groupBy("project", "section").agg(F.max(F.struct("n", "path")).alias("r")).select("project", "section", "r.n", "r.path")

    def judgments(self) -> DataFrame:
        """``project, judgment, statement, dependencies``: an array of the claims and gaps that each judgment rests on."""
        rows = self._notes.table("Synthesis")
        refs = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(",", "claims", "gaps"), ","), lambda x: F.trim(x)), lambda x: x != "-")))
        return rows.select(F.col("card").alias("project"), F.col("id").alias("judgment"), "statement", refs.alias("dependencies"))

    def feedback(self) -> DataFrame:
        """``project, observation, outcome, interpretation, dependencies, problem``: observations with what their judgment rests on.

        ``problem`` names what an observation refers to but its project does not declare; a project is sound where it is null.
        """
        seen = self._notes.table("Observations").select(F.col("card").alias("project"), F.col("id").alias("observation"), F.col("source").alias("material"), "judgment", "outcome", "interpretation")
        known = seen.join(self.judgments().dropDuplicates(["project", "judgment"]), ["project", "judgment"], "left").join(self.materials().select("project", "material", F.lit(True).alias("there")).distinct(), ["project", "material"], "left")
        problem = F.when(F.col("dependencies").isNull(), "judgment").when(F.col("there").isNull(), "material")
        return known.select("project", "observation", "outcome", "interpretation", "dependencies", problem.alias("problem"))

    def styles(self, profiles: DataFrame) -> DataFrame:
        """``project, style, rules``: style profiles (``style, rules``) that the plan, else the manifest, names, separated by semicolons; null rules where there is none."""
        both = self.manifests().join(self.plans().select("project", "style_profile"), "project", "left")
        named = F.coalesce(F.nullif("style_profile", F.lit("")), F.col("fields")["style_profile"], F.lit(""))
        each = both.select("project", F.explode(F.split(named, ";")).alias("style")).select("project", F.regexp_replace(F.trim("style"), r"\.md$", "").alias("style")).where("style <> ''")
        return each.join(profiles, "style", "left").select("project", "style", "rules")

    def context(self, profiles: DataFrame) -> DataFrame:
        """``project, part, item, detail``: all that is known of each project, below each other."""
        text = lambda c: F.coalesce(c, F.lit(""))
        parts = [
            self.manifests().select("project", F.lit("manifest").alias("part"), F.explode("fields").alias("item", "detail")), self.materials().select("project", F.lit("material"), "material", "kind"),
            self.judgments().select("project", F.lit("judgment"), "judgment", F.array_join("dependencies", " ")), self.styles(profiles).select("project", F.lit("style"), "style", text(F.col("rules"))),
            self.feedback().where("problem is null").select("project", F.lit("feedback"), "observation", F.concat_ws(" ", "outcome", F.array_join("dependencies", " "))),
            self.feedback().where("problem is not null").select("project", F.lit("problem"), "observation", "problem"), self.latest().select("project", F.lit("revision"), "section", "path"),
        ]
        return reduce(DataFrame.union, parts)
