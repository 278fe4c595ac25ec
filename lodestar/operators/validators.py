"""What is wrong with research records: rows of ``id, problem, detail``, none for a sound record.

Rules within a record are column expressions; references to other records are anti-joins, so an index of any size
is never gathered.  Records are rows with an ``id`` and the fields that a function names; a null field is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies and limits of the records.
DIMENSIONS = ("theory", "mechanism", "method", "data", "evaluation", "empirical-finding", "system-integration", "application-transfer", "scale-generalization")
SOURCE, MATERIAL = "project-source:", "material:"
REFERENCES = ("claim:", "work:", "gap:", "concept:", "transfer:", "domain:", SOURCE)
PROJECT_KINDS = ("paper", "proposal")
MATERIAL_KINDS = ("draft", "data", "figure", "solicitation", "reviewer-comments", "other")
HOPS, MOST_EXTERNAL = 1, 20
ASSEMBLED = "assembled"
LINE_ENDS = "[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _blank(c: str | Column) -> Column:
    """Missing or empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) == ""


def _items(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast("array<string>"))


def _starts(x: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in prefixes])


def _when(bad: Column, problem: str, detail: Column | None = None) -> Column:
    """One problem where ``bad`` is true."""
    one = F.struct(F.lit(problem).alias("problem"), F.coalesce(detail.cast("string") if detail is not None else F.lit(""), F.lit("")).alias("detail"))
    return F.when(F.coalesce(bad, F.lit(False)), F.array(one)).otherwise(F.array().cast("array<struct<problem:string,detail:string>>"))


def _each(items: Column, problem: str) -> Column:
    """One problem for each item."""
    return F.transform(items, lambda x: F.struct(F.lit(problem).alias("problem"), F.coalesce(x.cast("string"), F.lit("")).alias("detail")))


def _rows(records: DataFrame, *rules: Column) -> DataFrame:
    return records.select("id", F.explode(F.concat(*rules)).alias("p")).select("id", "p.*")


def _profile_rules() -> list[Column]:
    chosen = _items("dimensions")
    return [
        _when(_blank("project_id"), "missing", F.lit("project_id")), _when(F.size(chosen) == 0, "no dimension selected"),
        _each(F.filter(chosen, lambda x: ~F.coalesce(x.isin(*DIMENSIONS), F.lit(False))), "unknown dimension"), _when(F.size(F.array_distinct(chosen)) != F.size(chosen), "repeated dimension"),
    ]


def profile_problems(profiles: DataFrame) -> DataFrame:
    """Of ``project_id, dimensions``: nothing may be claimed as new outside sound, selected dimensions."""
    return _rows(profiles, *_profile_rules())


def _request_rules(of: str = "") -> list[Column]:
    most = F.col(f"{of}max_candidates")
    return [
        *[_when(_blank(f"{of}{k}"), "missing", F.lit(k)) for k in ("session_id", "scope", "date")], _when(~F.col(f"{of}hops").eqNullSafe(F.lit(HOPS)), "not one hop"),
        _when(~F.coalesce(most.between(1, MOST_EXTERNAL), F.lit(False)), "candidates out of bounds"), _when(~F.coalesce(F.col(f"{of}user_confirmed"), F.lit(False)), "not confirmed"),
    ]


def request_problems(requests: DataFrame) -> DataFrame:
    """Of ``session_id, scope, date, hops, max_candidates, user_confirmed``: an opt-in to look beyond the library."""
    return _rows(requests, *_request_rules())


def source_problems(sources: DataFrame) -> DataFrame:
    """Of ``kind, ref, verified, project_local, auto_ingest``: a source that only a project knows."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return _rows(
        sources, _when(~F.col("kind").eqNullSafe(F.lit("project-source")), "wrong kind", F.col("kind")), _when(~F.coalesce(F.startswith("ref", F.lit(SOURCE)), F.lit(False)), "wrong ref", F.col("ref")),
        _when(~yes("verified"), "not verified"), _when(~yes("project_local"), "not local"), _when(~F.col("auto_ingest").eqNullSafe(F.lit(False)), "would ingest"),
    )


def assessment_problems(assessments: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Of an idea: its profile, ``minimal_experiment, falsifiers``, references ``supporting, opposing, closest_prior_work``, ``novelty`` (a map) and ``external`` (a request).

    References must look like ids and, where ``nodes`` (``id``) are given, name one, but for sources of the project.
    """
    verdicts = F.coalesce(F.col("novelty"), F.create_map().cast("map<string,string>"))
    dims = F.array_sort(F.map_keys(verdicts))
    refs = {f: _items(f) for f in ("supporting", "opposing", "closest_prior_work")}

    def misshapen(field: str) -> Column:
        wrong = F.filter(refs[field], lambda x: ~F.coalesce(_starts(x, REFERENCES), F.lit(False)))
        return _each(F.transform(wrong, lambda x: F.concat_ws(" ", F.lit(field), x)), "no id")

    own = _rows(
        assessments, *_profile_rules(), _when(_blank("minimal_experiment"), "missing", F.lit("minimal_experiment")), _when(F.size(_items("falsifiers")) == 0, "missing", F.lit("falsifiers")), *map(misshapen, refs),
        _each(F.filter(dims, lambda d: ~F.array_contains(_items("dimensions"), d)), "verdict on a dimension not selected"), _each(F.filter(dims, lambda d: _blank(verdicts[d])), "empty verdict"),
        _when(F.col("external").isNotNull() & (F.size(F.concat(*_request_rules("external."))) > 0), "external without a confirmed request"),
    )
    if nodes is None:
        return own
    each = reduce(DataFrame.union, [assessments.select("id", F.lit(f).alias("field"), F.explode(r).alias("ref")) for f, r in refs.items()])
    asked = each.where(_starts(F.col("ref"), REFERENCES) & ~F.startswith("ref", F.lit(SOURCE)))
    lost = asked.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti")
    return own.union(lost.select("id", F.lit("not in the index"), F.concat_ws(" ", "field", "ref")))


def project_problems(projects: DataFrame) -> DataFrame:
    """Of ``slug, kind, audience, venue, language, length, citation_style, style_profile, status``."""
    fields = ("slug", "kind", "audience", "venue", "language", "length", "citation_style", "style_profile", "status")
    return _rows(
        projects, _when(~F.coalesce(F.rlike("slug", F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")), F.lit(False)), "bad slug", F.col("slug")), _when(~F.coalesce(F.col("kind").isin(*PROJECT_KINDS), F.lit(False)), "unknown kind", F.col("kind")),
        *[_when(_blank(k), "missing", F.lit(k)) for k in ("audience", "citation_style")], *[_when(F.rlike(k, F.lit(LINE_ENDS)), "several lines", F.lit(k)) for k in fields],
    )


def material_problems(materials: DataFrame) -> DataFrame:
    """Of ``material, path, kind, vault_claim_eligible``: what a project writes from, never evidence of the library."""
    name, path = F.coalesce("material", F.lit("")), F.coalesce("path", F.lit(""))
    outside = (path == "") | F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("\\")) | F.array_contains(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), "..")
    return _rows(
        materials, _when(~F.startswith(name, F.lit(MATERIAL)) | (name == MATERIAL), "bad id", name), _when(outside, "path outside the project", path),
        _when(~F.coalesce(F.col("kind").isin(*MATERIAL_KINDS), F.lit(False)), "unknown kind", F.col("kind")), _when(~F.col("vault_claim_eligible").eqNullSafe(F.lit(False)), "eligible as evidence"),
    )


def brief_problems(briefs: DataFrame) -> DataFrame:
    """Of ``sections`` (``name, depends_on``), ``evidence`` (``ref, quote, anchor``) and ``materials``: a plan that can be written from."""
    sections = F.coalesce("sections", F.array().cast("array<struct<name:string,depends_on:array<string>>>"))
    evidence = F.coalesce("evidence", F.array().cast("array<struct<ref:string,quote:string,anchor:string>>"))
    names = F.transform(sections, lambda s: F.coalesce(s["name"], F.lit("")))
    wanted = F.flatten(F.transform(sections, lambda s: F.transform(F.filter(_items(s["depends_on"]), lambda x: ~F.array_contains(names, x)), lambda x: F.concat_ws(" ", s["name"], x))))
    ref = lambda e: F.coalesce(e["ref"], F.lit(""))
    numbered = F.transform(evidence, lambda e, i: F.struct(i.cast("string").alias("i"), e.alias("e")))
    where = lambda bad: F.transform(F.filter(numbered, lambda x: bad(x["e"])), lambda x: x["i"])
    return _rows(
        briefs, _when(F.size(sections) == 0, "no sections"), _when((F.size(F.array_distinct(names)) != F.size(names)) | F.array_contains(names, ""), "section names missing or repeated"),
        _when(F.array_contains(names, ASSEMBLED), "reserved section name"), _each(wanted, "depends on no section"),
        _each(where(lambda e: F.startswith(ref(e), F.lit(MATERIAL))), "material as evidence"), _each(where(lambda e: ~_starts(ref(e), (MATERIAL, *REFERENCES))), "no id"),
        _each(where(lambda e: _blank(e["quote"])), "no quote"), _each(where(lambda e: _blank(e["anchor"])), "no anchor"),
        _each(F.filter(_items("materials"), lambda m: ~F.startswith(m, F.lit(MATERIAL))), "bad material"),
    )
