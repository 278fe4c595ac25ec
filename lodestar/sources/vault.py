"""A folder of Markdown cards as typed tables.

Works, gaps, transfers and briefs are one file each, read whole and parsed inside their row; the two
registries are single files.  Nothing is repaired silently: what does not parse comes out as a row of
``problems``, and the rest of its card stays.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import cards as C
from lodestar.operators.fingerprints import tree
from lodestar.sources.stored import stored

# The vocabulary that cards are written in.
AXES = ("domain", "task", "pattern", "function", "method", "metric", "failure-mode")
GAP_RELATIONS = ("identifies", "supports", "partially_addresses", "disputes", "reframes")
TABLES = {
    "Argument": ("role", "claim", "paraphrase", "attribution", "scope"),
    "Conditions": ("dimension", "value", "evidence"),
    "Evidence relations": ("claim", "relation", "target", "attribution", "comparison", "scope", "rationale"),
    "Synthesis": ("id", "statement", "claims", "gaps", "rationale"),
    "Observations": ("id", "source", "judgment", "outcome", "interpretation"),
}
ARGUMENT_ROLES = ("problem", "advance", "remaining")
RELATIONS = (*GAP_RELATIONS, "same_question", "overlaps", "broader_than", "narrower_than", "different_question")
ATTRIBUTIONS = ("author", "system")
COMPARISONS = ("direct_response", "retrospective")
OUTCOMES = ("supports", "questions", "inconclusive")
BRIEF_KEYS = ("topic", "domain", "date", "view")
CARD_FIELDS = ("source", "journal_if", "citations", "citations_date", "year", "domain", "weight")
#: Which cards hold which tables.
HELD = {"papers": ("Argument", "Conditions", "Evidence relations"), "gaps": ("Synthesis",), "transfers": ("Synthesis",), "briefs": ("Synthesis",)}

#: A gap and, after the last colon, its relation.
GAP_ENTRY = r"(?s)^(.*):([^:]*)$"
CARD = "origin string, slug string, text string"


def _reported(items: Column, problem: Callable[[Column], Column], detail: Callable[[Column], Column]) -> Column:
    """``array<struct<problem, detail>>`` of the items that are not null."""
    return F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.struct(problem(x).alias("problem"), detail(x).cast("string").alias("detail")))


def _head_problems(head: Column) -> Column:
    wrong = F.filter(C.head_entries(head), lambda e: e["key"].isNull() | e["again"])
    return _reported(wrong, lambda e: F.when(e["key"].isNull(), "unparseable line").otherwise("repeated key"), lambda e: F.coalesce(e["key"], e["line"]))


def _claim_problems(claims: Column, gone: Column) -> list[Column]:
    """Repeated numbers, claims without an anchor, retractions of claims that are not there."""
    numbers, taken_back = F.transform(claims, lambda c: c["n"]), F.transform(gone, lambda r: r["n"])
    again = lambda all_n: F.filter(F.transform(all_n, lambda n, i: F.when(F.array_position(all_n, n) <= i, n)), lambda n: n.isNotNull())
    return [
        _reported(again(numbers), lambda n: F.lit("repeated claim"), lambda n: n),
        _reported(F.filter(claims, lambda c: c["anchor"].isNull()), lambda c: F.lit("claim without anchor"), lambda c: c["n"]),
        _reported(again(taken_back), lambda n: F.lit("repeated retraction"), lambda n: n),
        _reported(F.array_except(taken_back, numbers), lambda n: F.lit("retraction of no claim"), lambda n: n),
    ]


def _role_problems(roles: Column) -> Column:
    wrong = F.filter(roles, lambda r: r["role"].isNull() | r["again"])
    return _reported(wrong, lambda r: F.when(r["role"].isNull(), "bad profile line").otherwise("repeated role"), lambda r: F.coalesce(r["role"], r["line"]))


class Vault:
    """Lazy tables over one vault; a missing folder or registry file gives empty ones.

    Spark lists no files without a byte, so an empty card has no row anywhere, and no share in the fingerprint.
    """

    def __init__(self, spark: SparkSession, folder: str, only: DataFrame | None = None):
        self.spark, self.folder, self.only = spark, folder.rstrip("/"), only
        self._kept: dict[tuple[str, str], DataFrame] = {}

    def keep(self) -> Vault:
        """The same vault with its cards cut, and the rows of their tables read, once for all that is asked of it."""
        kept = copy.copy(self)
        kept._kept = {}
        with ThreadPoolExecutor(len(HELD)) as pool:  # small jobs beside each other
            kept._kept |= dict(zip([("cards", k) for k in HELD], pool.map(lambda k: stored(self.cards(k)), HELD), strict=True))
            kept._kept |= dict(zip([("rows", k) for k in HELD], pool.map(lambda k: stored(kept._rows(k)), HELD), strict=True))
        return kept

    def _exists(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def files(self, kind: str) -> DataFrame:
        """``origin, slug, text`` of the cards of a kind, without its ``INDEX.md``; folders below are not looked into."""
        if not self._exists(f"{self.folder}/{kind}"):
            return self.spark.createDataFrame([], CARD)
        # not the text reader, which has no row for an empty file
        read = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{self.folder}/{kind}")
        found = read.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("content").cast("string").alias("text")).where("name <> 'INDEX.md'")
        found = found.select(F.concat(F.lit(f"{kind}/"), "name").alias("origin"), F.regexp_replace("name", r"\.md$", "").alias("slug"), "text")
        return found if self.only is None else found.join(self.only.select(F.col("path").alias("origin")), "origin", "left_semi")

    def within(self, paths: DataFrame) -> Vault:
        """The same vault with the cards of ``path`` only; registries always count."""
        return Vault(self.spark, self.folder, paths)

    def cards(self, kind: str) -> DataFrame:
        """``origin, slug, head, body, problem, fields``: cards cut into front matter and body.

        A brief needs no front matter, and only a few of its keys count.
        """
        if ("cards", kind) in self._kept:
            return self._kept["cards", kind]
        cut = self.files(kind).select("origin", "slug", "text", C.card_parts(F.col("text")).alias("p")).select("origin", "slug", "text", "p.head", "p.body", "p.problem")
        if kind == "briefs":
            begun = F.startswith("text", F.lit("---\n"))
            known = F.filter("head", lambda x: F.rlike(x, F.lit(f"^({'|'.join(BRIEF_KEYS)}):")))
            cut = cut.withColumn("body", F.when(begun, F.col("body")).otherwise(C.lines(F.col("text")))).withColumn("problem", F.when(begun, F.col("problem")))
            cut = cut.withColumn("head", F.when(begun, known).otherwise(F.array().cast("array<string>")))
        return cut.drop("text").withColumn("fields", C.head_map(F.col("head")))

    def _field(self, key: str, default: Column | str | None = None) -> Column:
        value = C.as_scalar(F.col("fields")[key])
        return F.coalesce(value, F.lit(default) if isinstance(default, str) else default) if default is not None else value

    def _list(self, key: str) -> Column:
        return C.as_list(F.col("fields")[key])

    def works(self) -> DataFrame:
        """One row for each paper card: scalars, an array for each axis, and ``gaps`` with their relations."""
        entries = F.transform(self._list("gaps"), lambda g: F.struct(F.regexp_extract(g, GAP_ENTRY, 1).alias("gap"), F.regexp_extract(g, GAP_ENTRY, 2).alias("relation")))
        ids = C.external_ids(self._field("source", ""))
        return self.cards("papers").select(
            "slug", "origin", self._field("title", F.col("slug")).alias("title"), self._field("year").alias("year"),
            *[self._field(k, "").alias(k) for k in ("source", "local")],
            *[self._field(k, "not-recorded").alias(k) for k in ("publication_status", "read_depth", "source_coverage")],
            ids["doi"].alias("doi"), ids["arxiv"].alias("arxiv"),
            *[self._list(a).alias(a.replace("-", "_")) for a in AXES],
            F.filter(entries, lambda e: e["relation"].isin(*GAP_RELATIONS)).alias("gaps"),
        )

    def card_fields(self, keys: tuple[str, ...] = CARD_FIELDS) -> DataFrame:
        """``slug`` and some raw fields of each paper card, a list as its items joined by commas; null where the card has none.  Only front matter is parsed."""
        cut = self.files("papers").select("slug", C.card_parts(F.col("text"))["head"].alias("head")).select("slug", C.head_map(F.col("head")).alias("fields"))
        value = lambda k: F.when(C.is_list(F.col("fields")[k]), F.array_join(C.as_list(F.col("fields")[k]), ", ")).otherwise(C.as_scalar(F.col("fields")[k]))
        return cut.select("slug", *[value(k).alias(k) for k in keys])

    def gaps(self) -> DataFrame:
        return self.cards("gaps").select("slug", "origin", self._field("type", "").alias("type"), self._field("status", "").alias("status"), self._list("concepts").alias("concepts"), self._list("related").alias("related"), F.array_join("body", "\n").alias("text"))

    def transfers(self) -> DataFrame:
        return self.cards("transfers").select("slug", "origin", *[self._field(k, "").alias(k) for k in ("a", "c", "status")], *[self._list(k).alias(k) for k in ("bridges", "gaps", "papers")])

    def briefs(self) -> DataFrame:
        """``topic`` falls back to the domain, ``date`` to the first ten characters of the name."""
        return self.cards("briefs").select("slug", "origin", F.coalesce(self._field("topic"), self._field("domain"), F.lit("")).alias("topic"), self._field("date", F.substring("slug", 1, 10)).alias("date"), self._field("view", "").alias("view"))

    def claims(self) -> DataFrame:
        """``claim, work, n, quote, anchor, concepts, retracted``; of a repeated number the last stays, as of repeated retractions."""
        parsed = self.cards("papers").select("slug", C.claims(F.col("body")).alias("claims"), C.retractions(F.col("body")).alias("gone"))
        rows = parsed.select("slug", "claims", "gone", F.posexplode("claims").alias("at", "c"))
        later = F.exists(F.slice("claims", F.col("at") + 2, F.size("claims")), lambda x: x["n"] == F.col("c.n"))
        own = F.filter("gone", lambda r: r["n"] == F.col("c.n"))
        note = F.try_element_at(own, F.lit(-1))
        one = rows.where(~later).select("slug", "c", F.when(note.isNotNull(), F.struct(note["date"].alias("date"), note["note"].alias("note"))).alias("retracted"))
        return one.select(F.concat("slug", F.lit("#C"), F.col("c.n").cast("string")).alias("claim"), F.col("slug").alias("work"), "c.n", "c.quote", "c.anchor", "c.concepts", "retracted")

    def profiles(self) -> DataFrame:
        """``work, role, claims`` of study profiles; the first of a repeated role stays."""
        rows = self.cards("papers").select("slug", F.explode(C.roles(F.col("body"))).alias("r"))
        return rows.where("r.role is not null and not r.again").select(F.col("slug").alias("work"), "r.role", "r.claims")

    def _rows(self, kind: str) -> DataFrame:
        """``origin, slug, section, no, cells, line, problem`` of every row in the sections of ``TABLES``; ``no`` counts lines of the section."""
        if ("rows", kind) in self._kept:
            return self._kept["rows", kind]
        parts = self.cards(kind).select("origin", "slug", F.explode(C.sections(F.col("body"))).alias("s")).where(F.col("s.name").isin(*TABLES))
        rows = parts.select("origin", "slug", F.col("s.name").alias("section"), F.posexplode("s.lines").alias("no", "line")).where(F.startswith("line", F.lit("|")))
        rows = rows.withColumn("cells", C.row_cells(F.col("line")))
        titles = {s: [c.capitalize() if c != "id" else "ID" for c in columns] for s, columns in TABLES.items()}
        header = reduce(lambda a, b: a | b, [(F.col("section") == s) & (F.array_join("cells", "|") == "|".join(t)) for s, t in titles.items()])
        rows = rows.where(~header & ~F.forall("cells", lambda c: F.rlike(c, F.lit("^:?-+:?$"))))

        def cell(name: str) -> Column:
            places = [F.when(F.col("section") == s, F.get("cells", F.lit(columns.index(name)))) for s, columns in TABLES.items() if name in columns]
            return F.coalesce(*places)

        of = lambda *sections: F.col("section").isin(*sections)
        width = F.coalesce(*[F.when(F.col("section") == s, F.lit(len(columns))) for s, columns in TABLES.items()])
        problem = (
            F.when(F.size("cells") != width, "wrong number of cells")
            .when(F.exists("cells", lambda c: c == ""), "empty cell")
            .when(of("Argument") & ~cell("role").isin(*ARGUMENT_ROLES), "unknown argument role")
            .when(of("Argument", "Evidence relations") & ~cell("attribution").isin(*ATTRIBUTIONS), "unknown attribution")
            .when(of("Evidence relations") & ~(cell("relation").isin(*RELATIONS) & cell("comparison").isin(*COMPARISONS)), "unknown relation or comparison")
            .when(of("Evidence relations") & (cell("comparison") == "retrospective") & (cell("attribution") != "system"), "retrospective relation not by system")
            .when(of("Observations") & ~cell("outcome").isin(*OUTCOMES), "unknown outcome")
        )
        return rows.select("origin", "slug", "section", "no", "cells", "line", problem.alias("problem"))

    def table(self, section: str) -> DataFrame:
        """The valid rows of one of ``TABLES`` over all cards that may hold it: ``origin, slug, no`` and its columns."""
        kinds = [k for k, held in HELD.items() if section in held] or list(HELD)
        rows = reduce(DataFrame.union, [self._rows(k) for k in kinds]).where((F.col("section") == section) & F.col("problem").isNull())
        return rows.select("origin", F.col("slug").alias("card"), "no", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(TABLES[section])])

    def _registry(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], "value string")
        return self.spark.read.text(path, wholetext=True)

    def _concept_rows(self) -> DataFrame:
        parts = self._registry("concepts.md").select(F.posexplode(C.sections(C.lines(F.col("value")))).alias("part", "s"))
        rows = parts.select("part", "s.name", F.posexplode("s.lines").alias("no", "line")).where(F.rlike("line", F.lit(r"^\| [a-z0-9][a-z0-9-]* \|")) & (F.col("name") != ""))
        return rows.select("part", "no", F.col("name").alias("axis"), C.registry_cells(F.col("line")).alias("cells")).withColumn("slug", F.col("cells")[0])

    def concepts(self) -> DataFrame:
        """``slug, axis, parents, status, aliases``; the first row of a repeated slug stays."""
        first = self._concept_rows().groupBy("slug").agg(F.min(F.struct("part", "no", "axis", "cells")).alias("r")).select("slug", "r.axis", "r.cells")
        items = lambda i: F.filter(F.transform(F.split(F.coalesce(F.get("cells", F.lit(i)), F.lit("")), ","), C.strip), lambda x: x != "")
        return first.select("slug", "axis", F.filter(items(1), lambda x: x != "-").alias("parents"), F.coalesce(F.get("cells", F.lit(2)), F.lit("")).alias("status"), items(3).alias("aliases"))

    def domains(self) -> DataFrame:
        """``slug, name``; the last row of a repeated slug stays."""
        rows = self._registry("domains.md").select(F.posexplode(C.lines(F.col("value"))).alias("no", "line")).where(F.rlike("line", F.lit(r"^\| [a-z0-9][a-z0-9-]* \|")))
        rows = rows.select("no", C.registry_cells(F.col("line")).alias("cells"))
        return rows.groupBy(F.col("cells")[0].alias("slug")).agg(F.max_by(F.coalesce(F.get("cells", F.lit(1)), F.col("cells")[0]), "no").alias("name"))

    def problems(self) -> DataFrame:
        """``origin, problem, detail``: all that did not parse; one pass over each kind of card."""
        lists = {"papers": (*AXES, "gaps"), "gaps": ("concepts", "related"), "transfers": ("bridges", "gaps", "papers"), "briefs": ()}
        found = []
        for kind, keys in lists.items():
            kept = [_reported(F.array(F.col("problem")), lambda x: x, lambda x: F.lit("")), _head_problems(F.col("head"))]
            kept.append(_reported(F.array(*[F.when((C.as_scalar(F.col("fields")[k]) != "") & ~C.is_list(F.col("fields")[k]), F.lit(k)) for k in keys]), lambda x: F.lit("list expected"), lambda x: x) if keys else None)
            if kind == "papers":
                renamed = F.when((self._field("slug") != "") & (self._field("slug") != F.col("slug")), self._field("slug"))
                bad = F.filter(self._list("gaps"), lambda g: ~F.regexp_extract(g, GAP_ENTRY, 2).isin(*GAP_RELATIONS))
                kept += [_reported(F.array(renamed), lambda x: F.lit("slug differs from file name"), lambda x: x), _reported(bad, lambda x: F.lit("bad gap entry"), lambda x: x)]
            cards = self.cards(kind)
            if kind == "papers":
                parts = cards.withColumn("claims", C.claims(F.col("body"))).withColumn("gone", C.retractions(F.col("body"))).withColumn("roles", C.roles(F.col("body")))
                cards, kept = parts, [*kept, *_claim_problems(F.col("claims"), F.col("gone")), _role_problems(F.col("roles"))]
            found.append(cards.select("origin", F.explode(F.concat(*[k for k in kept if k is not None])).alias("p")).select("origin", "p.*"))
            found.append(self._rows(kind).where("problem is not null").select("origin", "problem", F.concat_ws(": ", "section", "line")))
        repeated = self._concept_rows().groupBy("slug").count().where("count > 1")
        found.append(repeated.select(F.lit("concepts.md"), F.lit("repeated slug"), "slug"))
        found.append(self.domains().agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("domains.md"), F.lit("no rows"), F.lit("")))
        return reduce(DataFrame.union, found)

    def listing(self) -> DataFrame:
        """``path, sha`` of every card and registry, in all folders."""
        read = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(self.folder)
        root = F.length(F.lit(self.folder.removeprefix("file:").rstrip("/")))
        path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), "^/+", "/")
        return read.select(F.substring(path, root + 2, F.length(path)).alias("path"), F.sha2("content", 256).alias("sha"))

    def fingerprint(self) -> DataFrame:
        """``fingerprint``: the root of the hash tree over the paths and contents of all cards."""
        return tree(self.listing(), ["path"]).where("level = 0").select(F.col("hash").alias("fingerprint"))


class CardTable(Vault):
    """The same tables over cards that are rows of a table (``path, text``) and no files; paths are relative to the vault.

    ``only`` (``path``) keeps some cards; registries always count.
    """

    def __init__(self, cards: DataFrame, only: DataFrame | None = None):
        super().__init__(cards.sparkSession, "")
        self.rows = cards if only is None else cards.join(only.select("path"), "path", "left_semi")
        self.every = cards

    def files(self, kind: str) -> DataFrame:
        own = self.rows.where(F.startswith("path", F.lit(f"{kind}/")) & F.endswith("path", F.lit(".md")) & (F.size(F.split("path", "/")) == 2))
        slug = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
        return own.select(F.col("path").alias("origin"), slug.alias("slug"), "text").where("slug <> 'INDEX'")

    def _registry(self, name: str) -> DataFrame:
        return self.every.where(F.col("path") == name).select(F.col("text").alias("value"))

    def listing(self) -> DataFrame:
        return self.rows.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))

    def within(self, paths: DataFrame) -> CardTable:
        """Of these cards, those of ``path``."""
        return CardTable(self.every, paths)
