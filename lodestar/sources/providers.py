"""Records of bibliographic services: from cached answers to one table of fields, cache first and never over the network.

Each reader takes a column of payload texts and gives ``struct<provider, openalex, doi, arxiv, s2, title, year, venue,
citations, percentile, categories, preprint, reviewed>``; what a service does not say, or a payload that does not
parse, is null.  Field names of the services are fixed by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import arxiv_doi, clean_doi, last_segment, one_line, percent, without_version, year_of

# The parts of each service's answers that are read, and the addresses of single works.
NAMED = "array<struct<display_name:string>>"
OPENALEX = (
    "id string, doi string, display_name string, publication_year int, cited_by_count long, primary_location struct<source:struct<display_name:string,type:string>>, "
    f"citation_normalized_percentile struct<value:double>, topics {NAMED}, referenced_works array<string>"
)
CROSSREF = (
    "message struct<DOI:string,title:array<string>,`container-title`:array<string>,type:string,subject:array<string>,`is-referenced-by-count`:long,"
    "issued:struct<`date-parts`:array<array<int>>>,reference:array<struct<DOI:string,unstructured:string>>>"
)
PAPER = "paperId:string,title:string,externalIds:struct<DOI:string,ArXiv:string>"
SCHOLAR = "paperId string, title string, year int, venue string, citationCount long, externalIds struct<DOI:string,ArXiv:string>"
SCHOLAR_FIELDS = "title,year,venue,citationCount,externalIds"
SCHOLAR_LIST = f"data array<struct<citedPaper:struct<{PAPER}>,citingPaper:struct<{PAPER}>>>"
ADDRESSES = {
    "openalex": "https://api.openalex.org/works/", "crossref": "https://api.crossref.org/works/",
    "semanticscholar": "https://api.semanticscholar.org/graph/v1/paper/", "arxiv": "https://export.arxiv.org/api/query?id_list=",
}
FIELDS = {"openalex": "string", "doi": "string", "arxiv": "string", "s2": "string", "title": "string", "year": "int", "venue": "string", "citations": "long", "percentile": "double", "categories": "array<string>", "preprint": "boolean", "reviewed": "boolean"}


def _record(provider: str, **told: Column) -> Column:
    return F.struct(F.lit(provider).alias("provider"), *[(told.get(c, F.lit(None))).cast(t).alias(c) for c, t in FIELDS.items()])


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _openalex_of(w: Column) -> Column:
    source = w["primary_location"]["source"]
    names = F.filter(F.transform(w["topics"], lambda t: t["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return _record(
        "openalex", openalex=_filled(last_segment(w["id"])), doi=clean_doi(w["doi"]), title=w["display_name"], year=w["publication_year"], venue=source["display_name"], citations=w["cited_by_count"],
        percentile=percent(w["citation_normalized_percentile"]["value"]), categories=F.coalesce(names, F.array().cast("array<string>")), preprint=F.when(source["type"] == "repository", True),
    )


def openalex(payload: Column) -> Column:
    return _openalex_of(F.from_json(payload, OPENALEX))


def _crossref_of(m: Column) -> Column:
    first = lambda c: F.get(c, F.lit(0))
    return _record(
        "crossref", doi=clean_doi(m["DOI"]), title=first(m["title"]), year=first(first(m["issued"]["date-parts"])), venue=first(m["container-title"]), citations=m["is-referenced-by-count"],
        categories=F.coalesce(m["subject"], F.array().cast("array<string>")), preprint=F.when(m["type"] == "posted-content", True), reviewed=F.when(m["type"] == "journal-article", True),
    )


def crossref(payload: Column) -> Column:
    return _crossref_of(F.from_json(payload, CROSSREF)["message"])


def _scholar_of(p: Column) -> Column:
    return _record("semanticscholar", s2=p["paperId"], doi=clean_doi(p["externalIds"]["DOI"]), arxiv=p["externalIds"]["ArXiv"], title=p["title"], year=p["year"], venue=_filled(p["venue"]), citations=p["citationCount"], categories=F.array().cast("array<string>"))


def semantic_scholar(payload: Column) -> Column:
    return _scholar_of(F.from_json(payload, SCHOLAR))


def arxiv(feed: Column) -> Column:
    """The first entry of an Atom feed; null fields where there is none."""
    of = lambda tag: F.xpath_string(feed, F.lit(f"/feed/entry[1]/{tag}"))
    number = without_version(F.substring_index(of("id"), "/abs/", -1))
    there = F.xpath_boolean(feed, F.lit("/feed/entry"))
    return F.when(there, _record("arxiv", arxiv=_filled(number), title=_filled(one_line(of("title"))), year=year_of(of("published")), venue=F.lit("arXiv"), categories=F.array().cast("array<string>"), preprint=F.lit(True)))


READERS: dict[str, Callable[[Column], Column]] = {"openalex": openalex, "crossref": crossref, "semanticscholar": semantic_scholar, "arxiv": arxiv}


def search(provider: str, payload: Column) -> Column:
    """``array`` of the records (as ``READERS`` give them) of an answer to a search, in its order; null where it does not parse."""
    if provider == "openalex":
        return F.transform(F.from_json(payload, f"results array<struct<{OPENALEX}>>")["results"], _openalex_of)
    if provider == "crossref":
        return F.transform(F.from_json(payload, f"message struct<items:array<{CROSSREF.removeprefix('message ')}>>")["message"]["items"], _crossref_of)
    if provider == "semanticscholar":
        return F.transform(F.from_json(payload, f"data array<struct<{SCHOLAR}>>")["data"], _scholar_of)
    texts = lambda tag: F.xpath(payload, F.lit(f"/feed/entry/{tag}/text()"))
    entries = F.arrays_zip(texts("id").alias("id"), texts("title").alias("title"), texts("published").alias("published"))

    def record(e: Column) -> Column:
        number = without_version(F.substring_index(e["id"], "/abs/", -1))
        return _record("arxiv", arxiv=_filled(number), title=_filled(one_line(e["title"])), year=year_of(e["published"]), venue=F.lit("arXiv"), categories=F.array().cast("array<string>"), preprint=F.lit(True))

    return F.transform(entries, record)


def search_address(provider: str, words: Column, limit: int = 10) -> Column:
    """Where a provider answers a search, for 1 to 50 records."""
    n = max(1, min(int(limit), 50))
    asked = {"openalex": ("works?search=", f"&per-page={n}"), "crossref": ("works?query=", f"&rows={n}"), "semanticscholar": ("paper/search?query=", f"&limit={n}&fields={SCHOLAR_FIELDS}"), "arxiv": ("query?search_query=all:", f"&max_results={n}")}
    before, after = asked[provider]
    base = ADDRESSES[provider].removesuffix("works/").removesuffix("paper/").removesuffix("query?id_list=")
    return F.concat(F.lit(base + before), F.replace(words, F.lit(" "), F.lit("+")), F.lit(after))


def cited_by(provider: str, payload: Column, listing: Column | None = None) -> Column:
    """``struct<count, items>``: how many works cite one, and those that the answers name, as ``references`` gives them.

    OpenAlex counts in the work's own ``payload`` and lists in a second answer; Crossref only counts; Semantic Scholar only lists; arXiv says nothing.
    """
    none = F.lit(None).cast("string")
    lite = lambda r: F.struct(r["openalex"].alias("openalex"), r["doi"].alias("doi"), r["s2"].alias("s2"), r["title"].alias("title"))
    no_items = F.array().cast("array<struct<openalex:string,doi:string,s2:string,title:string>>")
    if provider == "openalex":
        found = F.transform(search("openalex", listing), lite) if listing is not None else no_items
        return F.struct(F.from_json(payload, OPENALEX)["cited_by_count"].alias("count"), F.coalesce(found, no_items).alias("items"))
    if provider == "crossref":
        return F.struct(F.from_json(payload, CROSSREF)["message"]["is-referenced-by-count"].alias("count"), no_items.alias("items"))
    if provider == "semanticscholar":
        citing = F.transform(F.from_json(payload, SCHOLAR_LIST)["data"], lambda r: F.struct(none.alias("openalex"), clean_doi(r["citingPaper"]["externalIds"]["DOI"]).alias("doi"), r["citingPaper"]["paperId"].alias("s2"), r["citingPaper"]["title"].alias("title")))
        return F.struct(F.lit(None).cast("long").alias("count"), F.coalesce(citing, no_items).alias("items"))
    raise ValueError(f"{provider} has no citations")


def references(provider: str, payload: Column) -> Column:
    """``array<struct<openalex, doi, s2, title>>`` that a payload refers to; arXiv says nothing of references."""
    none = F.lit(None).cast("string")
    lite = lambda **k: F.struct(*[k.get(c, none).alias(c) for c in ("openalex", "doi", "s2", "title")])
    if provider == "openalex":
        return F.transform(F.from_json(payload, OPENALEX)["referenced_works"], lambda w: lite(openalex=last_segment(w)))
    if provider == "crossref":
        return F.transform(F.from_json(payload, CROSSREF)["message"]["reference"], lambda r: lite(doi=clean_doi(r["DOI"]), title=r["unstructured"]))
    if provider == "semanticscholar":
        return F.transform(F.from_json(payload, SCHOLAR_LIST)["data"], lambda r: lite(doi=clean_doi(r["citedPaper"]["externalIds"]["DOI"]), s2=r["citedPaper"]["paperId"], title=r["citedPaper"]["title"]))
    raise ValueError(f"{provider} has no references")


def address(provider: str, doi: Column, number: Column, own: Column) -> Column:
    """Where a provider answers for a work: by DOI, else by the provider's own id or the arXiv number; null if it knows none."""
    base, bare = F.lit(ADDRESSES[provider]), clean_doi(doi)
    if provider == "openalex":
        return F.coalesce(F.concat(base, F.lit("doi:"), bare), F.concat(base, last_segment(own)), F.concat(base, F.lit("doi:"), arxiv_doi(number)))
    if provider == "crossref":
        return F.concat(base, bare)
    if provider == "semanticscholar":
        return F.coalesce(F.concat(base, F.lit("DOI:"), bare), F.concat(base, F.lit("ARXIV:"), number), F.concat(base, own))
    return F.concat(base, number)


def answered(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """``wanted`` (``provider, url`` and more) with ``payload, fetched_at`` of the cache; a miss has nulls, as nothing is fetched."""
    known = cache.select("provider", F.col("url_sha"), "payload", "fetched_at")
    return wanted.withColumn("url_sha", F.sha2("url", 256)).join(known, ["provider", "url_sha"], "left")


def with_answers(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """``provider, url_sha, url, fetched_at, payload``: the cache with ``fresh`` answers in place of older ones; those without a payload change nothing."""
    new = fresh.where("payload is not null").select("provider", F.sha2("url", 256).alias("url_sha"), "url", "fetched_at", "payload")
    new = new.groupBy("provider", "url_sha").agg(F.max_by(F.struct("url", "fetched_at", "payload"), "fetched_at").alias("x")).select("provider", "url_sha", "x.*")
    return new.unionByName(cache.select("provider", "url_sha", "url", "fetched_at", "payload").join(new, ["provider", "url_sha"], "left_anti"))


def quartile_table(text: DataFrame) -> DataFrame:
    """``venue, category, quartile`` of one JSON text (``value``) of venues, each a map of categories; venues in lower case."""
    venues = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("venue", "m"))
    return venues.select(F.lower("venue").alias("venue"), F.explode("m").alias("category", "quartile"))
