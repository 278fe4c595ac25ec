"""Normalisation of titles, identifiers and questions, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a term is, the words of a question that say nothing of its subject, and the prefix of DOI resolvers.
TERM = r"[a-z0-9][a-z0-9-]+|[一-鿿]+"

STOPWORDS = (
    "the and for are was were what how why when where which does with from into over under between about can could should would there their this "
    "that these those has have had been being will its our your"
).split()
RESOLVER = r"(?i)^https?://(dx\.)?doi\.org/"


def normal_title(c: Column | str) -> Column:
    """Lower case, every run of characters that are no letters or digits as one space, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")))


def clean_doi(c: Column | str) -> Column:
    """A DOI without a resolver's prefix, lower-cased."""
    return F.lower(F.regexp_replace(c, RESOLVER, ""))


def candidate_key(doi: Column, openalex: Column, arxiv: Column, title: Column) -> Column:
    """The first identifier known, in order of trust; else a hash of the normalised title; null if that is empty."""
    tidy = normal_title(title)
    tagged = [F.when(F.length(c) > 0, F.concat(F.lit(f"{k}:"), F.lower(c))) for k, c in (("doi", doi), ("openalex", openalex), ("arxiv", arxiv))]
    return F.coalesce(*tagged, F.when(F.length(tidy) > 0, F.concat(F.lit("title:"), F.substring(F.sha2(tidy, 256), 1, 16))))


def terms(c: Column | str, stopwords: list[str] | None = None) -> Column:
    """Distinct terms of a question in order of appearance, without stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, stopwords))) if stopwords else found


def has_word(text: Column, term: str) -> Column:
    """A plain ASCII term as a whole word, any other term as a substring; case does not matter."""
    if all(x in "abcdefghijklmnopqrstuvwxyz0123456789" for x in term) and term:
        return F.lower(text).rlike(f"(?<![a-z0-9]){term}(?![a-z0-9])")
    return F.contains(F.lower(text), F.lit(term))


def question_terms(question: str, stopwords: list[str] | None = None) -> list[str]:
    """Distinct terms of one question in order, without the usual stopwords and those given."""
    import re

    banned = {*STOPWORDS, *(w.lower() for w in stopwords or [])}
    return [t for t in dict.fromkeys(re.findall(TERM, question.lower())) if t not in banned]


def arxiv_doi(number: Column) -> Column:
    """The DOI under which an arXiv number is registered."""
    return F.concat(F.lit("10.48550/arxiv."), F.lower(number))


def last_segment(path: Column) -> Column:
    """What follows the last slash; all of a text without one."""
    return F.substring_index(path, "/", -1)


def without_version(number: Column) -> Column:
    """An arXiv number without its version."""
    return F.regexp_replace(number, r"v\d+$", "")


def year_of(date: Column) -> Column:
    """The year of an ISO date; null where the first four characters are no digits."""
    head = F.substring(date, 1, 4)
    return F.when(F.rlike(head, F.lit("^[0-9]{4}$")), head.cast("int"))


def one_line(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def table_cell(c: Column) -> Column:
    """A text as the cell of a pipe table: one line, pipes escaped; null is empty."""
    return F.replace(one_line(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|"))


def wiki_link(kind: Column, slug: Column, label: Column) -> Column:
    """A link to a card, or to the page of a node that has none of its own."""
    text = F.replace(F.replace(one_line(label), F.lit("|"), F.lit("/")), F.lit("]"), F.lit(")"))
    page = F.when(kind.isin("work", "gap", "transfer", "brief"), slug).otherwise(F.concat(kind, F.lit("-"), slug))
    return F.concat(F.lit("[["), page, F.lit("|"), text, F.lit("]]"))


def percent(share: Column) -> Column:
    """A percentile of 0 to 100, also from a share of 0 to 1."""
    return F.when(share <= 1, share * 100).otherwise(share)


def folded(c: Column) -> Column:
    """Compatibility-decomposed lower-case text with nothing but a-z and 0-9; Spark has no such normalisation of its own."""

    def fold(texts: pd.Series) -> pd.Series:
        import re
        import unicodedata

        other = re.compile("[^a-z0-9]+")
        return texts.map(lambda x: None if x is None else other.sub("", unicodedata.normalize("NFKD", x).lower()))

    return F.pandas_udf(fold, T.StringType())(c)


def case_folded(c: Column) -> Column:
    """Unicode case folding, which lower case is not."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else x.casefold())

    return F.pandas_udf(fold, T.StringType())(c)
