"""Rules for records of acquisition, claims and saved cards: each rule is a column, its violations short codes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import case_folded, folded
from lodestar.sources.stored import stored

# What the three axes of a receipt may say, and how much of a source a card may claim to have read.
ACQUISITION = ("acquired", "not_found", "auth_required", "manual_action", "failed")
IDENTITY = ("verified", "mismatch", "unverified")
TEXT = ("ready", "needs_ocr", "extraction_failed", "not_attempted")
COVERAGE = ("full-text", "excerpt", "abstract", "metadata", "not-recorded")
DEPTH = ("full", "skim", "abstract", "metadata")
#: Characters at the start of a text in which an identifier counts, and those of an attempt that are kept.
HEAD, OUTCOME = 4000, 200
#: Quotes that each source is searched for, and folded characters by which more quotes and sources meet.
FEW, GRAM = 200, 12
#: Marks by which sources leave out grams that start no quote: a prime number of bits, as many as a few bitmaps of Spark hold.
MARKS, BITMAP = 1_048_573, 32_768


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds, in order; a condition that is null does not hold."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def not_in(c: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def outside(path: str) -> Column:
    """Whether a path leaves the folder that it is relative to."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def claim_eligible() -> Column:
    """Acquired, verified, ready and not in quarantine."""
    return (F.col("acquisition_status") == "acquired") & (F.col("identity_status") == "verified") & (F.col("text_status") == "ready") & ~F.coalesce("quarantined", F.lit(False))


def receipt_violations() -> Column:
    return violations({
        "acquisition_status": not_in("acquisition_status", ACQUISITION), "identity_status": not_in("identity_status", IDENTITY), "text_status": not_in("text_status", TEXT),
        "staged_path": outside("staged_path"), "no_sha256": (F.col("acquisition_status") == "acquired") & F.col("sha256").isNull(),
        "not_quarantined": (F.col("identity_status") == "mismatch") & ~F.coalesce("quarantined", F.lit(False)),
    })


def resolved_identity(content: Column, expected: Column, doi: Column, text: Column, confirmed: Column) -> Column:
    """``verified``, ``mismatch`` or ``unverified``: by the expected hash if there is one, then the DOI in the head of the text, then the user's word."""
    by_hash = expected.isNotNull() & content.isNotNull()
    in_head = F.contains(F.lower(F.substring(text, 1, HEAD)), F.lower(doi))
    told = F.coalesce(in_head, F.lit(False)) | F.coalesce(confirmed, F.lit(False))
    return F.when(by_hash, F.when(F.sha2(content, 256) == F.lower(expected), "verified").otherwise("mismatch")).when(told, "verified").otherwise("unverified")


def first_acquired(receipts: DataFrame) -> DataFrame:
    """``request, channel, acquisition_status, attempts`` of each request's chain of ``receipts`` (``request, rank, channel, acquisition_status, outcome``).

    The first that acquired ends the chain; else the last stands.  Attempts are those up to there, in order, each cut to 200 characters.
    """
    own = Window.partitionBy("request")
    ends = receipts.withColumn("end", F.coalesce(F.min(F.when(F.col("acquisition_status") == "acquired", F.col("rank"))).over(own), F.max("rank").over(own)))
    line = F.struct("rank", F.concat("channel", F.lit(": "), F.substring("outcome", 1, OUTCOME)).alias("said"))
    made = ends.where(F.col("rank") <= F.col("end")).groupBy("request").agg(F.max(F.struct("rank", "channel", "acquisition_status")).alias("last"), F.sort_array(F.collect_list(line)).alias("lines"))  # one request's channels
    return made.select("request", "last.channel", "last.acquisition_status", F.array_join(F.transform("lines", lambda x: x["said"]), "; ").alias("attempts"))


def bound_claims(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """``claim, status, missing`` of claims (``claim, concepts``): bound, unbound without a concept, unknown where one is not in ``registry`` (``slug``)."""
    named = claims.select("claim", F.explode("concepts").alias("slug"))
    missing = named.join(registry.select("slug"), "slug", "left_anti").groupBy("claim").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("missing"))  # of one claim
    status = F.when(F.coalesce(F.size("concepts"), F.lit(0)) <= 0, "unbound").when(F.col("missing").isNotNull(), "unknown").otherwise("bound")
    return claims.join(missing, "claim", "left").select("claim", status.alias("status"), "missing")


def card_violations() -> Column:
    """Rules of a card's ``slug, title, source, source_coverage, read_depth, n_claims``."""
    limited, metadata = F.col("source_coverage").isin("abstract", "metadata"), (F.col("source_coverage") == "metadata") | (F.col("read_depth") == "metadata")
    return violations({
        "slug": ~F.coalesce(F.rlike("slug", F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")), F.lit(False)),
        "identity": F.coalesce(F.col("title") == "", F.lit(True)) | F.coalesce(F.col("source") == "", F.lit(True)),
        "source_coverage": not_in("source_coverage", COVERAGE), "read_depth": not_in("read_depth", DEPTH),
        "claims_without_text": metadata & (F.col("n_claims") > 0), "depth_beyond_coverage": limited & F.col("read_depth").isin("full", "skim"),
    })


def same_work(drafts: DataFrame, works: DataFrame) -> DataFrame:
    """``slug, other``: works that a draft repeats, by a shared identifier or an equal title but for case; both tables have ``slug, title, ids``.

    Two equi-joins, one for identifiers and one for titles.
    """
    by_id = drafts.select("slug", F.explode("ids").alias("id")).join(works.select(F.col("slug").alias("other"), F.explode("ids").alias("id")), "id").select("slug", "other")
    title = F.trim(case_folded(F.col("title"))).alias("folded")
    by_title = drafts.select("slug", title).join(works.select(F.col("slug").alias("other"), title), "folded").select("slug", "other")
    return by_id.union(by_title).where("slug <> other").distinct()


def claim_conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """``claim, problem``: saved claims (``claim, quote``) that a new card lacks, or quotes otherwise; both never happen in place."""
    both = old.select("claim", F.col("quote").alias("was")).join(new.select("claim", "quote", F.lit(True).alias("there")), "claim", "left")
    return both.select("claim", F.when(F.col("there").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("quote")), "changed").alias("problem")).where("problem is not null")


def retracted_citations(rows: DataFrame, retracted: DataFrame) -> DataFrame:
    """Table rows (``row, claim``) that cite a retracted claim."""
    return rows.join(retracted.select("claim"), "claim", "left_semi")


def gram_codes(c: Column, lengths: list[int] | None = None, marks: bytes = b"") -> Column:
    """The different grams of a folded text that have one of ``lengths`` (up to ``GRAM``) and a mark, as numbers; without ``lengths`` the text itself.

    A gram read with the digits 1 to 36 is a number of its own among grams of every length, and fits a long.
    """

    def codes(texts: pd.Series) -> pd.Series:
        import numpy as np

        marked = np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little")

        def of(text: str | None) -> np.ndarray | None:
            if text is None:
                return None
            digits = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
            digits = np.where(digits < 58, digits - 47, digits - 86)
            code, found = np.zeros(len(digits), np.int64), [np.zeros(0, np.int64)]
            for n in range(1, min(max(lengths or [GRAM]), len(digits)) + 1):
                code = code[: len(digits) - n + 1] * 36 + digits[n - 1 :]
                if lengths is None and n == len(digits):
                    found.append(code)
                elif lengths and n in lengths:
                    found.append(code[marked[code % MARKS] > 0])
            return np.unique(np.concatenate(found))

        return texts.map(of)

    return F.pandas_udf(codes, T.ArrayType(T.LongType()))(c)


def _marks(codes: DataFrame) -> bytes:
    """The bits of ``code`` modulo ``MARKS``, put together from bitmaps of ``BITMAP`` bits each."""
    place = F.pmod("code", F.lit(MARKS)) + 1  # Spark's bitmaps count from one
    parts = codes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    of = {r.part: bytes(r.bits) for r in parts}
    return b"".join(of.get(n, bytes(BITMAP // 8)) for n in range(1, MARKS // BITMAP + 2))


def quotes_in_sources(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """``quote_id, source_id``: quotes (``quote_id, quote``) that occur in sources (``source_id, text``), folded to a-z and 0-9.

    A source made by character recognition is refused; a null quote is in none, and one that folds to nothing in every
    source that counts.  Up to ``FEW`` quotes are one broadcast row that each source is searched for.  More meet by an
    equi-join: quotes by their first ``GRAM`` folded characters, or all of a shorter one, sources by their grams of these
    lengths, of which a bitmap leaves out most that start no quote.
    """
    own = quotes.where("quote is not null").select("quote_id", folded(F.col("quote")).alias("q"))
    refused = F.rlike(F.substring("text", 1, 400), F.lit("(?im)^TOOL:.*OCR"))
    texts = sources.where(~F.coalesce(refused, F.lit(False)) & F.col("text").isNotNull()).select("source_id", folded(F.col("text")).alias("t"))
    if own.count() <= FEW:
        row = F.broadcast(own.groupBy().agg(F.collect_set(F.struct("quote_id", "q")).alias("few")))
        held = texts.join(row).select("source_id", F.explode_outer(F.filter("few", lambda x: F.contains(F.col("t"), x["q"]))).alias("x")).where("x is not null")
        return held.select("x.quote_id", "source_id").distinct()

    keyed = stored(own.select("quote_id", "q", F.explode_outer(gram_codes(F.substring("q", 1, GRAM))).alias("code")))  # no code: an empty quote
    found = texts.select("source_id", F.lit("").alias("q")).join(keyed.where("code is null").select("quote_id", "q"), "q").select("quote_id", "source_id").distinct()
    keyed = keyed.where("code is not null")
    lengths = sorted(r[0] for r in keyed.select(F.least(F.length("q"), F.lit(GRAM))).distinct().collect())  # GRAM at most
    if not lengths:
        return found
    marked = texts.select("source_id", "t", gram_codes(F.col("t"), lengths, _marks(keyed)).alias("codes"))
    # repeated ids are told apart by numbers, which need a written copy; texts without a code are not written
    marked = stored(marked.select(F.monotonically_increasing_id().alias("row"), "source_id", "codes", F.when(F.size("codes") > 0, F.col("t")).alias("t")))
    met = marked.select("row", "source_id", F.explode("codes").alias("code")).join(keyed, "code")
    whole = met.where(F.length("q") <= GRAM)
    begun = met.where(F.length("q") > GRAM).select("row", "source_id", "quote_id", "q")
    held = begun.join(marked.select("row", "t"), "row").where(F.contains("t", F.col("q")))
    return found.union(whole.select("quote_id", "source_id")).union(held.select("quote_id", "source_id")).distinct()


def replaced_passage(text: Column, passage: Column, revised: Column) -> Column:
    """The text with ``passage`` replaced if it occurs exactly once; null otherwise."""
    once = (F.length(text) - F.length(F.replace(text, passage, F.lit("")))) == F.length(passage)
    return F.when(once & (F.length(passage) > 0), F.replace(text, passage, revised))


def next_revision(revisions: DataFrame) -> DataFrame:
    """``project, name``: one more than the largest number of each project's ``revisions`` (``project, n``), as r001, r002, ..."""
    return revisions.groupBy("project").agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("n")).select("project", F.concat(F.lit("r"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("name"))
