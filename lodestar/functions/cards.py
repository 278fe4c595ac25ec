"""Parts of a Markdown card as column expressions: a card stays one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line forms of the card format.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
BLANK = r"(?U)^\s+|\s+$"
KEY_LINE = r"(?s)^([A-Za-z][A-Za-z0-9_-]*):\s*(.*)$"
CLAIM = r"(?s)^- C(\d+)(?: \[([^\]]*)\])?: (.*)$"
RETRACTION = r"(?s)^- Retraction of C(\d+) \((\d{4}-\d{2}-\d{2})\): (.*)$"
ROLE = r"(?s)^- ([a-z][a-z-]*): (C\d+(?:, ?C\d+)*)$"
DASH = " — "


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, BLANK, "")


def _plain(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end starts no line, a null or empty text has none."""
    cut = F.split(text, LINE_END, -1)
    cut = F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    return F.coalesce(cut, F.array().cast("array<string>"))


def card_parts(text: Column) -> Column:
    """``struct<head, body, problem>``: the lines between the first two ``---`` and those after; without them all is body."""
    all_lines = lines(text)
    fences = F.filter(F.transform(all_lines, lambda x, i: F.when(strip(x) == "---", i)), lambda i: i.isNotNull())
    opened = F.coalesce(F.get(fences, F.lit(0)) == 0, F.lit(False))
    end = F.get(fences, F.lit(1))
    none = F.array().cast("array<string>")
    whole = lambda problem: F.struct(none.alias("head"), all_lines.alias("body"), F.lit(problem).alias("problem"))
    found = F.struct(F.slice(all_lines, F.lit(2), end - 1).alias("head"), F.slice(all_lines, end + 2, F.greatest(F.size(all_lines) - end - 1, F.lit(0))).alias("body"), F.lit(None).cast("string").alias("problem"))
    return F.when(~opened, whole("no front matter")).when(end.isNull(), whole("front matter not closed")).otherwise(found)


def head_entries(head: Column) -> Column:
    """``array<struct<no, line, key, raw, again>>`` of lines that are neither blank nor comments; ``key`` is null where a line has none, ``again`` where it had one before."""
    numbered = F.transform(head, lambda x, i: F.struct((i + 2).alias("no"), x.alias("line"), F.when(F.rlike(x, F.lit(KEY_LINE)), F.regexp_extract(x, KEY_LINE, 1)).alias("key"), strip(F.regexp_extract(x, KEY_LINE, 2)).alias("raw")))
    kept = F.filter(numbered, lambda e: (strip(e["line"]) != "") & ~F.startswith(strip(e["line"]), F.lit("#")))
    keys = F.transform(kept, lambda e: e["key"])
    return F.transform(kept, lambda e, i: e.withField("again", F.coalesce(F.array_position(keys, e["key"]) <= i, F.lit(False))))


def head_map(head: Column) -> Column:
    """Raw values by key; of a repeated key the first stays."""
    good = F.filter(head_entries(head), lambda e: e["key"].isNotNull() & ~e["again"])
    return F.map_from_entries(F.transform(good, lambda e: F.struct(e["key"], e["raw"])))


def is_list(raw: Column) -> Column:
    return F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]"))


def as_scalar(raw: Column) -> Column:
    """A raw value without quotation marks; null stays null."""
    return _plain(raw, '"')


def as_list(raw: Column) -> Column:
    """The items of ``[a, b]`` without quotation marks, none empty; anything else is an empty list."""
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    items = F.transform(F.split(inner, ","), lambda x: strip(_plain(_plain(strip(x), '"'), "'")))
    return F.when(is_list(raw), F.filter(items, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def external_ids(source: Column) -> Column:
    """``struct<doi, arxiv>`` named in a source line; null where there is none."""
    doi = F.lower(F.rtrim(F.regexp_extract(source, r"(?U)\b(10\.\d{4,9}/[^\s\"']+)", 1), F.lit(".")))
    arxiv = F.regexp_extract(source, r"(?i)arxiv(?:\.org)?[/:.]+(?:abs/|pdf/)?(\d{4}\.\d{4,5})", 1)
    return F.struct(F.nullif(doi, F.lit("")).alias("doi"), F.nullif(arxiv, F.lit("")).alias("arxiv"))


def bullets(body: Column) -> Column:
    """Each line with its continuation lines: indented by two spaces, neither blank nor bullets."""
    return F.transform(F.split(F.array_join(body, "\n"), r"\n(?!  (?![^\S\n]*- )[^\S\n]*\S)", -1), lambda x: F.split(x, "\n"))


def _joined(pattern: str, group: int, b: Column) -> Column:
    """The rest of a bullet's first line and its stripped continuations, with single spaces between."""
    more = F.transform(F.slice(b, F.lit(2), F.size(b)), strip)
    return F.array_join(F.concat(F.array(F.regexp_extract(b[0], pattern, group)), more), " ")


def retractions(body: Column) -> Column:
    """``array<struct<n, date, note>>`` in order."""
    found = F.filter(bullets(body), lambda b: F.rlike(b[0], F.lit(RETRACTION)))
    return F.transform(found, lambda b: F.struct(
        F.regexp_extract(b[0], RETRACTION, 1).try_cast("long").alias("n"), F.regexp_extract(b[0], RETRACTION, 2).alias("date"), strip(_joined(RETRACTION, 3, b)).alias("note")
    ))


def claims(body: Column) -> Column:
    """``array<struct<n, concepts, quote, anchor>>`` in order; the anchor follows the last spaced em dash, null without one."""
    found = F.filter(bullets(body), lambda b: F.rlike(b[0], F.lit(CLAIM)))
    slugs = lambda b: F.filter(F.transform(F.split(F.regexp_extract(b[0], CLAIM, 2), ","), strip), lambda s: s != "")

    def claim(b: Column) -> Column:
        rest = _joined(CLAIM, 3, b)
        parts = F.split(rest, DASH, -1)
        anchored = F.size(parts) > 1
        quote = F.when(anchored, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), DASH)).otherwise(rest)
        return F.struct(F.regexp_extract(b[0], CLAIM, 1).try_cast("long").alias("n"), slugs(b).alias("concepts"), strip(quote).alias("quote"), F.when(anchored, strip(F.element_at(parts, -1))).alias("anchor"))

    return F.transform(found, claim)


def sections(body: Column) -> Column:
    """``array<struct<name, lines>>``: the parts of a body from each ``## `` line on."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.array_join(body, "\n")), r"\n(?=## )", -1), lambda s: F.startswith(s, F.lit("## ")))
    return F.transform(F.transform(parts, lambda s: F.split(s, "\n", -1)), lambda s: F.struct(strip(F.substring(s[0], F.lit(4), F.length(s[0]))).alias("name"), F.slice(s, F.lit(2), F.size(s)).alias("lines")))


def roles(body: Column) -> Column:
    """``array<struct<line, role, claims, again>>`` of the study profile; ``role`` is null where a line does not fit."""
    own = F.flatten(F.transform(F.filter(sections(body), lambda s: s["name"] == "Study profile"), lambda s: F.transform(s["lines"], strip)))
    own = F.filter(own, lambda x: (x != "") & ~F.startswith(x, F.lit("<!--")))
    rows = F.transform(own, lambda x: F.struct(
        x.alias("line"), F.when(F.rlike(x, F.lit(ROLE)), F.regexp_extract(x, ROLE, 1)).alias("role"), F.split(F.regexp_extract(x, ROLE, 2), ", ?").alias("claims")
    ))
    names = F.transform(rows, lambda r: r["role"])
    return F.transform(rows, lambda r, i: r.withField("again", F.coalesce(F.array_position(names, r["role"]) <= i, F.lit(False))))


def row_cells(line: Column) -> Column:
    """The cells of a pipe row whose ends are pipes; an escaped pipe is part of its cell."""
    cut = F.split(line, r"(?<!\\)\|", -1)
    return F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 2, F.lit(0))), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def registry_cells(line: Column) -> Column:
    """The cells of a registry row, pipes at the ends or not."""
    return F.transform(F.split(_plain(strip(line), "|"), r"\|", -1), strip)
