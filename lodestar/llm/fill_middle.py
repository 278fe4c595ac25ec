"""Fill-in-middle transformation (operator 12).

Each text becomes a NumPy array of its code points.  A unit is a run of ASCII letters or one other code
point; a unit begins wherever a code point and the one before it are not both letters, so ``flatnonzero``
over neighbouring classes gives all boundaries at once.  Two cuts, ranks drawn from a hash of the id,
index that array, and the text is sliced there and encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are transformed, percent of those with the suffix first, and what ids are hashed after.
RATE, SUFFIX_FIRST, SEED = 90, 20, "1:"


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Where the units of an array of code points begin."""
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def cut(text: str, first: int, second: int) -> tuple[int, str, str, str]:
    """Units of ``text``, and prefix, middle and suffix: cut after the smaller and the larger of two hashes modulo units + 1."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = np.append(unit_starts(points), len(points))
    n = len(starts) - 1
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = starts[low], starts[high]
    return n, *(part.tobytes().decode("utf-32-le") for part in (points[:a], points[a:b], points[b:]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """All columns of ``docs`` with ``fim_units``, ``fim_form`` (``plain``, ``psm``, ``spm``), ``fim_prefix``, ``fim_middle`` and ``fim_output``.

    Cuts and form come from the SHA-256 of the seed and the id, so a retried task or a repeated row has the
    same; a null id hashes as an empty one.  Empty texts, a null text being one, and texts that hold a
    marker stay plain, as do ``100 - rate`` percent of the others: their output is the text, prefix and
    middle are null.  Every row stays; an empty table gives an empty result.  Columns of ``docs`` of the
    five names are replaced, no others.
    """
    made = {"fim_units": "long", "fim_form": "string", "fim_prefix": "string", "fim_middle": "string", "fim_output": "string"}
    columns = [c for c in docs.columns if c not in made]
    own, text_name = unused("own", *made), unused("fim_text", *made)
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_name)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(own), text, *groups)

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        n, prefix, middle, suffix = cut(text, h1, h2)
        if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
            return n, "plain", None, None, text
        if h4 % 100 < suffix_first:
            return n, "spm", prefix, middle, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", prefix, middle, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            found = [one(*(c.as_py() for c in row)) for row in zip(*batch.columns[1:], strict=True)]
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [own, *made])

    schema = f"{own} {rows.schema[own].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in made.items())
    return rows.mapInArrow(work, schema).select(*[F.col(f"{own}.`{c}`").alias(c) for c in columns], *made)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone.

    A marker is found where it was put: the text holds none, and none can begin within one.
    """

    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.locate(mark, text) + len(mark))

    def before(text: Column, mark: str) -> Column:
        return F.left(text, F.locate(mark, text) - 1)

    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lengths and hashes of ``fill_in_middle``, and of the texts restored from it."""
    return made.select(
        id_col, F.col("fim_units").alias("n"), F.col("fim_form").alias("form"),
        F.length("fim_prefix").cast("long").alias("prefix_chars"), F.length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("fim_output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_output"), F.col("fim_form")).cast("binary"), 256).alias("restored_sha256"),
    )
