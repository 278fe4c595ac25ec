"""Clashing names, repeated rows, empty tables and a long text through the operators and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestar.llm")
from lodestar.llm import jaccard, language, line_dedup, mixing, packing, quality, scratch, secrets  # noqa: E402

HOSTILE = ["row", "own", "gone", "u", "n", "cdf", "id_text", "salt", "rank", "before", "score", "score_", "mix_n", "dedup_row", "dedup_gone", "digest", "class", "item", "bucket", "Text2"]
LABELS = "doc_id long, quality int, toxic int"


def hostile(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in HOSTILE)
    return spark.createDataFrame([(i, t, "en", s, None, *(f"{c}-{i}" for c in HOSTILE)) for i, t, s in rows], schema)


LONG = " ".join(random.Random(2).choices(["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(5000)], k=300_000))
ROWS = [(1, "one two three\nfour five six", "a"), (1, "one two three\nfour five six", "a"), (2, None, None), (3, "", "a"), (None, "one two three\nother words here", "b"), (4, LONG, "b"), (5, LONG + "\nlast", "b")]
OPERATORS = {
    "line dedup": lambda docs: line_dedup.dedup_lines(docs, wide=True),
    "mixing": mixing.mix_sources,
    "jaccard": jaccard.one_of_each,
    "quality": lambda docs: quality.keep_good(docs, docs.sparkSession.createDataFrame([], LABELS)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name_come_out_as_they_went_in(spark, name):
    docs = hostile(spark, ROWS)
    out = OPERATORS[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in HOSTILE)
    assert OPERATORS[name](docs.limit(0)).count() == 0
    if name == "jaccard":
        assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4]
    if name == "line dedup":
        assert len(rows) == 7 and sorted(r.text[-4:] for r in rows if r.doc_id == 5) == ["last"]


def test_pieces_keep_columns_of_any_name(spark):
    pieces = hostile(spark, ROWS[:2]).withColumns({"piece": F.lit(0), "length": F.lit(7).cast("long"), "offset": F.lit("x")})
    out = packing.pack_pieces(pieces, 16)
    assert all(r[c] == f"{c}-1" for r in out.collect() for c in HOSTILE)
    assert sorted((r.sequence_id, r.offset) for r in out.collect()) == [(0, 0), (0, 7)]


def test_rows_without_ids_draw_by_their_text(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 1000, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, weights).groupBy("source").count().collect()}
    assert all(abs(k - 2000) < 200 for k in n.values())


def test_poisson_steps_for_any_rate(spark):
    rates = spark.createDataFrame([("z", 0.0), ("s", 0.3), ("l", 900.0)], "source string, rate double")
    import math

    for r in mixing.poisson_steps(rates).join(rates, "source").collect():
        assert abs(r.cdf[-1] - 1) < 1e-9 and r.cdf == sorted(r.cdf)
        assert math.isclose(r.cdf[0], math.exp(-r.rate), rel_tol=1e-9)


def test_numerals_are_no_letters(spark):
    model = language.fit([("the cat and the dog\n" * 20, "en"), ("der hund und die katze\n" * 20, "de")])
    docs = spark.createDataFrame([(1, "½ ² 3"), (2, "½cat the"), (3, None), (4, "--")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert got[1] == got[3] == got[4] == ("und", 0.0) and got[2][0] == "en"


def test_long_texts_end_in_time(spark):
    assert language.fit([(LONG, "x")]).label([LONG * 2])[0][0] == "x"
    assert secrets.scan(LONG * 2) == []


def test_tables_of_other_threads_stay(spark):
    import threading

    mark = scratch.written()
    mine = scratch.materialize(spark.range(3), "mine")

    def other():
        at = scratch.written()
        scratch.materialize(spark.range(2), "theirs")
        scratch.discard_since(at, spark)

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert mine.count() == 3
    scratch.discard_since(mark, spark)


def test_pipeline_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9)))
    clean = ["\n".join(" ".join(word() for _ in range(30)) for _ in range(4)) for _ in range(12)]
    near = clean[0].split("\n")
    near = "\n".join([near[0] + " changed", *near[1:]])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*clean, clean[1], near])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == list(range(12))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= set(range(12)) and out
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
