"""Odd inputs of the stages and operators: nulls, empty tables, repeated rows, long texts, ties and columns of clashing names."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from dimweave.llm import ann, jaccard_join, language_id, line_dedup, mixing, packing, url_filters

CLASHING = "score double, rejected string, lang_pred string, n_lines long, n_kept long, copy_no string, row_ long, rank string, component_id long, cls string, range_ long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 0.25, "r", "p", 11, 12, "c", 13, "k", 14, "l", 15)


def _table(spark):
    r = random.Random(21)
    rows = []
    english, spanish = ([c + v for c in "bcdfghklmnprst" for v in ends] for ends in (("a", "e", "ing"), ("ñu", "ción", "o")))
    for i in range(60):
        syllables, lang = (english, "en") if i % 2 else (spanish, "es")
        rows.append(_row(i, "\n".join(" ".join("".join(r.choice(syllables) for _ in range(4)) for _ in range(12)) for _ in range(4)), lang))
    long = " ".join("".join(r.choice(english) for _ in range(5)) for _ in range(40_000))
    rows += [rows[3], rows[3], _row(None, rows[4][1], "es", None), _row(None, None, None, None), _row(70, None), _row(71, ""), _row(72, long), _row(73, "123 ?", None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_keep_other_columns_and_odd_rows(spark, tmp_path):
    rows, docs = _table(spark)
    columns, first = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, first, "").cache()
        assert out.columns == columns, name
        got = out.collect()
        assert all(tuple(x)[5:] == rows[0][5:] for x in got), name
        ids = [x["doc_id"] for x in got]
        if name == "language_id":
            assert not {70, 71, 73} & set(ids) and len(got) == len(rows) - 4
        if name == "line_dedup":  # one of the repeated rows' lines stays, or all rows of that document alike; texts that are none stay
            assert {70, 71, 72, 73} <= set(ids) and len([x for x in got if x["text"] and rows[4][1] in x["text"]]) == 1
        if name == "jaccard_join":
            assert ids.count(3) == 1 and {70, 71, 72, 73} <= set(ids) and [x["text"] for x in got if x["doc_id"] is None] == [None]
            assert len(got) == len(rows) - 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, first, "").collect()
    assert {x["doc_id"] for x in pieces} == {r[0] for r in rows}
    assert [x["length"] for x in pieces if x["doc_id"] in (70, 71)] == [1, 1]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, name, stage):
    empty = spark.createDataFrame([], SCHEMA)
    out = stage(spark, empty, "")
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_operators_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty, {"s": 1.0}).count() == 0
    assert packing.pack(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert language_id.identify_language(empty, language_id.fit_on_documents(empty)).count() == 0


def test_nearest_scores_and_ties(spark):
    """Equal vectors score alike and stand by id; scores are those of the original vectors; few candidates are all given."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(20, [2.0, 1.0]), (40, [1.0, 0.0])]
    vectors = ann.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), ann.fit_router(vectors), k=20).collect()
    by_id = dict(rows)
    for q in (0, 20, 40):
        score = lambda i: sum(a * b for a, b in zip(by_id[q], by_id[i], strict=True))  # noqa: E731, B023
        want = sorted(((-score(i), i) for i in by_id if i != q))
        assert [(-x["score"], x["vec_id"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == want
    assert [x["rank"] for x in sorted(got, key=lambda x: (x["query_id"], x["rank"]))] == [*range(1, 14)] * 3


def test_repeated_and_null_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/9", "h"), (1, "http://x.com/en/9", "h"), (None, None, "h"), (2, None, "h")], "page_id long, url string, host string")
    out = url_filters.filter_urls(pages)
    assert out.count() == 4 and sorted(x["verdict"] for x in out.collect()) == ["allow", "allow", "block", "block"]
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    assert out.where(F.col("host") == "x.com").count() == 2
