"""The stages one after the other, on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert counts[1] > 0.95 * counts[0] and counts[3] > 0.5 * counts[0]
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_one_row_of_each_group_of_near_copies_stays(spark):
    r = random.Random(12)
    a, b, c, d = (" ".join(f"w{r.randrange(4000)}" for _ in range(40)) for _ in range(4))
    rows = [(7, a), (None, a), (None, a + " more"), (None, b), (None, b), (3, c), (3, c), (2, d), (3, d + " x"), (4, d), (9, None), (9, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(x) for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert Counter(left) == Counter([(7, a), (None, b), (3, c), (2, d), (9, None), (9, None), (5, "")])
