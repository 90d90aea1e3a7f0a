"""The pipeline's stages on planted rows, and the registered queries."""

import random

import corpus_pipeline
import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0.5 * size < out.count() <= size, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]


def test_stages_on_planted_rows(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))
    base, clean, passage = text(120), text(90), text(30)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, clean), (5, text(20) + " " + passage + " é"),
            (6, passage + " " + text(20)), (7, None), (8, ""), (None, text(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda stage: {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
    assert set(got(corpus_pipeline.drop_exact_copies)) == {1, 3, 4, 5, 6, 7, None}
    assert set(got(corpus_pipeline.drop_near_copies)) == {1, 4, 5, 6, 7, 8, None}
    left = got(corpus_pipeline.remove_repeated_passages)
    assert left[1] == base and left[4] == clean and left[5] == rows[4][1] and left[7] is None
    assert passage not in left[6] and len(left[6]) < 200 and 2 not in left


def test_eleven_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in (1, 2, 4, 5, 6, 7, 8, 9, 10))
