"""The whole pipeline on planted rows against a plain chain of its stages."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from meterflow.llm import common, packing, quality
from meterflow.streaming.feed import new_run_dir

from .test_operators import _brute_components, _brute_ranges

WORDS = ("stone river cloud paper green window table quiet harbour lantern meadow copper violet thunder basket "
         "morning feather granite orchard silver whisper canyon pepper marble").split()


def _rows():
    rnd = random.Random(21)
    text = lambda n: " ".join(rnd.choices(WORDS, k=n)) + "."
    docs, labels = {}, []
    for i in range(300):
        bad = i % 4 == 0
        docs[i] = (text(60).upper() + " $$$ ### !!!" * 6) if bad else text(60)
        labels.append((i, int(not bad), 0))
    base, passage = text(120), text(25)
    docs |= {1000: base, 1001: base, 1002: base + " tail", 1003: text(70), 1004: f"{text(30)} {passage} {text(30)}",
             1005: f"{text(35)} {passage} {text(35)}", 1006: text(60).upper() + " $$$ ### !!!" * 6, 1007: docs[1]}
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark):
    docs, labels = _rows()
    path = new_run_dir(spark, "test-pipeline")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns(
        {"lang": F.lit("en"), "source": F.lit("hot"), "n_chars": F.length("text")}).repartition(3).write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_equals_the_plain_chain(spark, folder):
    from tokenizers import Tokenizer

    docs, labels = _rows()
    good = {i: t for i, t in docs.items() if "$$$" not in t}           # what the classifier keeps
    kept = {}
    for i in sorted(good):                                              # exact copies
        if good[i] not in kept.values():
            kept[i] = good[i]
    component = _brute_components(kept, 5, 80, 100)
    single = {i: t for i, t in kept.items() if component[i][1] == i}   # near copies
    mark = _brute_ranges(single)                                        # repeated passages
    left = {i: bytes(c for c, m in zip(t.encode(), mark[i]) if not m).decode() for i, t in single.items()}
    left = {i: t for i, t in left.items() if t}
    assert {1001, 1002, 1006, 1007} & set(left) == set() and {1000, 1003, 1004, 1005} <= set(left)
    assert left[1004] == docs[1004] and len(left[1005]) < len(docs[1005])

    library = Tokenizer.from_file(common.tokenizer_path(packing.TOKENIZER))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    pieces = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(want)
    for i, own in pieces.items():
        own.sort()
        assert sum(n for _, n, _ in own) == want[i] == own[0][2]
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))


def test_quality_stage_filters_by_the_model(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels)
    table = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    column = {r.doc_id: r.s for r in docs.select("doc_id", quality.score_column(docs, model).alias("s")).collect()}
    assert table == column
    got = {r.doc_id for r in corpus_pipeline.reject_low_quality(spark, docs, folder).collect()}
    assert got == {i for i, s in table.items() if s >= corpus_pipeline.REJECT_BELOW}
    texts = _rows()[0]
    assert got == {i for i, t in texts.items() if "$$$" not in t}


def test_stages_of_odd_rows(spark, folder):
    """Null and empty texts, null ids, repeated rows: kept or dropped as the stages state."""
    rows = [(1, None), (2, ""), (None, "a few words"), (3, "one two three"), (3, "one two three"), (4, " \t\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, folder).count() <= 6
    assert sorted(map(str, stages["near_dedup"](spark, docs, folder).collect())) == sorted(map(str, docs.collect()))
    packed = stages["packing"](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == {1, 2, None, 3, 4} and packed.count() == 6
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
