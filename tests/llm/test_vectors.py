"""Hard negatives and embedding near-dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import collision_dedup, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rank string"


def _table(n=420, dims=16, seed=5):
    """Families of near copies, exact copies, strangers, and a hot label."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.standard_normal((n, dims))
    for start in range(0, n // 2, 30):            # near copies around one vector, on both sides of the threshold
        vectors[start + 1:start + 30] = vectors[start] + rnd.standard_normal((29, dims)) * 0.12
    vectors[-20:-10] = vectors[-1]                # equal vectors
    vectors = vectors.astype(np.float32)
    labels = np.where(np.arange(n) % 3 == 0, 1, rnd.integers(0, 4, n))
    labels[:90] = 2
    return vectors, labels.astype(int)


@pytest.fixture(scope="module")
def table(spark):
    vectors, labels = _table()
    rows = [(i, [float(x) for x in v], int(l), "clash", "clash") for i, (v, l) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def _odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (2, [1.0, 0.0], None),
            (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1),
            (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 2), (None, [0.0, 3.0], 3), (11, [1e-30, 0.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def _components(linked):
    comp = np.arange(len(linked))
    while True:
        new = np.where(linked, comp[None, :], len(linked)).min(axis=1)
        new = np.minimum(comp, new)
        if (new == comp).all():
            return comp
        comp = new


@pytest.mark.parametrize("bits,block", [(0, 1024), (0, 32), (3, 64), (5, 16)])
def test_links_and_components_against_brute_force(table, bits, block):
    vectors, labels = _table()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    comp = _components(linked)
    assert 0 < (linked.sum(axis=1) > 1).sum() < len(linked)
    got = {r.vec_id: r for r in collision_dedup.collision_dedup(table, bits=bits, block_rows=block).collect()}
    assert len(got) == len(linked)
    for i in range(len(linked)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum() - 1, comp[i], comp[i] == i)
        assert got[i].rank == "clash"


def test_recall_of_a_large_family_at_the_threshold(spark):
    """Pairs between 0.98 and 0.985, in many buckets: none is missed."""
    rnd = np.random.default_rng(8)
    vectors = np.repeat(rnd.standard_normal((700, 64)), 2, axis=0)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    side = rnd.standard_normal((700, 64))
    side -= (side * vectors[::2]).sum(axis=1)[:, None] * vectors[::2]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rnd.uniform(0.9801, 0.985, 700)[:, None]
    vectors[1::2] = cosine * vectors[::2] + np.sqrt(1 - cosine ** 2) * side
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = collision_dedup.collision_dedup(df, bits=6).where("n_links = 1").count()
    assert got == 1400


def test_the_parameters_follow_from_the_recall():
    assert collision_dedup.tables_for(0) == 1
    same = (1 - np.arccos(0.98) / np.pi) ** 8
    assert (1 - same) ** collision_dedup.tables_for(8) <= collision_dedup.MISS / 2
    assert 8 < collision_dedup.least_collisions() < collision_dedup.PROJECTIONS


def test_dedup_of_odd_vectors(spark):
    rows = collision_dedup.collision_dedup(_odd(spark)).collect()
    assert len(rows) == 15
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(4, 1, True)] * 2                        # each other, two null ids, and the short vector
    assert sorted(by[None], key=str) == [(0, None, True), (4, 1, False), (4, 1, False)]
    assert by[11] == [(4, 1, False)]
    for i in (2, 3, 4, 5, 6, 7, 8, 9, 10):
        assert by[i] == [(0, i, True)]
    assert collision_dedup.collision_dedup(_odd(spark).limit(0)).count() == 0


def _expected(vectors, labels, anchors, k=5):
    whole = np.floor(256 * vectors.astype(float)).astype(np.int64)
    out = set()
    for a in anchors:
        s = whole @ whole[a]
        own = [i for i in np.lexsort((np.arange(len(s)), -s)) if labels[i] == labels[a] and i != a][:k]
        rest = [i for i in np.lexsort((np.arange(len(s)), -s)) if labels[i] != labels[a]]
        for p in own:
            fit = [n for n in rest if 80 * s[p] <= 100 * s[n] <= 100 * s[p]][:k]
            out |= {(a, int(p), r + 1, int(n), int(s[p]), int(s[n])) for r, n in enumerate(fit)}
    return out


@pytest.mark.parametrize("bucket,block", [(4096, 512), (40, 7)])
def test_hard_negatives_against_brute_force(table, bucket, block):
    vectors, labels = _table()
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 6 == 0, bucket_rows=bucket, anchor_rows=block).collect()
    expected = _expected(vectors, labels, range(0, len(labels), 6))
    assert len(got) == len(expected) > 100
    assert {tuple(r) for r in got} == expected


def test_pruning_leaves_out_rows_but_none_that_qualifies():
    rnd = np.random.default_rng(1)
    vectors = (rnd.standard_normal((800, 4)) * 100).astype(np.int64)
    bucket = hard_negatives.Bucket(np.arange(800), vectors)
    pruned = 0
    for anchor in vectors[:100]:
        scores = vectors @ anchor
        for theta in (np.partition(scores, -3)[-3], scores.max() // 2, 1, scores.max() + 1):
            at = bucket.candidates(anchor, hard_negatives._length(anchor), float(theta))
            at = np.arange(800) if at is None else at
            assert set(np.flatnonzero(scores >= theta)) <= set(at)
            pruned += 800 - len(at)
    assert pruned > 100_000


def test_scores_beyond_doubles_are_exact():
    vectors = np.array([[2 ** 28, 3], [2 ** 28, 4]], np.int64)
    bucket = hard_negatives.Bucket(np.arange(2), vectors)
    assert bucket.scores(np.array([2 ** 28, 1], np.int64), None).tolist() == [2 ** 56 + 3, 2 ** 56 + 4]


def test_hard_negatives_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (None, [0.9, 0.1], 1), (3, [0.95, 0.0], 2), (4, [0.95, 0.0], 2),
            (5, None, 2), (6, [1.0, float("nan")], 2), (7, [1.0, 0.0], None), (8, [1.0, 0.0, 0.0], 2), (9, [], 2),
            (10, [None, 1.0], 2), (None, [0.95, 0.0], 3), (11, [1e30, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") == 0).collect()
    # each copy of the anchor has the other and the null id as positives; equal scores: ids in order, null last
    assert sorted({(r.positive_id, r.rank, r.negative_id) for r in got}, key=str) == [
        (0, 1, 3), (0, 2, 4), (0, 3, None)]
    assert len(got) == 6
    assert all((r.positive_score, r.negative_score) == (256 * 256, 256 * 243) for r in got)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
