"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins.  Boosting goes round the features in
turn; each step fits a shallow tree on one feature's bins and adds it to that
feature's lookup table.  Then the pairs of features that explain most of what
is left get tables of their own, boosted by four-leaf trees over two
features.  A score is the logistic of the intercept and one looked-up addend a
table, computed for a whole Arrow batch at once.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import collect_bounded, training_rows

THRESHOLD = 0.7
#: Bounds of the training sample, as for the toxicity model.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 28 << 20
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIRS = 8
PAIR_ROUNDS = 40
RATE = 0.15
MIN_LEAF = 8
RIDGE = 2.0

FEATURES = ("chars", "words", "word_chars", "upper", "lower", "digit", "mark", "symbol", "wide",
            "space", "line_chars", "distinct", "top_word", "repeat", "line_copies", "packed",
            "short", "end_marks", "bare_words", "run")

_CLASS = np.zeros((256, 7), np.int64)
for _i in range(256):
    _c = chr(_i)
    _k = (0 if _c.isascii() and _c.isupper() else 1 if _c.isascii() and _c.islower() else
          2 if _c.isascii() and _c.isdigit() else 3 if _c in ".,;:!?'\"()-" else
          5 if _i >= 128 else 6 if _c.isspace() else 4)
    _CLASS[_i, _k] = 1


def features(text: str) -> list[float]:
    """Shares and counts of the whole text; the empty text is all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    upper, lower, digit, mark, symbol, wide, space = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS) / n
    found = text.split()
    k = len(found) or 1
    count: dict[str, int] = {}
    for w in found:
        count[w] = count.get(w, 0) + 1
    lines = text.split("\n")
    same = sum(a == b for a, b in zip(found, found[1:]))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    bare = sum(map(str.isalpha, found))
    half = found[: len(found) // 2]
    run = len(set(half) & set(found[len(found) // 2:])) / (len(set(half)) or 1)
    return [math.log1p(n), math.log1p(len(found)), float(sizes.mean()) if len(found) else 0.0,
            upper, lower, digit, mark, symbol, wide, space, math.log1p(n / len(lines)),
            len(count) / k, max(count.values(), default=0) / k, same / k,
            1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / n,
            float((sizes <= 3).mean()) if len(found) else 0.0,
            sum(w[-1] in ".!?" for w in found) / k, bare / k, run]


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _value(g, h):
    return -g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of two cuts on one feature's bin sums: one addend a bin."""
    gain = lambda a, b: a * a / (b + RIDGE)

    def cut(lo: int, hi: int):
        gl, hl, nl = (np.cumsum(v[lo:hi])[:-1] for v in (g, h, n))
        if not len(gl):
            return 0.0, None
        gt, ht, nt = g[lo:hi].sum(), h[lo:hi].sum(), n[lo:hi].sum()
        won = gain(gl, hl) + gain(gt - gl, ht - hl) - gain(gt, ht)
        won[(nl < MIN_LEAF) | (nt - nl < MIN_LEAF)] = 0
        at = int(won.argmax())
        return (float(won[at]), lo + at + 1) if won[at] > 0 else (0.0, None)

    parts = [(0, len(g))]
    for _ in range(2):
        won, at, part = max(((*cut(*p), p) for p in parts), key=lambda x: x[0])
        if at is None:
            break
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    out = np.zeros(len(g))
    if len(parts) > 1:
        for lo, hi in parts:
            out[lo:hi] = _value(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts over two features' bin sums: gain and table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    q = []
    for c in (cg, ch):
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        q.append((a, top - a, left - a, all_ - top - left + a))
    if not q[0][0].size:
        return 0.0, np.zeros_like(g)
    won = sum(a * a / (b + RIDGE) for a, b in zip(*q))
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    table = np.zeros_like(g)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                      (slice(i + 1, None), slice(0, j + 1)),
                                      (slice(i + 1, None), slice(j + 1, None)))):
        table[rows, cols] = _value(q[0][k][i, j], q[1][k][i, j])
    return float(won[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> dict:
    """Tables of the model from features ``x`` and labels ``y`` (0 or 1);
    ``weight`` undoes a sample's share of either label."""
    n, k = x.shape
    weight = np.ones(n) if weight is None else weight
    if not n or len(set(y.tolist())) < 2:
        base = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
        return {"bias": math.log(base / (1 - base)), "edges": [], "tables": [], "coarse": [], "pairs": []}
    edges = [_edges(x[:, j], BINS) for j in range(k)]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    fine = [_bin(x[:, j], e) for j, e in enumerate(edges)]
    wide = [_bin(x[:, j], e) for j, e in enumerate(coarse)]
    base = float(np.clip(np.average(y, weights=weight), 0.01, 0.99))
    bias = math.log(base / (1 - base))
    f = np.full(n, bias)
    tables = [np.zeros(len(e) + 1) for e in edges]

    def grads():
        p = 1 / (1 + np.exp(-f))
        return weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = grads()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(fine[j], g, size), np.bincount(fine[j], h, size),
                                np.bincount(fine[j], minlength=size))
            tables[j] += step
            f += step[fine[j]]

    def sums(a, b):
        g, h = grads()
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = wide[a] * shape[1] + wide[b]
        return (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    ranked = sorted(((_quadrants(*sums(a, b))[0], a, b) for a, b in itertools.combinations(range(k), 2)),
                    reverse=True)[:PAIRS]
    pairs = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in ranked}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in pairs.items():
            step = RATE * _quadrants(*sums(a, b))[1]
            table += step
            f += step[wide[a], wide[b]]
    return {"bias": bias, "edges": edges, "tables": tables, "coarse": coarse,
            "pairs": [(a, b, t) for (a, b), t in pairs.items()]}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    """Vectorised bin additions for all rows of ``x``."""
    f = np.full(len(x), model["bias"])
    for j, (e, t) in enumerate(zip(model["edges"], model["tables"])):
        f += t[_bin(x[:, j], e)]
    for a, b, t in model["pairs"]:
        f += t[_bin(x[:, a], model["coarse"][a]), _bin(x[:, b], model["coarse"][b])]
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(~common.held_out(id_col)).groupBy(F.col(label).alias("v")).count()
    share = {r["v"]: r["count"] for r in known.where(F.col("v").isin(0, 1)).collect()}
    rows = collect_bounded(training_rows(docs, labels, label, id_col, text_col, SAMPLE_ROWS), SAMPLE_BYTES)
    y = np.array([v for _, v in rows], float)
    x = _matrix([t for t, _ in rows])
    total = sum(share.values()) or 1
    weight = np.array([share.get(int(v), 1) / total / max((y == v).mean(), 1e-9) for v in y])
    return fit(x, y, weight)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns in ``keep`` and ``score`` of every row.

    Defined cases: a null or empty text has all features 0 and the score that
    the tables give them; null ids and repeated rows give a row each; an empty
    table gives an empty result; other columns are left out.
    """
    fields = [docs.schema[c] for c in (id_col, *keep)]
    schema = common.schema_of(", ".join(
        [*(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "_score double"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = scores(_matrix(batch.column(len(fields)).to_pylist()), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())],
                                             [f.name for f in schema])

    out = docs.select(*(F.col(f.name).alias(f"_c{i}") for i, f in enumerate(fields)),
                      common.text_of(text_col).alias("_text")).mapInArrow(run, schema)
    return out.select(*(F.col(f"_c{i}").alias(f.name) for i, f in enumerate(fields)),
                      F.col("_score").alias("score"))


def score_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """The score of each row's text as a column: only the text travels to
    Python, once, and only the score comes back; the rows stay where they are.
    Null and empty texts, null ids and repeated rows are as in ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(_matrix(texts.tolist()), shared.value))

    return F.pandas_udf(run, "double")(common.text_of(text_col))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", common.held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
