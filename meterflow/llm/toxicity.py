"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of the words it holds; a document's
score is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels
are known, so the word weights are trained through the noisy-or: a toxic
document needs one offending sentence, a clean one none.  Scoring also says
which sentences offend.
"""

from __future__ import annotations

import math
import warnings
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.3
#: Bounds of the training sample: labelled rows of each class and bytes of
#: text in all.  Sampling is by a hash of the id, so any size behaves alike.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 20 << 20
MIN_DOCS = 12
EPOCHS = 60
SHRINK = 0.05
PREFIXES = (5, 7)

_SENTENCE = regex.compile(r"[.!?\n]+(?:\s+|$)|\n")
_WORD = regex.compile(r"[^\W\d_]+")
MAX_SENTENCE_WORDS = 192


def sentences(text: str) -> list[str]:
    """Sentences of a text: cut after . ! ? and at line ends; empty parts go."""
    return [s for s in _SENTENCE.split(text) if s.strip()]


def words(sentence: str) -> list[str]:
    """Lower-cased words, each long one also with its beginnings (as w-)."""
    found = _WORD.findall(sentence.lower())
    return found + [f"{w[:n]}-" for n in PREFIXES for w in found if len(w) > n]


def _bags(text: str) -> list[list[str]]:
    """Distinct words of each sentence; a run of words without sentence ends
    is cut every MAX_SENTENCE_WORDS words, so that a bag stays small."""
    out = []
    for s in sentences(text):
        w = words(s)
        for i in range(0, len(w), MAX_SENTENCE_WORDS):
            out.append(list(set(w[i:i + MAX_SENTENCE_WORDS])))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id",
                  text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of a bounded sample of the labelled rows that are not held
    out: ``rows`` of each class at most, the smallest by a hash of the id."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
             .where(~common.held_out(id_col)))
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = [known.where(F.col("_label") == v).orderBy(order, id_col).limit(rows) for v in (0, 1)]
    return (docs.select(id_col, common.text_of(text_col).alias("_text"))
            .join(F.broadcast(chosen[0].unionAll(chosen[1])), id_col)
            .select("_text", "_label"))


def collect_bounded(frame: DataFrame, max_bytes: int) -> list[tuple[str, int]]:
    """The sample's rows, in an order that does not follow their label, with
    ``max_bytes`` of UTF-8 text in all: a text that no longer fits is left out
    and the next ones are tried.  Sizes are looked at first, so only the texts
    that are kept reach the driver.  A warning says how many texts did not fit,
    and if a label has no rows; a label whose rows all do not fit is an error."""
    frame = common.materialise(frame, "sample").select("_text", "_label", F.xxhash64("_text").alias("_h"))
    left, fits, seen = max_bytes, Counter(), Counter()
    for h, label, n in frame.select("_h", "_label", F.octet_length("_text")).orderBy("_h", "_label").collect():
        seen[label] += 1
        if n <= left:
            left -= n
            fits[h, label] += 1
    kept = Counter()
    for (_, label), k in fits.items():
        kept[label] += k
    for label in (0, 1):
        if seen[label] and not kept[label]:
            raise ValueError(f"none of the {seen[label]} sampled texts of label {label} fits {max_bytes} bytes")
        if kept[label] < seen[label]:
            warnings.warn(f"{seen[label] - kept[label]} of {seen[label]} sampled texts of label {label} do not fit")
        if not seen[label]:
            warnings.warn(f"no labelled text has label {label}: the model is constant")
    if not fits:
        return []
    keys = frame.sparkSession.createDataFrame(list(fits), "_h long, _label int")
    out = []
    for text, label, h in frame.join(F.broadcast(keys), ["_h", "_label"]).select("_text", "_label", "_h").orderBy(
            "_h", "_label").toLocalIterator():
        if fits[h, label]:
            fits[h, label] -= 1
            out.append((text, label))
    return out


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, min_docs: int = MIN_DOCS,
        shrink: float = SHRINK) -> dict:
    """Word weights, trained through the noisy-or by Adam on whole documents; a
    soft threshold after each step keeps the words that labels don't bear out at 0."""
    y = np.array([v for _, v in rows], float)
    seen: dict[str, int] = {}
    for text, _ in rows:
        for w in {w for bag in _bags(text) for w in bag}:
            seen[w] = seen.get(w, 0) + 1
    vocab = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= min_docs))}
    del seen
    base = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    doc_of, ptr, flat = array("q"), array("q", [0]), array("q")
    for d, (text, _) in enumerate(rows):
        for bag in _bags(text):
            flat.extend(vocab[w] for w in bag if w in vocab)
            ptr.append(len(flat))
            doc_of.append(d)
    if not vocab or len(set(y.tolist())) < 2:
        return {"weights": {}, "bias": -4.0, "prior": base}
    flat, ptr, doc_of = (np.frombuffer(x, np.int64) for x in (flat, ptr, doc_of))
    sent = np.repeat(np.arange(len(doc_of)), np.diff(ptr))
    n = len(y)
    w, bias = np.zeros(len(vocab)), np.array([-4.0])
    m = [np.zeros_like(w), np.zeros(1)]
    v = [np.zeros_like(w), np.zeros(1)]
    balance = np.where(y == 1, 0.5 / base, 0.5 / (1 - base))
    for step in range(1, epochs + 1):
        z = bias[0] + np.bincount(sent, w[flat], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        score = np.clip(1 - np.exp(log_clean), 1e-6, 1 - 1e-6)
        # d loss / d z of a sentence: for label 1 -(1-P)/P * p, for label 0 p
        outer = np.where(y == 1, -(1 - score) / score, 1.0) * balance
        g = outer[doc_of] * p
        grads = [np.bincount(flat, g[sent], len(w)) / n + 1e-5 * w, np.array([g.sum() / n])]
        for k, (x, grad) in enumerate(zip((w, bias), grads)):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            x -= 0.3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        np.clip(bias, -12, 0, out=bias)
    return {"weights": {t: float(w[i]) for t, i in vocab.items() if abs(w[i]) > 1e-3},
            "bias": float(bias[0]), "prior": base}


def score_text(text: str, model: dict) -> tuple[float, list[float]]:
    """The document's noisy-or and the score of each of its sentences."""
    get, bias = model["weights"].get, model["bias"]
    each, log_clean = [], 0.0
    for s in sentences(text):
        w, worst = words(s), 0.0
        for i in range(0, len(w), MAX_SENTENCE_WORDS):
            z = bias + sum(get(x, 0.0) for x in set(w[i:i + MAX_SENTENCE_WORDS]))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            worst = 1 - (1 - worst) * (1 - p)
        each.append(worst)
        log_clean += math.log1p(-min(worst, 1 - 1e-12))
    return min(1.0, max(0.0, 1 - math.exp(log_clean))), each


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          sentence_threshold: float = 0.3) -> DataFrame:
    """The id, ``score`` and ``offending`` (index, score and text of each
    sentence at or above the threshold) of every row.

    Defined cases: null and empty texts have no sentence and score 0; null ids
    and repeated rows give a row each; an empty table gives an empty result;
    other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = common.schema_of(f"_id {kind}, score double, "
                              "offending array<struct<sentence:int,score:double,text:string>>")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                total, each = score_text(text, own)
                scores.append(total)
                found.append([{"sentence": i, "score": p, "text": s} for i, (p, s) in
                              enumerate(zip(each, sentences(text))) if p >= sentence_threshold]
                             if total >= sentence_threshold else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()),
                 pa.array(found, pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()),
                                                     ("text", pa.string())])))],
                [f.name for f in schema])

    out = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text")
                      ).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(collect_bounded(training_rows(docs, labels, "toxic"), SAMPLE_BYTES))
    return score(docs, model).select(
        "doc_id", common.held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("offending_sentences"))
