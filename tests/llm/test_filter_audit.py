"""The filter audit against a plain recount, its SQL, and odd inputs."""

import itertools
import re

import pytest

from meterflow.llm import filter_audit, queries
from meterflow.plans import verify

from ..conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, kept string"


def _fails(docs):
    """For each row the letters it fails, by the definitions."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs):
            fails.add("E")
        out.append(fails)
    return out


def _recount(docs, good, toxic):
    fails, out = _fails(docs), {}
    for part in {lang or "" for _, _, lang in docs}:
        rows = [(f, d[0]) for d, f in zip(docs, fails) if (d[2] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in alive if f in r[0]]
                alive = [r for r in alive if f not in r[0]]
                removed_by[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(alive), len(removed), sum(f in r[0] for r in rows) - len(removed),
                    sum(r[0] == {f} for r in rows), sum(r[1] in good for r in removed), sum(r[1] in toxic for r in removed)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_by[order[step - 1]])
    return out


def _docs():
    long = " ".join(f"word{i}" for i in range(210))
    texts = [long, long, long.upper(), long + " #", "short", "short", "SHORT $", "again " * 300, long[::-1],
             "", None, "SHORT $", "again " * 300, long + " #", "é" * 40 + "A", "tab\tand\x0bmore space", "long " * 60_000]
    langs = ["en", "de", None, ""]
    return [(i * 3, t, langs[i % 4]) for i, t in enumerate(texts)] + [
        (None, "short", "en"), (None, None, "en"), (0, long, "en"), (0, long, "en")]


def test_audit_against_a_recount(spark):
    docs = _docs()
    good, toxic = {0, 6, 12, 99}, {3, 6, 15}
    labels = [(i, 1 if i in good else 0, 1 if i in toxic else None) for i in range(0, 60, 3)] + [(6, 0, 0), (None, 1, 1)]
    got = filter_audit.audit_documents(
        spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA).repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    expected = _recount(docs, good, toxic)
    assert len(got) == len(expected) == 3 * 600
    for r in got:
        assert list(r)[3:] == expected[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)


def test_audit_equals_its_sql(spark):
    got = queries.QUERIES["op12_filter_audit"](spark, SF_SMALL)
    rel = verify.duckdb_connection(SF_SMALL).sql(queries.ORACLE["op12_filter_audit"]).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())


def test_general_interface(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "p", i == 4, None) for i in range(6)],
                                 "key long, part string, good boolean, toxic boolean")
    ids = {"x": [0, 2, 4], "y": [2, 4, 5, 77]}
    fails = {k: spark.createDataFrame([(i,) for i in v], "key long") for k, v in ids.items()}
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.filter_audit(rows, fails, key="key").collect()}
    assert got == {
        ("p", "xy", 1): [0, 3, 0, 1, 1, 0, 4], ("p", "xy", 2): [0, 0, 2, 0, 0, 0, 2],
        ("p", "yx", 1): [1, 2, 0, 0, 1, 0, 2], ("p", "yx", 2): [0, 1, 2, 1, 0, 0, 4],
        ("", "xy", 1): [3, 0, 0, 0, 0, 0, 0], ("", "xy", 2): [2, 1, 0, 1, 0, 0, 2],
        ("", "yx", 1): [2, 1, 0, 1, 0, 0, 2], ("", "yx", 2): [2, 0, 0, 0, 0, 0, 0]}
    with pytest.raises(ValueError):
        filter_audit.filter_audit(rows, {})


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(empty, labels).count() == 0
