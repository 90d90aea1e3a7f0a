"""Whole texts against known licenses, through their canonical form."""

from meterflow.llm import license_scan


def test_license_scan(spark):
    known = spark.createDataFrame([("A", "This Licence, version 1, favours nobody."), ("B", "")], "name string, text string")
    rows = [(1, "this license version 1 FAVOURS nobody", "x"), (2, "Copyright 2020 Someone\nThis licence; version 1 - favours nobody!", None),
            (3, "This licence, version 1, favours nobody. And more.", None), (4, None, None), (5, "", None),
            (None, "(c) 2020 someone", None), (1, "this license version 1 FAVOURS nobody", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = license_scan.license_scan(docs, known).collect()
    assert len(got) == 7
    assert sorted(str(r.doc_id) for r in got if r.license) == ["1", "1", "2"]
    assert license_scan.license_scan(docs.limit(0), known).count() == 0


def test_planted_licenses_are_found_in_long_texts(spark):
    full = {n: t for n, t in license_scan.known_licenses() if len(t) > 300}
    assert {"MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"} <= set(full)
    known = spark.createDataFrame(license_scan.known_licenses(), "name string, text string")
    prose = "Some words of prose that are no license.\n" * 200
    comment = lambda t: "".join(f" * {line}\n" for line in t.splitlines())
    flat = "\n".join(" ".join(p.split()) for p in full["MIT"].split("\n\n"))
    mit = full["MIT"].splitlines()
    texts = {i: f"{prose}\n{t}\n{prose}" for i, t in enumerate(full.values())}
    want = {i: {n} for i, n in enumerate(full)}
    more = [(prose + "Released under the MIT License.\n" + prose, {"MIT"}),
            (f"/*\n * MIT License\n *\n * Copyright (c) 2020 Someone\n{comment(full['MIT'])} */\nint main;\n{prose}", {"MIT"}),
            (prose + flat + "\n" + prose, {"MIT"}),
            (prose + full["MIT"].rstrip() + "\nimport os\n" + prose, {"MIT"}),
            (prose + "\n".join(mit[:5] + ["Not these words."] + mit[5:]) + prose, set()),
            ("\n".join(reversed(mit)) + prose, set()),
            (f"{full['MIT']}\n{prose}\nLicensed under CC BY-NC 4.0.", {"MIT", "CC-BY-NC-4.0"}),
            (f"MIT License\n\nCopyright (c) 2020 Someone\n\n{full['MIT']}", {"MIT"}),
            (f"{prose} Released under the MIT License, as some say.", set()), (prose, set())]
    for t, names in more:
        texts[len(texts)], want[len(want)] = t, names
    rows = [(i, t) for i, t in texts.items() for _ in range(2)]          # each text twice
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert set(r.licenses) == want[r.doc_id] and (r.license in r.licenses if r.licenses else r.license is None), r.doc_id
        assert len(want[r.doc_id]) < 2 or r.license == "MIT"         # the longer one


def test_notices_of_the_table_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = license_scan.op3_license_scan(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {i: {n for n, notice in license_scan.KNOWN if notice.rstrip(".") in t} for i, t in texts.items()}
    assert sum(map(bool, want.values())) > 10
    assert {r.doc_id: set(r.licenses) for r in got} == want


def test_the_costly_expressions_run_only_where_they_can_match(spark):
    """The canonical digest equals that of ``canonical``, and no text is searched by the spellings' expressions one after another."""
    from pyspark.sql import functions as F

    texts = ["", " ", "sub\nlicence of\n\n the copyright\nholder", "COPYRIGHT 2020 x\nper  cent, Per\ncent; analogues",
             "x (c) y\n * (C) z\nfavour", "all rights reserved", "© a\n\n\n-- sub-licence --\n", "plain words\nonly", None]
    known = spark.createDataFrame([("A", "sublicense of"), ("B", "percent percent"), ("C", "plain words")], "name string, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.license_scan(docs, known)
    want = {r.doc_id: r.c for r in docs.select("doc_id", F.sha2(license_scan.canonical(F.col("text")), 256).alias("c")).collect()}
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: r.canonical_sha256 for i, r in rows.items()} == want
    assert rows[2].licenses == ["A"] and rows[7].licenses == ["C"] and rows[0].licenses == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Contains(" in plan
