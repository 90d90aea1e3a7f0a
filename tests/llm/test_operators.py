"""The training-data operators against brute force, libraries and planted cases."""

import collections
import glob
import hashlib
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterflow.llm import (common, exact_dedup, near_dedup, packing, quality, spotsigs, suffix_dedup,
                           toxicity, url_filter, word_bpe)

SCHEMA = "doc_id long, text string, keep_id string, lang string"


def _random_docs(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "naïve", "東京", "x1", "don't"]
    line = "a passage that very many of the documents here share, word for word. "
    docs = []
    for i in range(n):
        t = " ".join(rnd.choices(words, k=rnd.randint(0, 120)))
        if i % 3 == 0:
            at = rnd.randint(0, len(t))
            t = t[:at] + line + t[at:]
        docs.append((i * 7, t, "clash", "en"))
    for i in range(8):                                   # exact and near copies
        src = docs[i][1]
        docs.append((1000 + i, src, "clash", "en"))
        docs.append((2000 + i, src + " tail", "clash", "fr"))
    docs += [(5000, None, None, None), (5001, "", None, None), (5002, " \t\n", None, None),
             (5003, "word " * 30000, None, None), (5004, "one two", None, "en"), (5005, "one two", None, "en")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_random_docs(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and null texts."""
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, None), (2, None),
            (3, ""), (None, "only null id"), (4, "a  b"), (5, "a b")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts():
    return {i: t or "" for i, t, _, _ in _random_docs()}


def test_exact_dedup_against_brute_force(docs):
    got = exact_dedup.exact_dedup(docs, first_bytes=4, next_bytes=16, growth=4).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in _texts().items()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    assert len(got) == len(norm)
    for r in got:
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), r.doc_id == min(g))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
        assert r.lang == next(x[3] for x in _random_docs() if x[0] == r.doc_id)


def test_exact_dedup_odd_rows(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == 9
    same = [r for r in got if r.text == "same text here"]
    assert {r.keep_id for r in same} == {1} and {r.group_size for r in same} == {3}
    assert sum(r.kept for r in same) == 1
    empty = [r for r in got if not r.text]
    assert {r.keep_id for r in empty} == {2} and sum(r.kept for r in empty) == 1
    assert [r.kept for r in got if r.text == "only null id"] == [True]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_packing_covers_every_id_once(docs, none):
    from tokenizers import Tokenizer

    path = common.tokenizer_path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in _texts().items()}
    rows = packing.packed(docs).collect()
    seen = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, want in ids.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0            # no padding is needed
    assert packing.packed(none).count() == 0


def test_byte_bpe_equals_library():
    from tokenizers import Tokenizer
    from meterflow.llm.byte_bpe import ByteBpe

    path = common.tokenizer_path(packing.TOKENIZER)
    own, library = ByteBpe(path, cache_entries=50), Tokenizer.from_file(path)
    rnd = random.Random(5)
    alphabet = [chr(i) for i in range(0x250)] + list("  \n\t''sdtmrevl") * 20 + list("’“—…　中é​٣²")
    for _ in range(3000):
        s = "".join(rnd.choices(alphabet, k=rnd.randint(0, 30)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    s = "a <|endoftext|> b"
    assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_word_bpe_equals_library(docs, none):
    from tokenizers import Tokenizer

    path = common.tokenizer_path(word_bpe.TOKENIZER)
    library = Tokenizer.from_file(path)
    rows = word_bpe.decode(word_bpe.encode(docs, path, buckets=3, block_bytes=500), path).collect()
    texts = _texts()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert word_bpe.encode(none, path).count() == 0


def test_word_bpe_of_unbroken_texts(spark):
    """Words of more than 40,000 tokens: white space cuts neither of them."""
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    texts = {1: "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)),
             2: "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100_000)),
             3: "a few short words"}
    texts[4] = f"before {texts[1]} after {texts[2]}"
    path = common.tokenizer_path(word_bpe.TOKENIZER)
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in word_bpe.encode(docs, path, buckets=2).collect()}
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert min(len(want[1]), len(want[2])) > 40_000
    assert got == want


def test_word_bpe_shuffles_no_documents(spark, docs):
    """Of the two sides that meet by block only the words' ids are shuffled; the documents' table is dealt by block."""
    path = common.tokenizer_path(word_bpe.TOKENIZER)
    plan = word_bpe.encode(docs, path)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and not any("ranks" in line or "codes" in line for line in shuffles)
    sides = plan[plan.index("FlatMapCoGroupsInArrow"):]
    documents = next(line for line in sides.splitlines() if "FileScan" in line and "ranks" in line)
    assert "Bucketed: true" in documents


def test_word_bpe_decodes_odd_ids(spark):
    """Ids outside the vocabulary add nothing; lists are spelled in parts of whole rows."""
    path = common.tokenizer_path(word_bpe.TOKENIZER)
    lists = [[5, 70_000, 9], [], None, [1 << 31], list(range(300))]
    rows = spark.createDataFrame([(i, None if x is None else np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)],
                                 "doc_id long, ids binary")
    pieces = {i: p for p, i in word_bpe._library(path).get_vocab(with_added_tokens=True).items()}
    got = {r.doc_id: r.decoded for r in word_bpe.decode(rows, path).collect()}
    assert got == {i: " ".join(pieces[j] for j in x or [] if j in pieces) for i, x in enumerate(lists)}
    batch = word_bpe.pa.record_batch([word_bpe.pa.array([r.ids for r in rows.collect()], word_bpe.pa.binary())], ["ids"])
    bound, word_bpe.SPELLED = word_bpe.SPELLED, 4
    try:
        parts = [p.num_rows for p in word_bpe._parts(batch, "ids")]
    finally:
        word_bpe.SPELLED = bound
    assert parts == [4, 1]


def _brute_components(texts, words, num, den):
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j:j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("limit", [256, 2])
def test_near_dedup_against_brute_force(docs, none, limit):
    want = _brute_components(_texts(), 3, 85, 100)
    got = near_dedup.near_dedup(docs, 3, (85, 100), node_limit=limit).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_dedup(none).count() == 0


def test_near_dedup_keeps_signatures_of_classes_only(spark, docs, monkeypatch):
    """The wide profiles go once the classes are written; a sketch's hashes take 3 bytes."""
    kept, materialise = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: kept.append(materialise(df, name)) or kept[-1])
    near_dedup.near_dedup(docs, 3, (85, 100)).count()
    wide = [f for df in kept if "low" in df.columns for f in df.inputFiles()]
    there = [f for f in wide if os.path.exists(f.removeprefix("file://"))]
    assert wide and all("/classes/" in f for f in there) and there
    low = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 50, np.uint64))
    assert len(near_dedup._packed(low)) == 150
    assert near_dedup._unpacked(near_dedup._packed(low)).tolist() == (low >> np.uint64(40)).tolist()


def test_near_dedup_odd_rows(odd):
    got = near_dedup.near_dedup(odd, 3, (85, 100)).collect()
    assert len(got) == 9
    assert {r.component_id for r in got if r.n_shingles == 0} == {None, 2, 3}


@pytest.mark.parametrize("bound", [250_000, 30])
def test_components_of_chain_and_hub(spark, monkeypatch, bound):
    monkeypatch.setattr(near_dedup, "TASK_EDGES", bound)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    comp = {r.vid: r.comp for r in got}
    assert all(comp[i] == 0 for i in range(1, 41))
    assert all(comp[i] == 100 for i in range(101, 160)) and comp[300] == 200
    none = spark.createDataFrame([], "a long, b long")
    assert near_dedup.components(none).count() == 0


def _brute_ranges(texts, n=50):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        mark = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first.setdefault(b[s:s + n], i) < i:
                mark[s:s + n] = b"\1" * n
        out[i] = bytes(mark)
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 400])
def test_suffix_dedup_against_brute_force(docs, none, chunk):
    texts = _texts()
    want = _brute_ranges(texts)
    rows = suffix_dedup.suffix_dedup(docs, buckets=5, chunk_bytes=chunk).collect()
    assert len(rows) == len(texts)
    for r in rows:
        mark = bytearray(r.n_bytes)
        for x in r.removed:
            mark[x.start:x.stop] = b"\1" * (x.stop - x.start)
        assert bytes(mark) == want[r.doc_id]
        raw = texts[r.doc_id].encode()
        assert bytes(r.kept_bytes) == bytes(c for c, m in zip(raw, want[r.doc_id]) if not m)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def _prose(n, words=150):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 10, 4000)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 4000, words)) for _ in range(n)]
    return [t if i % 3 else texts[i // 2][:400] + t for i, t in enumerate(texts)]


def _peak(function):
    tracemalloc.start()
    try:
        out = function()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_suffix_dedup_steps_hold_little_beside_their_rows():
    """A chunk's windows are hashed a part at a time; a bucket's records are held once."""
    texts = [t.encode() for t in _prose(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array([0] * 6000, pa.int32()),
                                        pa.array(texts, pa.binary())], ["_id", "_tag", "_body"])
    run = suffix_dedup._records(np.zeros(0, "S16"), 1, 50, suffix_dedup.CHUNK_BYTES)
    rows, chunk = _peak(lambda: list(run(iter([batch]))))
    got, bucket = _peak(lambda: suffix_dedup._bucket(50)(pa.Table.from_batches(rows)))
    firsts = {}
    for r in got.to_pylist():
        if r["start"] < 400:
            firsts.setdefault(r["id"], set()).update(range(r["start"], min(r["stop"], 400)))
    assert all(len(firsts[i]) == 400 for i in range(3, 6000, 3)) and 0 not in firsts
    size = sum(map(len, texts)) / 1e6
    assert 5 < size and chunk < 23 * size and bucket < 20 * size, (size, chunk, bucket)


def test_suffix_dedup_removes_the_records_before_the_texts_travel(spark, docs, monkeypatch):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left, materialise = [], common.materialise

    def files():
        return {f for d in blocks.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}

    def watched(df, name):
        before = files()
        out = materialise(df, name)
        until = time.time() + 10            # removal is asked for, not waited for
        while files() - before and time.time() < until:
            time.sleep(0.1)
        left.append(files() - before)
        return out

    monkeypatch.setattr(common, "materialise", watched)
    ranges = suffix_dedup.repeated_ranges(docs, buckets=5)
    assert left == [set()]
    assert ranges.count() == len([m for m in _brute_ranges(_texts()).values() if any(m)])


def test_suffix_dedup_odd_rows(odd):
    assert suffix_dedup.suffix_dedup(odd).count() == 9


def _labelled(spark):
    rnd = random.Random(11)
    words = ["stone", "river", "cloud", "paper", "green", "window", "table", "quiet"]
    rows, labels = [], []
    for i in range(400):
        parts = [" ".join(rnd.choices(words, k=8)) + "." for _ in range(rnd.randint(1, 6))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            parts.insert(rnd.randint(0, len(parts)), f"you {rnd.choice(['rotten', 'vile'])} thing.")
        text = " ".join(parts)
        rows.append((i, text.upper() + " $$$ ###" * 5 if bad else text))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "you vile thing")]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows_and_sentences(spark, none):
    docs, labels = _labelled(spark)
    model = toxicity.fit(toxicity.collect_bounded(toxicity.training_rows(docs, labels, "toxic"), 1 << 20))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i].score >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    assert got[1000].score == got[1001].score == 0
    hit = [got[i] for i in held if i % 20 == 4]
    assert all(any("rotten" in s.text or "vile" in s.text for s in r.offending) for r in hit)
    assert toxicity.score(none, model).count() == 0


def test_a_text_beyond_the_sample_bound_does_not_cut_the_rest(spark):
    rows = [(f"text number {i} é", i % 2) for i in range(40)]
    size = sum(len(t.encode()) for t, _ in rows)
    big = [("é" * size + str(i), i % 2) for i in range(6)]         # fit by neither bytes nor order
    frame = lambda r: spark.createDataFrame(r, "_text string, _label int")
    with pytest.warns(UserWarning, match="do not fit"):
        got = toxicity.collect_bounded(frame(rows + big), size)
    assert sorted(got) == sorted(rows)
    with pytest.warns(UserWarning, match="do not fit"):            # bytes count, not characters; copies one by one
        assert len(toxicity.collect_bounded(frame([("éé", 0)] * 4 + [("ab", 1)]), 10)) == 3
    with pytest.raises(ValueError, match="label 1"):
        toxicity.collect_bounded(frame(rows[::2] + big), size)


def test_quality_on_held_out_rows(spark, none):
    docs, labels = _labelled(spark)
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 5 != 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    assert quality.score(none, model).count() == 0


def test_quality_tables_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((quality.scores(x, model) >= 0.5) == y).mean() > 0.9


def test_labels_of_held_out_rows_are_not_learnt_from(spark):
    docs, labels = _labelled(spark)
    rows = toxicity.training_rows(docs, labels.where(common.held_out()), "toxic")
    assert rows.count() == 0


def _brute_sigs(text, anchors, chain):
    w = re.findall(r"[^\W\d_]+", text.lower())
    content = [(i, x) for i, x in enumerate(w) if x not in anchors]
    out = set()
    for i, x in enumerate(w):
        if x in anchors:
            after = [c for j, c in content if j > i][:chain]
            if len(after) == chain:
                out.add(" ".join(after))
    return {zlib.crc32(s.encode()) for s in (out or w)}


def test_spotsigs_against_brute_force(docs, none):
    texts = dict(sorted(_texts().items()))
    anchors = spotsigs.anchor_words(docs, n=3)
    got = {r.doc_id: r for r in spotsigs.spot_fingerprints(docs, anchors, buckets=4).collect()}
    ids = list(texts)
    for k, i in enumerate(ids):
        after = texts[ids[(k + 1) % len(ids)]]
        half = len(texts[i]) // 2
        edited = texts[i][:len(texts[i]) - half] + after[:half]
        own, new, nxt = (_brute_sigs(t, anchors, 2) for t in (texts[i], edited, after))
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(f"{x:08x}" for x in sorted(own))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(own, new)), pytest.approx(like(own, nxt)))
    assert spotsigs.spot_fingerprints(none, anchors).count() == 0


def test_spotsigs_similar_documents(docs):
    anchors = spotsigs.anchor_words(docs, n=3)
    sigs = collections.defaultdict(list)
    for i, t in _texts().items():
        if s := frozenset(_brute_sigs(t, anchors, 2)):
            sigs[s].append(i)
    first = {min(v): s for s, v in sigs.items()}
    want = {(a, b) for a in first for b in first
            if a < b and len(first[a] & first[b]) >= 0.6 * len(first[a] | first[b])}
    got = spotsigs.similar_documents(docs, anchors, 0.6).collect()
    assert {(r.a, r.b) for r in got} == want


def test_url_parts_and_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x=/fr"), (2, "https://a.example.com/en/2"), (3, "ftp://b.net/es/#t"),
            (4, None), (5, "no scheme"), (6, "https://c.org?q=1"), (7, "http://xnet/es/"), (8, "http://example.com")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    hosts = url_filter.outcomes(pages, labels)
    assert {r.host: (r.n, r.bad) for r in hosts.collect() if r.n} == {
        "www.example.com": (1, 1), "a.example.com": (1, 0)}
    got = {r.page_id: r for r in url_filter.judge(pages, hosts).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("b.net", "/es/", "net/es/")
    assert [(got[i].host, got[i].path, got[i].rule) for i in (4, 5)] == [("", "", None)] * 2
    assert (got[6].host, got[6].path, got[6].rule) == ("c.org", "", None)
    assert got[7].rule is None and got[8].rule is None
    none = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter.judge(none, url_filter.outcomes(none, labels)).count() == 0


def test_url_reputation_of_multi_label_suffixes_ports_and_addresses(spark):
    hosts = [("a.bad.co.uk", 300, 300), ("new.bad.co.uk", 0, 0), ("a.good.co.uk", 300, 0), ("new.good.co.uk", 0, 0),
             ("bad.org:8080", 50, 50), ("bad.org", 1, 1), ("10.0.0.1", 200, 200), ("10.9.0.1:81", 200, 0)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert got["new.bad.co.uk"].mean > got["new.good.co.uk"].mean + 0.3
    assert "bad.org:8080" not in got and got["bad.org"].mean > 0.9
    assert got["10.0.0.1"].mean > 0.9 and got["10.9.0.1"].mean < 0.1
    pages = spark.createDataFrame([(1, "http://bad.org:8080/x"), (2, "http://new.good.co.uk/")], "page_id long, url string")
    seen = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert seen[1].host == "bad.org:8080" and seen[1].verdict == "block" and seen[2].verdict == "allow"


def test_url_reputation_shrinks_towards_the_domain(spark):
    hosts = [(f"h{i}.bad.net", 50, 49) for i in range(5)] + [(f"h{i}.good.net", 50, 1) for i in range(5)]
    hosts += [("new.bad.net", 0, 0), ("new.good.net", 0, 0)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert got["new.bad.net"].mean > 0.8 and got["new.good.net"].mean < 0.2
    assert got["new.bad.net"].upper - got["new.bad.net"].lower > got["h1.bad.net"].upper - got["h1.bad.net"].lower
