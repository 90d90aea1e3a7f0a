"""Repeated passages by range-partitioned, locally sorted suffixes.

A string of LENGTH bytes is a repeat when it also starts in a document with a
smaller id.  To find all of them:

1. Of the suffixes of a text only anchors travel.  An anchor is the place of
   the smallest hashed token (TOKEN bytes) among those that a window of LENGTH
   bytes holds, so equal windows choose the same anchor.  An anchor's record
   is the stretch of text that all its windows cover.
2. Splitters from a sample of anchors cut the order of leading tokens into
   ranges, one a bucket.  Equal records of one chunk of input travel once,
   for the smallest document that has them: a passage that all documents share
   is one record a chunk, not a hot key.
3. A bucket sorts its anchors by their tokens.  Windows whose rolling hash
   occurs once are dropped; the rest are sorted byte by byte (multikey, eight
   bytes at a time) together with their document, and equal neighbours are
   compared.  Equal tokens never straddle a splitter, so no match does.
4. Repeated windows become byte ranges of their documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 50
TOKEN = 16
CHUNK_BYTES = 4 << 20
#: Text whose windows are hashed at once: the arrays take some 60 bytes a byte.
PART_BYTES = 128 << 10
#: Windows that a bucket compares at once, but for those of one token.
SEGMENT_WINDOWS = 128 << 10
#: Text for which there is one bucket at least, so that a bucket's size is bounded.
BUCKET_BYTES = 8 << 20
#: Bound of the splitter sample: anchors kept from it.
SAMPLE_ANCHORS = 100_000
RESULT = ("n_bytes", "removed", "kept_bytes")

_NULL_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BYTE = np.random.default_rng(9).integers(0, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOW = np.uint64(0xFFFFFF)


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, for all places that have them."""
    n = len(buf) - 7
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        out[o::8] = np.frombuffer(buf.data, np.uint64, (n - o + 7) // 8, o)
    return out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """(lo, hi, at, part): windows lo..hi of a part of ``buf`` have their anchor at ``at``."""
    total = len(buf)
    if total < length:
        return (np.zeros(0, np.int64),) * 4
    w = _words_at(buf)
    h = (w[:total - TOKEN + 1] * _M1) ^ (w[8:] * _M2)
    h ^= h >> np.uint64(29)
    h *= _M3
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    size, width = 1, length - TOKEN + 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[:len(m) - (width - size)], m[width - size:])
    at = (m & _LOW).astype(np.int64)                    # anchor of the window from each place on
    part = np.repeat(np.arange(len(starts)), np.maximum(ends - starts - length + 1, 0))
    n = np.maximum(ends - starts - length + 1, 0)
    place = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    at = at[place]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])))) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate((new[1:], [len(at)])) - 1 if len(at) else new
    return place[new], place[last], at[new], part[new]


def _tokens(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, f"S{TOKEN}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, TOKEN)[at]).view(f"S{TOKEN}").ravel()


def _texts(column: pa.Array) -> list[memoryview]:
    """The texts where they lie in the batch, not copies of them."""
    return [memoryview(t.as_buffer()) for t in column]


def _chunks(ids: list, tags: list, texts: list, length: int, chunk_bytes: int):
    """Groups of text parts of some MB; a long text goes in overlapping parts."""
    part_bytes = min(chunk_bytes, PART_BYTES)
    order = sorted(range(len(ids)), key=lambda i: _NULL_ID if ids[i] is None else ids[i])
    parts, size = [], 0
    for i in order:
        text = texts[i]
        for o in range(0, max(len(text) - length + 1, 0), part_bytes):
            part = text[o:o + part_bytes + length - 1]
            if parts and size + len(part) > chunk_bytes:
                yield parts
                parts, size = [], 0
            parts.append((_NULL_ID if ids[i] is None else ids[i], tags[i], o, part))
            size += len(part)
    if parts:
        yield parts


def _load(parts):
    buf = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    sizes = np.array([len(p[3]) for p in parts])
    return buf, np.cumsum(sizes) - sizes, np.cumsum(sizes)


def _chunk_anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """``anchors`` of a chunk, found for a few of its parts at a time."""
    cols, x = [], 0
    while x < len(starts):
        first = starts[x]
        y = max(int(np.searchsorted(ends, first + PART_BYTES, side="right")), x + 1)
        lo, hi, at, part = anchors(buf[first:ends[y - 1]], starts[x:y] - first, ends[x:y] - first, length)
        cols.append([v.astype(np.int32) for v in (lo + first, hi + first, at + first, part + x)])
        x = y
    return tuple(map(np.concatenate, zip(*cols)))


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on, which compresses better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


SCHEMA = "bucket int, id long, tag int, start long, stop long, n int, body binary"


def _records(splitters: np.ndarray, buckets: int, length: int, chunk_bytes: int):
    """Rows with a body: records of one bucket.  Rows without: byte ranges that
    the chunk itself already shows to be repeats."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for parts in _chunks(ids, tags, _texts(batch.column(2)), length, chunk_bytes):
                buf, starts, ends = _load(parts)
                lo, hi, at, part = _chunk_anchors(buf, starts, ends, length)
                token = _tokens(buf, at)
                order = np.argsort(token, kind="stable")
                bucket = np.searchsorted(splitters, token[order], side="right")
                lo, hi, at, part = lo[order], hi[order], at[order], part[order]
                raw, keys = buf.tobytes(), [p[0] for p in parts]
                key_of, tag_of = (np.array([p[j] for p in parts], t) for j, t in ((0, np.int64), (1, np.uint16)))
                pos_of = np.array([p[2] for p in parts], np.int64) - starts
                own, rows = [], []
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
                for x, y in zip(edge, [*edge[1:], len(bucket)]):
                    seen: dict[bytes, int] = {}             # equal records have one token, so one bucket
                    keep, strings = [], []
                    for i, a, b, p in zip(range(x, y), lo[x:y].tolist(), (hi[x:y] + length).tolist(), part[x:y].tolist()):
                        s, doc = raw[a:b], keys[p]
                        first = seen.setdefault(s, doc)
                        if first == doc:
                            keep.append(i)
                            strings.append(s)
                        else:
                            own.append(i)
                    size = np.fromiter(map(len, strings), np.uint8, len(strings))
                    p, head = part[keep], lo[keep]
                    body = b"".join([size.tobytes(), (at[keep] - head).astype(np.uint8).tobytes(),
                                     *map(_planes, (tag_of[p], key_of[p], head + pos_of[p])), *strings])
                    rows.append((int(bucket[x]), None, None, None, None, len(keep), pack(body)))
                ranges = sorted((int(part[i]), int(lo[i]), int(hi[i]) + length) for i in own)
                for p, a, b in _merged(ranges):
                    key, tag, offset, _ = parts[p]
                    shift = offset - int(starts[p])
                    rows.append((int((key ^ tag) % buckets), key, tag, a + shift, b + shift, 0, None))
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def _merged(ranges: list[tuple[int, int, int]]):
    """Sorted (key, start, stop) with those that touch made one."""
    out: list[list[int]] = []
    for k, a, b in ranges:
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return out


def _repeats(buf, size, token_at, key, tag, pos, length):
    """(key, tag, place) of the windows that a smaller key also has.  Records
    come sorted by token; equal tokens are never cut apart."""
    starts = np.cumsum(size) - size
    count = size.astype(np.int64) - length + 1
    rec = np.repeat(np.arange(len(size)), count)
    step = np.arange(len(rec)) - np.repeat(np.cumsum(count) - count, count)
    place = starts[rec] + step
    # rolling hash: windows that occur once need no sorting
    power = np.empty(len(buf) + 1, np.uint64)
    power[0], power[1:] = 1, _M1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power[:-1], dtype=np.uint64)))
    h = (total[place + length] - total[place]) * power[len(buf) - place]
    h ^= h >> np.uint64(31)
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return None
    found = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    some = np.flatnonzero(twice[found] == h)
    rec, place, step = rec[some], place[some], step[some]
    # multikey sort of the windows that are left, eight bytes at a time, then by document
    views = np.lib.stride_tricks.sliding_window_view(buf, length)[place]
    words = [np.ascontiguousarray(views[:, i:i + 8]).view(">u8").ravel().astype(np.uint64) for i in range(0, length - 7, 8)]
    if length % 8:
        words.append(np.ascontiguousarray(views[:, length - 8:]).view(">u8").ravel().astype(np.uint64))
    order = np.lexsort((key[rec], *words[::-1]))
    same = np.ones(max(len(order) - 1, 0), bool)
    for w in words:
        same &= w[order[1:]] == w[order[:-1]]
    group = np.concatenate(([0], np.cumsum(~same)))
    k = key[rec[order]]
    least = k[np.concatenate(([0], np.flatnonzero(~same) + 1))]
    hit = order[k > least[group]]
    return key[rec[hit]], tag[rec[hit]], pos[rec[hit]] + step[hit]


def _unpacked(table: pa.Table):
    """Sizes, places of tokens, tags, keys, positions and texts of a bucket's
    records.  A body is read where it lies and goes straight to its place."""
    bodies = [(n, b.as_buffer()) for n, b in zip(table["n"].to_pylist(), table["body"]) if b.is_valid]
    kinds = (np.uint8, np.uint8, np.uint16, np.int64, np.int64)
    fixed = sum(np.dtype(t).itemsize for t in kinds)
    rows = sum(n for n, _ in bodies)
    cols = [np.empty(rows, t) for t in kinds]
    buf = np.empty(sum(map(zstandard.frame_content_size, (b for _, b in bodies))) - rows * fixed, np.uint8)
    unpack = zstandard.ZstdDecompressor().decompress
    at = to = 0
    for n, body in bodies:
        raw, o = unpack(body), 0
        for col in cols:
            plane = np.frombuffer(raw, np.uint8, n * col.itemsize, o).reshape(col.itemsize, n)
            col[at:at + n] = np.ascontiguousarray(plane.T).view(col.dtype).ravel()
            o += n * col.itemsize
        buf[to:to + len(raw) - o] = np.frombuffer(raw, np.uint8, offset=o)
        at, to = at + n, to + len(raw) - o
    return *cols, buf


def _bucket(length: int):
    """One range of leading tokens: byte ranges that smaller documents also have."""

    def run(table: pa.Table) -> pa.Table:
        whole = table.filter(pc.is_null(table["body"]))
        out = [[whole[c].to_numpy()] for c in ("id", "tag", "start", "stop")]
        if whole.num_rows < table.num_rows:
            size, off, tag, key, pos, buf = _unpacked(table)
            size = size.astype(np.int64)
            starts = np.cumsum(size) - size
            token = _tokens(buf, starts + off)
            order = np.argsort(token, kind="stable")
            token = token[order]
            new = np.concatenate(([True], token[1:] != token[:-1]))
            group = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            k = key[order]
            shared = np.minimum.reduceat(k, at) != np.maximum.reduceat(k, at)
            live = shared[group]
            order, group = order[live], group[live]
            windows = np.cumsum(size[order] - length + 1)
            x = 0
            while x < len(order):
                limit = (windows[x - 1] if x else 0) + SEGMENT_WINDOWS
                y = max(int(np.searchsorted(windows, limit)), x + 1)
                while y < len(order) and group[y] == group[y - 1]:
                    y += 1
                r = order[x:y]
                n = size[r]
                index = np.arange(int(n.sum())) + np.repeat(starts[r] - (np.cumsum(n) - n), n)
                hit = _repeats(buf[index], n, off[r], key[r], tag[r], pos[r], length)
                x = y
                if hit is None or not len(hit[0]):
                    continue
                by = np.lexsort((hit[2], hit[1], hit[0]))
                a, t, p = (v[by].astype(np.int64) for v in hit)
                cut = np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + length)))
                head = np.flatnonzero(cut)
                tail = np.concatenate((head[1:], [len(a)])) - 1
                for o, v in zip(out, (a[head], t[head], p[head], p[tail] + length)):
                    o.append(v)
        done = [np.concatenate(o).astype(np.int64) for o in out]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("id", "tag", "start", "stop"), done)})

    return run


def _splitters(base: DataFrame, size: int, buckets: int, length: int, chunk_bytes: int, sample: int) -> np.ndarray:
    """Tokens that cut the sampled anchors into ``buckets`` equal ranges.  The
    sample is of whole documents by a hash, about ``sample`` anchors for any
    ``size`` of all texts."""
    share = max(1, int(size / (length - TOKEN + 1) * 2 / sample))

    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(2))
            for parts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, length, chunk_bytes):
                buf, starts, ends = _load(parts)
                token = _tokens(buf, _chunk_anchors(buf, starts, ends, length)[2]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(token, pa.binary())], ["token"])

    some = base.where(F.pmod(F.xxhash64("_id", "_tag"), F.lit(share)) == 0).mapInArrow(run, "token binary")
    found = np.array([bytes(r[0]) for r in some.orderBy(F.xxhash64("token")).limit(sample).collect()], f"S{TOKEN}")
    found.sort()
    if not len(found):
        return found
    return np.unique(found[(np.arange(1, buckets) * len(found)) // buckets])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(_key, _tag, removed): the repeated byte ranges of each text that has
    any, as a sorted array of (start, stop) that don't touch."""
    base = _keyed(docs, id_col, text_col).select(F.col("_key").alias("_id"), "_tag", "_body")
    size = base.agg(F.sum(F.octet_length("_body"))).first()[0] or 0
    buckets = buckets or max(2 * common.shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    splitters = _splitters(base, size, buckets, length, chunk_bytes, SAMPLE_ANCHORS)
    rows = base.mapInArrow(_records(splitters, buckets, length, chunk_bytes), SCHEMA)
    ranges = rows.groupBy("bucket").applyInArrow(_bucket(length), "id long, tag long, start long, stop long")
    whole = ranges.groupBy("id", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("all"))
    start = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("stop"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(acc, x):
        touches = x["start"] <= acc["open"]["stop"]
        return F.when(touches, F.struct(acc["done"].alias("done"), F.struct(
            acc["open"]["start"].alias("start"), F.greatest(acc["open"]["stop"], x["stop"]).alias("stop")).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), x.alias("open")))

    joined = F.aggregate("all", F.struct(empty.alias("done"), start.alias("open")), step,
                         lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda r: r["start"] >= 0))
    whole = whole.select(F.col("id").alias("_key"), F.col("tag").cast("int").alias("_tag"), joined.alias("removed"))
    with common.shuffles_removed(docs.sparkSession):        # the records go before the texts travel
        return common.materialise(whole, "ranges")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    body = F.encode(common.text_of(text_col), "UTF-8")
    return docs.select(*more, F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NULL_ID))).alias("_key"),
                       F.pmod(F.xxhash64(common.text_of(text_col)), F.lit(65536)).cast("int").alias("_tag"),
                       body.alias("_body"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 buckets: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All rows with n_bytes, removed (array of byte ranges) and kept_bytes
    (binary: what is left, in order).

    Defined cases: null and empty texts, and those shorter than ``length``,
    lose nothing; rows of one id are not smaller than each other, so repeated
    rows keep what their id keeps; null ids come after all others; an empty
    table gives an empty result; input columns named like a result column are
    replaced by it.  The id is an integer below 2**63 - 1.
    """
    ranges = repeated_ranges(docs, id_col, text_col, length, buckets, chunk_bytes)
    names = [c for c in docs.columns if c.lower() not in RESULT]
    # the text itself travels once, as bytes
    as_body = [text_col] if isinstance(docs.schema[text_col].dataType, T.StringType) else []
    rows = docs.select(F.struct(F.col(text_col).isNull().alias("_void"), *common.without(docs, *RESULT, *as_body)).alias("_row"),
                       F.col(id_col).alias("_iid"), F.col(text_col).alias("_itext"))
    rows = _keyed(rows, "_iid", "_itext", "_row")
    text = F.when(~F.col("_row")["_void"], F.col("_body").cast("string"))
    # texts outside the bitmap have no range and go straight through; the rest meet their ranges
    shared = docs.sparkSession.sparkContext.broadcast(common.bitmap(ranges, "_key", "_tag"))
    maybe = F.pandas_udf(lambda p: pd.Series(common.in_bitmap(shared.value, p.to_numpy())), "boolean")(
        common.bitmap_place("_key", "_tag"))
    rows = rows.where(maybe).join(ranges, ["_key", "_tag"], "left").unionByName(
        rows.where(~maybe).withColumn("removed", F.lit(None).cast(ranges.schema["removed"].dataType)))
    size = F.octet_length("_body")
    # what is left: the stretches between removed ranges
    from_ = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda r: r["stop"]))
    to = F.concat(F.transform("removed", lambda r: r["start"]), F.array(size.cast("long")))
    part = F.zip_with(from_, to, lambda a, b: F.hex(F.substring(F.col("_body"), (a + 1).cast("int"), (b - a).cast("int"))))
    kept = F.when(F.col("removed").isNull(), F.col("_body")).otherwise(F.unhex(F.array_join(part, "")))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return rows.select(*[(text if c in as_body else F.col("_row")[c]).alias(c) for c in names], size.cast("long").alias("n_bytes"),
                       F.coalesce("removed", none).alias("removed"), kept.alias("kept_bytes"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])
    return suffix_dedup(docs).select("doc_id", "n_bytes", lost.alias("n_removed"),
                                     F.size("removed").cast("long").alias("n_spans"),
                                     F.sha2("kept_bytes", 256).alias("kept_sha256"))
