"""BPE encoding and decoding through a table of distinct words.

1. Texts are split at ASCII white space (``bytes.split`` parts at 09-0D and 20,
   no other byte), which no token of the vocabulary crosses.  A block (some MB
   of one scan task's texts) keeps its texts as ranks in the block's own list of
   distinct words, in a table dealt by block, which holds them once.
2. The words of all blocks meet by hash; each distinct word is encoded once
   by the tokenizers library, and its ids go back to every block that uses it.
3. Blocks join the ids back by position: ranks -> ids.  Only ids travel.
4. Decoding joins ids to pieces; the id-to-piece table is the vocabulary file,
   so its size is fixed.

Words travel as compressed lists (one row for a block and a hash
bucket), so a word shared by all documents is one entry a block and never a
hot key.
"""

from __future__ import annotations

import array
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 9 << 20
#: Words of the documents that one row of a block holds, or a document's.
ROW_WORDS = 200_000
#: Ids that are spelled at once.
SPELLED = 400_000


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class _Codes(dict):
    """Words numbered in the order they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, all first bytes before all second ones: small values leave runs of zeros."""
    return values.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, -1).T).view("<u4").ravel()


def _blocks(docs: DataFrame, id_col: str, buckets: int, block_bytes: int) -> DataFrame:
    """Rows of two kinds: some of a block's documents (bucket -1) with the words
    of each as ranks in the block's own list, the first with the bucket of each
    rank; or the words that a block has in a bucket, by rank."""
    kind = docs.schema["_id"].dataType.simpleString()
    schema = common.schema_of(f"block long, bucket int, n int, words binary, _ids array<{kind}>, "
                              "counts binary, ranks binary, deal binary")

    def run(batches):
        part, block = TaskContext.get().partitionId() << 33, 0
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                table, first, size, found = _Codes(), at, 0, []
                while at < len(texts) and (at == first or size < block_bytes):
                    text = texts[at].as_py()
                    words = text.split()
                    found.append(np.fromiter(map(table.__getitem__, words), "<u4", len(words)))
                    size += len(text)
                    at += 1
                counts = np.fromiter(map(len, found), "<u4", len(found))
                often = np.zeros(len(table), np.int64)
                for codes in found:
                    np.add.at(often, codes, 1)
                # the commonest words rank first, so most ranks are small; equals stand in byte order
                words = sorted(table)
                own = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                order = np.argsort(-often[own], kind="stable")
                rank = np.empty(len(words), "<u4")
                rank[own[order]] = np.arange(len(words))
                words = [words[i] for i in order.tolist()]
                del table
                deal = np.fromiter(map(zlib.crc32, words), "<u4", len(words)) % np.uint32(buckets)
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // ROW_WORDS)) + 1).tolist(), len(counts)]
                rows = [(part + block, -1, j - i, None, pack(_planes(counts[i:j])),
                         pack(_planes(rank[np.concatenate(found[i:j])])), None if i else pack(_planes(deal)))
                        for i, j in zip(cuts, cuts[1:])]
                del found
                lists = np.argsort(deal, kind="stable").tolist()
                sizes = np.bincount(deal, minlength=1)
                ends = np.cumsum(sizes).tolist()
                for bucket in np.flatnonzero(sizes).tolist():
                    some = [words[i] for i in lists[ends[bucket] - int(sizes[bucket]):ends[bucket]]]
                    rows.append((part + block, bucket, len(some), pack(b" ".join(some)), None, None, None))
                block += 1
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), [
                    pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()])]
                ids = batch.column(0).slice(first, at - first)
                span = pa.array([*cuts, *[len(ids)] * (len(rows) - len(cuts) + 1)], pa.int32())
                yield pa.RecordBatch.from_arrays([*cols[:4], pa.ListArray.from_arrays(span, ids), *cols[4:]],
                                                 [f.name for f in schema])
                del words, own, order, rank, deal, lists, rows, cols
                common.release_memory()

    return docs.mapInArrow(run, schema)


def _encode_words(tokenizer: str):
    """One hash bucket: each distinct word is encoded once, then every block
    gets the ids of its words, in the order of its list."""

    def run(table: pa.Table) -> pa.Table:
        library = _library(tokenizer)
        unpack = zstandard.ZstdDecompressor().decompress
        pack = zstandard.ZstdCompressor(level=3).compress
        bodies = table.column("words").to_pylist()
        distinct: dict[bytes, bytes] = {}
        for body in bodies:
            distinct.update(dict.fromkeys(unpack(body).split(b" ")))
        words = list(distinct)
        for i in range(0, len(words), 20_000):
            some = words[i:i + 20_000]
            found = library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            distinct.update(zip(some, (array.array("H", e.ids).tobytes() for e in found)))
        out = []
        for body in bodies:
            ids = list(map(distinct.__getitem__, unpack(body).split(b" ")))
            sizes = np.fromiter(map(len, ids), "<u4", len(ids)) // 2
            out.append(pack(_planes(sizes) + b"".join(ids)))
        del distinct, words, bodies, library
        common.release_memory()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": table.column("n"),
                         "ids": pa.array(out, pa.binary())})

    return run


def _join_back(names: list[str]):
    """One block: its documents' ranks, and its words' ids by bucket."""

    def run(docs: pa.Table, lists: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        keys = docs.column("_ids").combine_chunks().flatten()
        deal = _of_planes(unpack(docs.column("deal").drop_null()[0].as_py()))
        parts, lengths = [], []
        lists = lists.sort_by("bucket")
        for k, body in zip(lists.column("n").to_pylist(), lists.column("ids").to_pylist()):
            raw = unpack(body)
            lengths.append(_of_planes(raw[:4 * k]))
            parts.append(np.frombuffer(raw, "<u2", offset=4 * k))
        flat = np.concatenate(parts) if parts else np.zeros(0, "<u2")
        order = np.argsort(deal, kind="stable")
        sizes, starts = np.zeros(len(deal), np.int64), np.zeros(len(deal), np.int64)
        sizes[order] = np.concatenate(lengths) if lengths else 0
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        out = [pa.array([], pa.binary())]
        for counts, ranks in zip(docs.column("counts"), docs.column("ranks")):
            counts, ranks, at = _of_planes(unpack(counts.as_py())), _of_planes(unpack(ranks.as_py())), 0
            found = []
            for k in counts.tolist():
                own = ranks[at:at + k]
                at += k
                size = sizes[own]
                ends = np.cumsum(size)
                total = int(ends[-1]) if k else 0
                where = np.arange(total) + np.repeat(starts[own] - (ends - size), size)
                found.append(flat[where].astype("<u4").tobytes())
            out.append(pa.array(found, pa.binary()))
        common.release_memory()
        return pa.table({names[0]: keys, names[1]: pa.chunked_array(out)})

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           buckets: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The id column and ``ids`` (binary, little-endian unsigned 32-bit) of all rows.

    Ids equal those of the tokenizers library without special tokens, padding
    or truncation.  ``tokenizer`` is a file present on every worker, its
    vocabulary below 65,536 entries and its pre-tokenizer dropping white
    space.  Defined cases: null and empty texts have no ids; null ids and
    repeated rows give a row each; an empty table gives an empty result; other
    columns are left out.
    """
    spark = docs.sparkSession
    buckets = buckets or common.shuffle_partitions(spark)
    base = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).cast("binary").alias("_text"))
    blocks = common.materialise_by(_blocks(base, id_col, buckets, block_bytes), "block",
                                   common.shuffle_partitions(spark), "word_blocks")
    lists = blocks.where("bucket >= 0").select("bucket", "block", "n", "words").groupBy("bucket").applyInArrow(
        _encode_words(tokenizer), "block long, bucket int, n int, ids binary")
    kind = base.schema["_id"].dataType.simpleString()
    rows = blocks.where("bucket < 0").select("block", "_ids", "counts", "ranks", "deal")
    # the table is dealt by block, so of the two sides only the lists are shuffled
    out = rows.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(
        _join_back(["_id", "ids"]), f"_id {kind}, ids binary")
    return out.withColumnRenamed("_id", id_col)


def _parts(batch: pa.RecordBatch, ids_col: str):
    """The batch in slices of at most SPELLED ids each, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(ids_col)), 0).to_numpy(), dtype=np.int64) // 4
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SPELLED, "right")))
        yield batch.slice(first, last - first)
        first = last


def _joined(blobs: list[bytes | None], spell) -> pa.Array:
    """Of each list of ids the spelled ids, joined by one space; an id whose
    spelling is null is left out."""
    at = np.cumsum([0, *(len(b or b"") // 4 for b in blobs)])
    words = spell(np.frombuffer(b"".join(b or b"" for b in blobs), "<u4"))
    if words.null_count:
        at = np.concatenate(([0], np.cumsum(words.is_valid().to_numpy(zero_copy_only=False))))[at]
        words = words.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), " ")


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the ids joined to the vocabulary's pieces, in
    order, as the library's decode without a decoder does (pieces joined by
    one space).  An id outside the vocabulary adds nothing; null ids decode to
    the empty text."""
    schema = common.schema_of(", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "decoded") + ", decoded string")
    rows = rows.select(*common.without(rows, "decoded"))

    def run(batches):
        library = _library(tokenizer)
        pieces = {i: p for p, i in library.get_vocab(with_added_tokens=True).items()}
        table = pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.string())
        del library, pieces
        for batch in batches:
            for part in _parts(batch, ids_col):
                text = _joined(part.column(ids_col).to_pylist(),
                               lambda ids: table.take(pa.array(ids, mask=ids >= len(table))))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [f.name for f in schema])
            common.release_memory()

    return rows.mapInArrow(run, schema)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_tokens and the digests of the decimal ids and of the decoded text."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = common.schema_of(f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        for batch in batches:
            for part in _parts(batch, "ids"):
                blobs = part.column("ids").to_pylist()
                decimal = _joined(blobs, lambda ids: pa.array(ids).cast(pa.string())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array([len(b) // 4 for b in blobs], pa.int64()),
                     pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in decimal], pa.string()),
                     part.column("decoded_sha256")], [f.name for f in schema])
            common.release_memory()

    # decoded texts end here, so batches of the step after hold only the ids
    return rows.select(id_col, "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")).mapInArrow(run, schema)


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    path = common.tokenizer_path(TOKENIZER)
    return digests(decode(encode(docs, path), path))
