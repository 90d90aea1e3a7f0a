"""Hierarchical multi-length packing.

A document of n tokens (its ids and one end id) is routed to the longest
context tier that it fills at least once, or to the shortest tier.  It is cut
into whole windows of that tier; its tail waits in the tier's pool.  Tiers are
then packed from long to short: each tail, longest first, opens a window whose
gap takes the longest waiting tails of shorter tiers that fit, then a cut
piece of one of them, and only when no shorter tail is left a tail of the same
tier.  What is left in the last window of a task is cut at powers of two, so
no sequence needs padding.  Sequences of one tier are dealt to step groups of
an equal number of tokens.

Packing runs inside each scan task on one Arrow batch after another, so no
text is shuffled and memory is one batch of texts; a task's first and last
windows are the only ones that more executors add.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .byte_bpe import CACHE_ENTRIES, shared

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 8 * 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = ("_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long, context long, step_group long")


class Packer:
    """Packs (key, start, length) runs of one task; ``out`` gets finished sequences."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, base: int):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.step = step_tokens
        self.base, self.sequences, self.groups = base, 0, 0
        self.fill: dict[int, tuple[int, int]] = {}
        self.pools: dict[int, list] = {t: [] for t in self.tiers}
        self.out: list[tuple] = []

    def close(self, runs: list[tuple]) -> None:
        """One finished sequence: its runs in order, in a step group of its length."""
        size = sum(r[2] for r in runs)
        group, used = self.fill.get(size, (None, 0))
        if group is None or used + size > self.step:
            group, used = self.base + self.groups, 0
            self.groups += 1
        self.fill[size] = (group, used + size)
        seq, at = self.base + self.sequences, 0
        self.sequences += 1
        for key, start, length in runs:
            self.out.append((key, start, length, seq, at, size, group))
            at += length

    def add(self, key, n: int) -> None:
        tier = next((t for t in self.tiers if t <= n), self.tiers[-1])
        whole = n - n % tier
        for start in range(0, whole, tier):
            self.close([(key, start, tier)])
        if n > whole:
            insort(self.pools[tier], (n - whole, whole, key))

    def _largest_fitting(self, tiers: tuple[int, ...], gap: int):
        for t in tiers:
            pool = self.pools[t]
            at = bisect_right(pool, (gap, float("inf"))) - 1
            if at >= 0:
                return pool.pop(at)
        return None

    def pack(self) -> list[tuple]:
        """Pack all waiting tails; returns the runs of the window left open."""
        for i, tier in enumerate(self.tiers):
            shorter, pool = self.tiers[i + 1:], self.pools[tier]
            while pool:
                length, start, key = pool.pop()
                runs, gap = [(key, start, length)], tier - length
                while gap:
                    if fit := self._largest_fitting(shorter, gap):
                        runs.append((fit[2], fit[1], fit[0]))
                        gap -= fit[0]
                        continue
                    source = next((self.pools[t] for t in shorter if self.pools[t]), pool)
                    if not source:
                        break
                    cut, start, key = source.pop(0)
                    take = min(cut, gap)
                    runs.append((key, start, take))
                    gap -= take
                    if cut > take:
                        insort(source, (cut - take, start + take, key))
                if gap:
                    return runs
                self.close(runs)
        return []

    def finish(self, runs: list[tuple]) -> None:
        """Cut the open window at powers of two."""
        left = sum(r[2] for r in runs)
        while left:
            size = want = 1 << (left.bit_length() - 1)
            part = []
            while want:
                key, start, length = runs.pop(0)
                take = min(length, want)
                part.append((key, start, take))
                if length > take:
                    runs.insert(0, (key, start + take, length - take))
                want -= take
            self.close(part)
            left -= size


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
         end_id: int = END_ID, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Pieces of all documents: the id, start and length in the document's ids,
    the ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset there, the sequence's context length and its step group.

    ``tokenizer`` is the path of a tokenizers file present on every worker.
    Defined cases: a null or empty text is the end id alone; a null id and
    repeated rows are packed like any other row, each row on its own; an empty
    table gives an empty result; other columns of ``docs`` are left out.
    """
    ids = docs.schema[id_col].dataType.simpleString()
    schema = common.schema_of(SCHEMA.format(id=ids))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        bpe = shared(tokenizer, cache_entries)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 33)
        names = [f.name for f in schema]
        types = None
        open_docs: dict[int, tuple] = {}
        runs: list[tuple] = []
        row = 0

        def emit():
            nonlocal types
            cols = [[] for _ in names]
            for key, start, length, seq, at, size, group in packer.out:
                doc, blob = open_docs[key]
                for col, v in zip(cols, (doc, start, length, blob[4 * start:4 * (start + length)],
                                         len(blob) // 4, seq, at, size, group)):
                    col.append(v)
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            types = types or [batch.schema.field(0).type, *map(pa.type_for_alias, ("int64", "int64", "binary", "int64", "int64", "int64", "int64", "int64"))]
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blob = bpe.encode(text) + end
                open_docs[row] = (doc, blob)
                packer.add(row, len(blob) // 4)
                row, size = row + 1, size + len(blob)
                if size > 32 << 20:
                    yield emit()
                    size = 0
            # the window left open waits for the next batch as runs of its own
            runs = packer.pack()
            yield emit()
            open_docs = {k: open_docs[k] for k, _, _ in runs}
            for key, start, length in runs:
                tier = min(t for t in packer.tiers if t > length)
                insort(packer.pools[tier], (length, start, key))
        if runs:
            packer.pools = {t: [] for t in packer.tiers}
            packer.finish(runs)
            yield emit()

    out = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text")
                      ).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return packed(docs)


def packed(docs: DataFrame, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """The pieces with the digest of their ids in place of the ids."""
    return pack(docs, common.tokenizer_path(TOKENIZER), cache_entries=cache_entries).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "context", "step_group")
