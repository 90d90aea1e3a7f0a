"""Near-duplicate documents by chosen-path set similarity join.

1. Each text becomes its set of word shingles (64-bit hashes), a digest of the
   whole set and a signature of minwise tokens.  Texts with the same set form
   one class; only classes go on, so copies cost nothing further.
2. Independent trees branch the classes: a node's members go to children by
   the minwise tokens that the node selects.  Nodes of one member end.
3. Small nodes are compared exhaustively on signatures.  The edges of a
   spanning forest are confirmed first, on full sets; where one of them fails,
   all pairs of the node that would still join two components.  In a large node every member is compared
   with the node's first member.  If all but few members are then in one
   component, those few are compared with all the members, in blocks, and the
   node ends; else it branches.  So a dense group of near copies neither needs
   a comparison a pair nor is copied from branch to branch, and no pair is left
   out by a cap.
4. Components come from alternating large-star and small-star steps.

Full sets are rebuilt from the text only for members of candidate pairs; the
scan picks them with a bitmap of fixed size and an exact join follows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

COORDINATES = 64
TREES = 4
#: Minwise tokens a node selects at the root, and below it.
ROOT_BRANCHES, BRANCHES, JOINT = 2, 3, 4
NODE_LIMIT = 4096
#: Smallest shingle hashes that a class keeps to estimate likeness with.
SKETCH = 192
#: Bytes of each that travel; equal values only make a pair look more alike.
LOW_BYTES = 3

#: A-Z lower-cased, in UTF-8; ``bytes.split`` parts at 09-0D and 20, no other byte.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct shingle hashes of a text; words are hashed once a task."""

    def __init__(self, words: int, cache: int = 400_000):
        self.k, self.cache, self.limit = words, _WordHashes(), cache
        self.factors = np.random.default_rng(words).integers(0, 1 << 63, max(words, 1), np.uint64) | np.uint64(1)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > self.limit:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self._hashes(words)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, len(h) if len(h) < self.k else 0, np.uint64)
        for i in range(k):
            out = (out ^ h[i:i + n]) * self.factors[i]
            out ^= out >> np.uint64(29)
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the COORDINATES hash functions."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i:i + 2048]
        np.minimum(best, ((part[:, None] ^ _XOR) * _MUL).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _packed(hashes: np.ndarray) -> bytes:
    """The highest LOW_BYTES bytes of each hash."""
    return hashes.astype("<u8").view("u1").reshape(-1, 8)[:, -LOW_BYTES:].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // LOW_BYTES, 4), "u1")
    out[:, :LOW_BYTES] = np.frombuffer(raw, "u1").reshape(-1, LOW_BYTES)
    return out.view("<u4").ravel()


def _profiles(base: DataFrame, words: int) -> DataFrame:
    kind = base.schema["_id"].dataType.simpleString()
    schema = common.schema_of(f"_id {kind}, _th long, n long, digest binary, sig array<int>, low binary")

    def run(batches):
        shingle = Shingler(words)
        for batch in batches:
            n, digest, sigs, low = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(signature(s).view(np.int32))
                low.append(_packed(s[:SKETCH]))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            at = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.ListArray.from_arrays(at, flat), pa.array(low, pa.binary())], [f.name for f in schema])

    return base.mapInArrow(run, schema)


def _sets(base: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(vid, shingles) of the wanted classes, rebuilt from their texts."""
    bits = common.bitmap(wanted, "_id", "_th")
    shared = base.sparkSession.sparkContext.broadcast(bits)
    kind = base.schema["_id"].dataType.simpleString()
    schema = common.schema_of(f"_id {kind}, _th long, shingles binary")

    def run(batches):
        shingle, own = Shingler(words), shared.value
        for batch in batches:
            batch = batch.filter(pa.array(common.in_bitmap(own, batch.column(3).to_numpy())))
            body = [shingle(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())],
                                             [f.name for f in schema])

    found = base.withColumn("_p", common.bitmap_place("_id", "_th")).mapInArrow(run, schema)
    want = wanted.select("vid", F.col("_id").alias("_wid"), F.col("_th").alias("_wth"))
    return (found.join(want, found["_id"].eqNullSafe(want["_wid"]) & (found["_th"] == want["_wth"]))
            .select("vid", "shingles").dropDuplicates(["vid"]))


def _confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are alike: 100 * both >= share * either."""
    a = sets.select(F.col("vid").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("vid").alias("b"), F.col("shingles").alias("sb"))
    num, den = share

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)],
                                             ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _min_joined(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, other, m): m the smallest of a key and its neighbours.  The group
    side's key is an expression, so the skew join may split a hub."""
    m = edges.groupBy(key).agg(F.min(other).alias("m0")).select(
        F.abs(key).alias("k"), F.least(key, "m0").alias("m"))
    return edges.join(m, edges[key] == m["k"]).select(key, other, "m")


#: Edges that one task joins on its own before the star steps (some 100 MB).
TASK_EDGES = 250_000


def _stars(batches):
    """Edges (vertex, least vertex of its tree) that span what a task's edges join."""
    up: dict[int, int] = {}

    def find(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = find(u), find(v)
            if u != v:
                up[max(u, v)] = min(u, v)
    rows = [(x, r) for x in list(up) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(vid, comp): comp the smallest vertex reachable over edges (a, b) with
    non-negative ids; vertices without an edge are left out.

    Tasks of at most about TASK_EDGES edges first join what they hold; what is
    left between tasks is settled by alternating large-star and small-star steps
    (none if one task held all edges)."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialise(edges, "edges")
    tasks = -(-edges.count() // TASK_EDGES)
    if tasks:
        edges = common.materialise(edges.coalesce(tasks).mapInArrow(_stars, "u long, v long"), "edges")
    mark = None
    while tasks > 1:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_joined(both, "u", "v").where("v > u and v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _min_joined(large, "u", "v")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.materialise(small, "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("vid"), F.col("v").alias("comp"))


def _floor(share: float, k: int) -> float:
    """What an estimate from ``k`` samples may fall to, four deviations down."""
    return share - 4 * (share * (1 - share) / k) ** 0.5


def _may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, share: float) -> bool:
    """Whether the smallest hashes of two sets of sizes n and m allow the
    share: exactly if both sets are whole, else by an estimate."""
    if n <= SKETCH and m <= SKETCH:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= share * (n + m - both) - 1e-6 * n - 1
    least = np.sort(np.concatenate((x, y)))
    twice = least[1:] == least[:-1]
    rank = np.cumsum(np.concatenate(([True], ~twice)))[1:]
    k = min(SKETCH, int(rank[-1]))
    return (twice & (rank <= k)).sum() >= k * _floor(share, k)


def _node_pairs(share: float, forest: bool):
    """(a, b, path): the pairs of each small node, of different components, whose
    signatures, sketches and sizes allow the share; with ``forest`` only a
    spanning forest of them, the likeliest pairs first.  Rows come sorted by
    node, so only the last node of a batch waits for the next one."""
    least = _floor(share, COORDINATES)

    def node(path, vid, comp, n, sig, low):
        at, to, alike = [], [], []
        for i in range(len(vid) - 1):
            m = n[i + 1:]
            ok = np.flatnonzero((comp[i + 1:] != comp[i]) & (np.minimum(m, n[i]) >= share * np.maximum(m, n[i]) - 1e-9))
            like = (sig[i + 1:][ok] == sig[i]).mean(axis=1)
            ok, like = ok[like >= least], like[like >= least]
            at.append(np.full(len(ok), i))
            to.append(ok + i + 1)
            alike.append(like)
        if not at:
            return
        order = np.argsort(-np.concatenate(alike), kind="stable")
        at, to = np.concatenate(at)[order].tolist(), np.concatenate(to)[order].tolist()
        root = list(range(len(vid)))
        if forest:                                   # members of one component are one tree from the start
            first: dict[int, int] = {}
            root = [first.setdefault(int(c), i) for i, c in enumerate(comp)]
        trees = len(set(root))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(at, to):
            x, y = (find(i), find(j)) if forest else (i, j)
            if x != y and _may_link(low[i], low[j], n[i], n[j], share):
                yield min(vid[i], vid[j]), max(vid[i], vid[j]), path
                if forest:
                    root[max(x, y)] = min(x, y)
                    trees -= 1
                    if trees == 1:
                        return

    def whole(table: pa.Table, to: int | None) -> list[tuple]:
        """The pairs of the nodes that end before row ``to``."""
        path, vid, comp, n = (table.column(c).to_numpy() for c in ("path", "vid", "comp", "n"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        low = [_unpacked(v) for v in table.column("low").to_pylist()]
        ends = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1), len(path)]
        return [pair for i, j in zip(ends, ends[1:]) if to is None or j <= to
                for pair in node(int(path[i]), vid[i:j], comp[i:j], n[i:j], sig[i:j], low[i:j])]

    def out(pairs: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pairs)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "path"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            path = table.column("path").to_numpy()
            cut = int(np.flatnonzero(path == path[-1])[0])
            yield out(whole(table, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield out(whole(rest, None))

    return run


def _likeness(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / COORDINATES


def _node_stats(rows: DataFrame, linked: bool) -> DataFrame:
    """Of each node: size, smallest member, least and greatest component, a
    digest of the members, and the component that most members are in."""
    if not linked:                       # each member is its own component
        return rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("size"), F.min("vid").alias("pivot"), F.min("comp").alias("c0"),
            F.max("comp").alias("c1"), F.bit_xor(F.xxhash64("vid")).alias("members"),
            F.lit(1).cast("long").alias("most"), F.min("comp").alias("major"))
    each = rows.groupBy("path", "comp").agg(
        F.count(F.lit(1)).alias("k"), F.min("vid").alias("v"), F.bit_xor(F.xxhash64("vid")).alias("x"))
    return each.groupBy("path").agg(
        F.sum("k").alias("size"), F.min("v").alias("pivot"), F.min("comp").alias("c0"), F.max("comp").alias("c1"),
        F.bit_xor("x").alias("members"), F.max("k").alias("most"), F.max_by("comp", "k").alias("major"))


def link_classes(classes: DataFrame, base: DataFrame, words: int, share: tuple[int, int],
                 node_limit: int = NODE_LIMIT, trees: int = TREES) -> DataFrame:
    """(vid, comp) of the classes (vid, _id, _th, n, sig, low) that have a link."""
    least = share[0] / share[1]
    floor = _floor(least, COORDINATES)
    spread = np.random.default_rng(5).permutation(COORDINATES)[: trees * ROOT_BRANCHES]
    rows = classes.select("vid", F.explode(F.array(*[
        F.xxhash64(F.lit(int(i)), F.col("sig")[int(i)]) for i in spread])).alias("path"))
    slim = classes.select("vid", "n", "sig")
    short = F.transform("sig", lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint"))
    comps = sets = known = None
    level, fresh = 0, True
    while True:
        level += 1
        if comps is None:
            rows = rows.withColumn("comp", F.col("vid"))
        else:
            rows = rows.join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
        stats = _node_stats(rows, comps is not None).where("size > 1 and c0 <> c1").withColumn(
            "ends", F.col("size") - F.col("most") <= node_limit)
        # the trees often meet in nodes of the same members: to end one of them is enough
        same = F.when(F.col("ends"), F.col("members")).otherwise(F.col("path"))
        stats = stats.groupBy("size", "pivot", "ends", same.alias("same")).agg(
            F.min("path").alias("node"), F.min("major").alias("major")).select(
            (F.col("node").bitwiseXOR(F.lit(0)) + F.lit(0)).alias("node"), "size", "pivot", "ends", "major")
        live = common.materialise(
            rows.join(stats, rows["path"] == stats["node"]).select(
                "path", "vid", "comp", "size", "pivot", "ends", F.col("comp").eqNullSafe(F.col("major")).alias("main")),
            f"nodes_{level}")
        if live.isEmpty():
            break
        blocks = F.ceil(F.col("size") / node_limit).cast("int")
        block = F.when(F.col("main"), F.array(F.pmod(F.xxhash64("vid"), blocks).cast("int"))).otherwise(
            F.sequence(F.lit(0), blocks - 1))
        small = (live.where("ends").select("vid", "comp", "path", F.explode(block).alias("block"))
                 .select("vid", "comp", F.xxhash64("path", "block").alias("path")))
        large = live.where("not ends")
        star = (large.where("vid <> pivot").select("vid", "pivot").distinct()
                .join(slim, "vid")
                .join(slim.select(F.col("vid").alias("pivot"), F.col("n").alias("pn"), F.col("sig").alias("psig")), "pivot")
                .where((F.least("n", "pn") >= least * F.greatest("n", "pn") - 1e-9) & (_likeness("sig", "psig") >= floor - 1e-9))
                .select(F.col("pivot").alias("a"), F.col("vid").alias("b"), F.lit(None).cast("long").alias("path")))
        failed = None
        # a spanning forest of each node first; where one of its pairs is no link, all pairs that could still join
        for forest in (True, False):
            rows = small
            if not forest:
                rows = small.join(failed, "path", "left_semi")
                if comps is not None:
                    rows = rows.drop("comp").join(comps, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
            # 16 bits of a signature's values do: equal ones only make a pair look more alike
            pairs = (rows.join(classes.select("vid", "n", short.alias("sig"), "low"), "vid")
                     .repartition("path").sortWithinPartitions("path").select("path", "vid", "comp", "n", "sig", "low")
                     .mapInArrow(_node_pairs(least, forest), "a long, b long, path long"))
            if forest and fresh:
                pairs = pairs.unionAll(star)
            if not forest:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = common.materialise(pairs, f"pairs_{level}")
            todo = pairs.select("a", "b").distinct()
            met = todo.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
            if known is not None:
                met = met.join(known, "vid", "left_anti")
            new = common.materialise(classes.select("vid", "_id", "_th").join(met, "vid"), f"met_{level}")
            if not new.isEmpty():
                more = common.materialise(_sets(base, words, new), f"sets_{level}")
                sets = more if sets is None else sets.unionAll(more)
                known = new.select("vid") if known is None else known.unionAll(new.select("vid"))
            if sets is None or pairs.isEmpty():
                break
            found = common.materialise(_confirm(todo, sets, share), f"links_{level}")
            tried = todo
            if not found.isEmpty():
                links = found if comps is None else found.unionAll(
                    comps.select(F.col("vid").alias("a"), F.col("comp").alias("b")))
                comps = components(links)
            if forest:
                failed = common.materialise(
                    pairs.where("path is not null").join(found, ["a", "b"], "left_anti").select("path").distinct(), f"failed_{level}")
                if failed.isEmpty():
                    break
        if large.isEmpty():
            break
        chosen = [F.xxhash64("path", F.lit(k), *[
            F.element_at("sig", F.pmod(F.xxhash64("path", F.lit(k), F.lit(j)), F.lit(COORDINATES)).cast("int") + 1)
            for j in range(JOINT)]) for k in range(BRANCHES)]
        # the first visit of a large node links most of its members; what that leaves decides if it must branch
        rows = large.select("path", "vid")
        if not fresh:
            rows = rows.join(slim, "vid").select("vid", F.explode(F.array(*chosen)).alias("path"))
        fresh = not fresh
    if comps is None:
        return classes.select("vid", F.col("vid").alias("comp")).limit(0)
    return comps


def near_dedup(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100),
               id_col: str = "doc_id", text_col: str = "text", node_limit: int = NODE_LIMIT,
               trees: int = TREES) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept) of every row; two rows
    are linked when share[1] * both >= share[0] * either on their sets of
    ``words``-word shingles.

    Defined cases: a text of fewer words is one shingle; a null or empty text,
    or one of white space, has none and is its own component; null ids sort
    last, so a component's id is null only if all its ids are; repeated rows
    (same id, same text) share one result; an empty table gives an empty
    result; other columns are left out.
    """
    base = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_text"))
    base = base.select("_id", F.xxhash64("_text").alias("_th"), "_text")
    with common.scratch_group(docs.sparkSession) as wide:
        profiles = common.materialise(_profiles(base, words), "profiles")
    first = profiles.where("n > 0").groupBy("digest").agg(
        F.min(F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_th").alias("th"))).alias("best"),
        F.min("n").alias("n"),
        F.first("sig").alias("sig"), F.first("low").alias("low"))
    classes = common.materialise(first.select(
        F.monotonically_increasing_id().alias("vid"), "digest", "best", F.col("best.id").alias("_id"),
        F.col("best.th").alias("_th"), "n", "sig", "low"), "classes")
    # signatures go on with the classes only
    profiles = common.materialise(profiles.select("_id", "_th", "n", "digest"), "digests")
    common.discard(docs.sparkSession, wide)
    comps = link_classes(classes, base, words, share, node_limit, trees)
    named = classes.select("vid", "digest", "best").join(comps, "vid", "left").withColumn(
        "comp", F.coalesce("comp", "vid"))
    best = named.groupBy("comp").agg(F.min("best").alias("top"))
    chosen = named.join(best.select(F.abs("comp").alias("c"), "top"), F.col("comp") == F.col("c")).select(
        F.col("digest").alias("d"), "top")
    out = profiles.select("_id", "_th", "n", "digest").join(
        chosen, (F.col("digest") == F.col("d")) & (F.col("n") > 0), "left")
    alone = F.col("d").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.col("_th").alias("text_hash"), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("_id")).otherwise(F.col("top.id")).alias("component_id"),
        (alone | (F.col("_id").eqNullSafe(F.col("top.id")) & (F.col("_th") == F.col("top.th")))).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return near_dedup(docs, words=3, share=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")
