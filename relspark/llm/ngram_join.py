"""N-gram Jaccard self-join over prefix trees, exact at the given threshold.

Documents with equal shingle sets are one class, named by a digest of the set. All shingles have one global
order: the number of classes that hold them, then their hash. A set that links with ``x`` at Jaccard ``t`` holds at
least ``t|x|`` of its shingles, so it must hold one of the *prefix*, the rarest ``|x| - t|x| + 1`` in that order.

*Who can link at all.* In a hashed share of the shingle space, shingles of a single class are counted for each
class, map-side first; they travel as packed binary, by hash bucket. A class with as many of them as its prefix is
long has no partner and needs nothing more. The rest, copies and texts made of common passages, get the whole order.

*Where links can be.* Classes with a prefix shingle in common, of sizes that ``t`` allows, form candidate
components. Sets of sizes too far apart part a shingle's classes into bands.

*Join.* The ordered sets of a component meet, most frequent shingles first, as a prefix tree whose nodes are ranges of
the sorted sets. A set walks the tree from the root; overlap with a shared prefix is counted once for the whole
subtree, subtrees are pruned by remaining-length bounds or when all of their sets are linked with the set
already, and small subtrees are finished in one vectorised count. Links are verified ones only.

Memory is bounded by weight, not by the number of sets. A component over ``max_weight`` is cut into
blocks, each joined by itself with a few hub sets of the whole component; that unites almost all of a large group of near
copies. What is then outside of the component's largest part meets all blocks if it fits into one block, which is
linear; else only the classes with which it shares a prefix shingle. No pair with unlike parts is left out.

Shingles are 64-bit hashes and, in the order, the upper 52 bits of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import WordIds, cut, each_text, gram_hashes, id_and_text, id_bitmaps, in_bitmaps, mixed, packed, skew_join
from relspark.llm.graph import connected_components

#: Sets in a subtree below which the tree is not walked any further but counted at once.
LEAF = 48
#: About so many sets of a split component meet all of its blocks.
HUBS = 64
#: Links handed on at once.
BATCH = 100_000
#: Shingles that a task gathers before it packs them, and those that a bucket holds.
CHUNK, BUCKET = 500_000, 2_000_000
#: Bits of a shingle's hash in an ordered key; the number of classes, capped, stands above them.
HASH_BITS = 52
MAX_DF = 2047
#: What a set weighs besides its shingles.
SET_WEIGHT = 64


def shingles(text: bytes, n: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; all words as one if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = ids(words)
    if len(words) < n:
        return mixed(gram_hashes(hashed, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(hashed, n))


def set_digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def set_tag(s: np.ndarray) -> int:
    """The first 64 bits of the digest, never 0."""
    return int.from_bytes(set_digest(s)[:8], "little") or 1


def prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-size * num // den) + 1


def prefix_expr(size: str, num: int, den: int) -> Column:
    return F.expr(f"{size} - ({size} * {num} + {den - 1}) div {den} + 1")


def shingle_table(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, set_id, tag``; ``set_id`` is a 128-bit digest, null for empty sets."""
    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("tag", pa.int64())]

    def build(parts):
        ids = WordIds()
        for batch in parts:
            size, digest, tag = [], [], []
            for text in each_text(batch, "text"):
                s = shingles(text, n, ids)
                size.append(len(s))
                digest.append(set_digest(s))
                tag.append(np.uint64(set_tag(s)).astype(np.int64).item() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, (_, t) in zip((size, digest, tag), kinds[1:], strict=True))], schema=pa.schema(kinds))

    return id_and_text(docs, id_col, text_col).mapInArrow(build, "doc_id long, n_shingles long, set_id binary, tag long")


def pack_chunk(sets: dict[int, np.ndarray], buckets: int):
    """``bucket, tags, counts, hashes`` of the distinct shingles of some classes, as bytes.

    A shingle of two classes of the chunk goes once, under tag 0: it belongs to no class alone, however many have it.
    """
    sizes = [len(s) for s in sets.values()]
    hashes, tags = np.concatenate(list(sets.values())), np.repeat(np.fromiter(sets, np.uint64, len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, tags = hashes[order], tags[order]
    first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
    tags = np.where(np.diff(np.append(first, len(hashes))) > 1, np.uint64(0), tags[first])
    hashes = hashes[first]
    bucket, rest = (hashes % np.uint64(buckets)).astype(np.int64), (hashes // np.uint64(buckets)).astype(np.uint32)
    order = np.lexsort((tags, bucket))
    bucket, rest, tags = bucket[order], rest[order], tags[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        runs = np.append(np.flatnonzero(np.diff(tags[lo:hi], prepend=tags[lo] ^ np.uint64(1))), hi - lo)
        yield int(bucket[lo]), tags[lo:hi][runs[:-1]].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), rest[lo:hi].tobytes()


def lone_shingles(hashes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and how many of the shingles no other class has."""
    order = np.argsort(hashes, kind="stable")
    hashes, tags = hashes[order], tags[order]
    first = np.flatnonzero(np.diff(hashes.astype(np.int64), prepend=-1))
    low, high = np.minimum.reduceat(tags, first), np.maximum.reduceat(tags, first)
    return np.unique(low[(low == high) & (low != 0)], return_counts=True)


def lone_counts(docs: DataFrame, n: int, share: float, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``tag, lone``: how many shingles of the hashed ``share`` of the space only the class has, where any."""
    limit = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))
    packed = pa.schema([("bucket", pa.int32()), ("tags", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])

    def pack(parts):
        ids, held, size = WordIds(), {}, 0

        def flush():
            rows = list(pack_chunk(held, buckets))
            for i in range(0, len(rows), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5_000], strict=True), packed.types, strict=True)], schema=packed)

        for batch in parts:
            for text in each_text(batch, "text"):
                s = shingles(text, n, ids)
                part = s[s < limit]
                if len(part) and (tag := set_tag(s)) not in held:
                    held[tag] = part
                    size += len(part)
                if size >= CHUNK:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    counts = pa.schema([("shard", pa.int32()), ("tags", pa.binary()), ("lone", pa.binary())])

    def count(parts):
        gathered: dict[int, list] = {}
        for batch in parts:
            for bucket, *packs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                gathered.setdefault(bucket, []).append(packs)
        while gathered:
            _, rows = gathered.popitem()
            runs, sizes, hashes = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate((np.uint64, np.uint32, np.uint32)))
            tags, lone = lone_shingles(hashes, np.repeat(runs, sizes))
            shard = (mixed(tags) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, tags, lone = shard[order], tags[order], lone[order].astype(np.uint32)
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            packs = [(int(shard[a]), tags[a:b].tobytes(), lone[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            for i in range(0, len(packs), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packs[i : i + 5_000], strict=True), counts.types, strict=True)], schema=counts)

    def add(parts):
        packs = [(tags, lone) for batch in parts for tags, lone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        tags, where = np.unique(np.frombuffer(b"".join(t for t, _ in packs), np.uint64), return_inverse=True)
        lone = np.bincount(where, np.frombuffer(b"".join(n for _, n in packs), np.uint32), len(tags)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tags.view(np.int64)), pa.array(lone)], names=["tag", "lone"])

    rows = id_and_text(docs, id_col, text_col).select("text").mapInArrow(pack, "bucket int, tags binary, counts binary, hashes binary")
    counted = rows.repartitionById(buckets, "bucket").mapInArrow(count, "shard int, tags binary, lone binary")
    return counted.repartitionById(buckets, "shard").mapInArrow(add, "tag long, lone long")


def token_rows(texts: DataFrame, n: int) -> DataFrame:
    """``doc_id, tag, n_shingles, token`` for every shingle, as the upper bits of its hash."""
    names = ["doc_id", "tag", "n_shingles", "token"]

    def rows(docs: list, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        take = pa.array(np.repeat(np.arange(len(sets)), sizes))
        tags = pa.array([np.uint64(set_tag(s)).astype(np.int64).item() if len(s) else 0 for s in sets], pa.int64())
        tokens = np.concatenate(sets) >> np.uint64(64 - HASH_BITS)
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in (pa.array(docs, pa.int64()), tags, pa.array(sizes, pa.int64()))), pa.array(tokens.view(np.int64))], names=names)

    def build(parts):
        ids, docs, sets, size = WordIds(), [], [], 0
        for batch in parts:
            for doc, text in zip(batch.column(0).to_pylist(), each_text(batch, "text"), strict=True):
                docs.append(doc)
                sets.append(shingles(text, n, ids))
                size += len(sets[-1])
                if size >= CHUNK:
                    yield from rows(docs, sets)
                    docs, sets, size = [], [], 0
        if sets:
            yield from rows(docs, sets)

    return texts.mapInArrow(build, "doc_id long, tag long, n_shingles long, token long")


def ordered_sets(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rep, size, weight, tokens, prefix``: the shared shingles of each class, rarest first, and the prefix of them.

    Sets whose prefix holds shingles of their own only are left out: nothing can link with them.
    """
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    key = F.shiftleft(F.least("df", F.lit(MAX_DF)), HASH_BITS).bitwiseOR(F.col("token"))
    shared = skew_join(rows, counts, "token").select("doc_id", "tag", "n_shingles", key.alias("key"))
    sets = shared.groupBy("doc_id", "tag", "n_shingles").agg(F.sort_array(F.collect_set("key")).alias("tokens"))
    reach = prefix_expr("n_shingles", num, den) - (F.col("n_shingles") - F.size("tokens"))
    kept = sets.withColumn("reach", reach.cast("int")).filter("reach > 0")
    return kept.select(
        F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), (F.size("tokens") + SET_WEIGHT).cast("long").alias("weight"), "tokens", F.slice("tokens", F.lit(1), F.col("reach")).alias("prefix")
    )


def prefix_rows(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``rep, token, band`` of the prefixes, and edges ``a, b`` that connect the classes of each band.

    A band holds classes of one shingle whose sizes follow each other closely enough to link; only the distinct
    sizes of a shingle are put in order, never its rows.
    """
    rows = sets.select("rep", "size", F.explode("prefix").alias("token"))
    sizes = rows.groupBy("token", "size").agg(F.min("rep").alias("head"))
    up = Window.partitionBy("token").orderBy("size")
    chained = sizes.select("token", "size", "head", F.lag("size").over(up).alias("before"), F.lag("head").over(up).alias("below"))
    gap = F.when(F.col("before") * den >= F.col("size") * num, 0).otherwise(1)
    chained = cut(chained.select("token", "size", "head", F.when(gap == 0, F.col("below")).alias("below"), F.sum(gap).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("band")))
    placed = skew_join(rows, chained, "token", "size")
    near = placed.filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    far = chained.filter("head <> below").select(F.col("head").alias("a"), F.col("below").alias("b"))
    return placed.select("rep", F.xxhash64("token", "band").alias("cell")), near.unionByName(far)


class PrefixTree:
    """Sets in the global order, most frequent first, sorted as sequences; a node is the range of sets that share a prefix."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        tokens, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        held = df > 1  # a shingle of one set here cannot overlap; it only counts in the size
        shared = int(held.sum())
        ranks = (shared - np.cumsum(held))[inverse]  # keys rise with frequency, so ranks fall
        ranks[~held[inverse]] = -1
        rows = [np.sort(r[r >= 0]) for r in np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.rows = [rows[i] for i in self.order]
        self.size = np.asarray(sizes, np.int64)[self.order]
        self.lengths = np.array([len(r) for r in self.rows])
        self.flat = np.concatenate(self.rows) if shared else np.empty(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.marks = np.zeros(shared + 1, bool)
        self.children: dict[tuple[int, int, int], tuple] = {}

    def node(self, lo: int, hi: int, depth: int) -> tuple:
        """``(depth, smallest size, longest rest, child ranges)`` below the common prefix of lo..hi."""
        key = (lo, hi, depth)
        if key not in self.children:
            first, last = self.rows[lo], self.rows[hi - 1]  # sorted: their common prefix is everyone's
            n = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:n] != last[depth:n])
            end = depth + (int(differ[0]) if len(differ) else n - depth)
            ranges = []
            if hi - lo > LEAF:
                heads = np.array([r[end] if len(r) > end else -1 for r in self.rows[lo:hi]])
                at = np.append(np.flatnonzero(np.diff(heads, prepend=heads[0] - 1)), hi - lo)
                ranges = [(lo + int(a), lo + int(b)) for a, b in zip(at, at[1:], strict=False)]
                if len(ranges) == 1:
                    ranges = []
                merged = []  # neighbouring small subtrees are finished together
                for a, b in ranges:
                    if merged and b - merged[-1][0] <= LEAF:
                        merged[-1] = (merged[-1][0], b)
                    else:
                        merged.append((a, b))
                ranges = merged
            self.children[key] = (end, int(self.size[lo:hi].min()), int(self.lengths[lo:hi].max()) - end, ranges)
        return self.children[key]

    def roots(self, labels: np.ndarray) -> np.ndarray:
        """The first place, in the tree's order, of each set's label."""
        _, first, inverse = np.unique(np.asarray(labels)[self.order], return_index=True, return_inverse=True)
        return first[inverse]

    def walk(self, num: int, den: int, root: np.ndarray):
        """Places ``x`` and of linked sets behind it, but for subtrees whose sets all have the root of ``x``."""
        n, total = len(self.rows), num + den
        for x in range(n):
            if (root[x + 1 :] == root[x]).all():
                continue
            row, size = self.rows[x], int(self.size[x])
            self.marks[row] = True
            stack = [(0, n, 0, 0)]
            while stack:
                lo, hi, depth, overlap = stack.pop()
                lo_new = max(lo, x + 1)
                if lo_new >= hi or (root[lo_new:hi] == root[x]).all():
                    continue
                end, smallest, rest, ranges = self.node(lo, hi, depth)
                overlap += int(self.marks[self.rows[lo][depth:end]].sum())
                left = len(row) - int(np.searchsorted(row, self.rows[lo][end - 1], "right")) if end else len(row)
                if total * (overlap + min(left, rest)) < num * (size + smallest):
                    continue
                if ranges:
                    stack.extend((a, b, end, overlap) for a, b in reversed(ranges))
                    continue
                base = self.offsets[lo_new]
                hits = np.append(0, np.cumsum(self.marks[self.flat[base : self.offsets[hi]]]))
                shared = hits[self.offsets[lo_new + 1 : hi + 1] - base] - hits[self.offsets[lo_new:hi] - base]
                yield x, np.flatnonzero(total * shared >= num * (size + self.size[lo_new:hi])) + lo_new
            self.marks[row] = False

    def pairs(self, num: int, den: int, labels: np.ndarray):
        """Arrays of positions of linked sets with unlike labels: every such pair once."""
        root, order = self.roots(labels), np.asarray(self.order)
        for x, linked in self.walk(num, den, root):
            linked = linked[root[linked] != root[x]]
            if len(linked):
                yield np.full(len(linked), order[x]), order[linked]

    def links(self, num: int, den: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A position that stands for each set's component, before and after, in the order the sets were given.

        Sets of equal ``labels`` are linked from the start.
        """
        n = len(self.rows)
        root = np.arange(n) if labels is None else self.roots(labels)
        before = root.copy()
        for x, linked in self.walk(num, den, root):
            for r in np.unique(root[linked]).tolist():
                if r != root[x]:
                    low, high = min(r, int(root[x])), max(r, int(root[x]))
                    root[root == high] = low
        out = np.empty((2, n), np.int64)
        out[:, self.order] = np.asarray(self.order)[np.stack([before, root])]
        return out[0], out[1]


def _join_groups(num: int, den: int, every: bool):
    """Join the sets of each ``cell`` in a stream sorted by cell: links (a, b) of document ids.

    ``every`` link between unlike labels is given, or else only enough of them to unite what is linked.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(docs: list[int], labels: list[int], sizes: list[int], sets: list[np.ndarray]):
        ids, tree = np.array(docs), PrefixTree(sets, sizes)
        if not every:
            before, roots = tree.links(num, den, np.array(labels))
            at = np.flatnonzero(roots != before)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[roots[at]])], schema=schema)
            return
        held, size = [], 0
        for pair in tree.pairs(num, den, np.array(labels)):
            held.append(np.sort(ids[np.stack(pair)], axis=0))
            size += held[-1].shape[1]
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, axis=1))), schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, axis=1))), schema=schema)

    def stream(parts):
        cell, rows = None, ([], [], [], [])
        for batch in parts:
            lists = batch.column(4)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            columns = (batch.column(i).to_pylist() for i in range(4))
            for key, *row, lo, hi in zip(*columns, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if key != cell:
                    if len(rows[0]) > 1:
                        yield from join(*rows)
                    cell, rows = key, ([], [], [], [])
                for column, value in zip(rows, (*row, values[lo:hi].copy()), strict=True):
                    column.append(value)
        if len(rows[0]) > 1:
            yield from join(*rows)

    return stream


def _join_cells(sets: DataFrame, cells: DataFrame, num: int, den: int, every: bool = False) -> DataFrame:
    """Links ``a, b`` between the sets of each cell."""
    gathered = sets.select("rep", "size", "tokens").join(cells, "rep").select("cell", "rep", "label", "size", "tokens")
    return gathered.repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_groups(num, den, every), "a long, b long")


def _block(name: str, count: Column) -> Column:
    return F.pmod(F.xxhash64(name), count).cast("int")


def _blocks(weight: str, max_weight: int) -> Column:
    return F.ceil(F.col(weight) / F.lit(max_weight)).cast("int")


def _leftover_cells(labelled: DataFrame, max_weight: int) -> DataFrame:
    """Cells ``rep, cell, label`` in which all but the largest part of a cell's rows meet all of them.

    Rows ``rep, weight, cell, label``; rows of equal label are linked already.
    """
    parts = labelled.groupBy("cell", "label").agg(F.sum("weight").alias("w"))
    totals = parts.groupBy("cell").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"))
    totals = totals.withColumn("rest", F.col("all") - F.col("top.w")).filter("rest > 0")
    rows = totals.select("cell", F.col("top.label").alias("largest"), _blocks("all", max_weight).alias("blocks"), _blocks("rest", max_weight).alias("left_blocks"))
    marked = skew_join(labelled, rows, "cell").withColumn("block", _block("rep", F.col("blocks")))
    meet = marked.withColumn("left_block", F.explode(F.expr("sequence(0, left_blocks - 1)")))
    bring = marked.filter("label <> largest").withColumn("left_block", _block("rep", F.col("left_blocks"))).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    named = [d.select("rep", F.xxhash64("cell", "block", "left_block", F.lit("left")).alias("cell"), "label") for d in (meet, bring)]
    return named[0].unionByName(named[1]).distinct()


class _Candidates:
    """The table of all rows, the classes, the ordered sets, and the candidate component of each."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, max_weight: int, spread: float, id_col: str, text_col: str):
        spark = docs.sparkSession
        self.num, self.den, self.max_weight = num, den, max_weight
        self.table = cut(shingle_table(docs, n, id_col, text_col))
        self.classes = cut(self.table.filter("set_id is not null and doc_id is not null").groupBy("set_id", "tag", "n_shingles").agg(F.min("doc_id").alias("rep")))
        share = min(1.0, spread * (den - num) / den)
        held = self.table.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(held * share) // BUCKET))
        lone = lone_counts(docs, n, share, buckets, id_col, text_col)
        few = F.coalesce("lone", F.lit(0)) < prefix_expr("n_shingles", num, den)
        left = cut(skew_join(self.classes, lone, "tag", how="left").filter(few).select("rep").distinct())
        bits = id_bitmaps(left.select(F.col("rep").alias("id")))
        texts = in_bitmaps(id_and_text(docs, id_col, text_col), bits, "doc_id", True)
        texts = cut(texts.join(left, texts["doc_id"] == left["rep"]).select("doc_id", "text"))
        self.sets = cut(ordered_sets(token_rows(texts, n), num, den))
        self.cells, edges = prefix_rows(self.sets, num, den)
        members = cut(connected_components(edges).select(F.col("node").alias("rep"), F.col("root").alias("cell")))
        weighed = cut(skew_join(self.sets.groupBy("rep").agg(F.sum("weight").alias("weight")), members, "rep"))
        sizes = weighed.groupBy("cell").agg(F.sum("weight").alias("whole"), F.count("*").alias("members"))
        placed = skew_join(weighed, sizes, "cell").withColumn("blocks", _blocks("whole", max_weight))
        self.placed = placed.withColumn("block", _block("rep", F.col("blocks")))

    def token_cells(self, rows: DataFrame) -> DataFrame:
        """``rows`` (a row for each class) once for each shingle and band of its prefix."""
        return skew_join(self.cells, rows, "rep")


def ngram_links(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, max_weight: int = 1 << 21, spread: float = 2.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every link between unlike texts, ``a, b`` with ``a < b``, once: the pairs that ``ngram_join`` unites.

    A text is named by the smallest id with its set; rows with the same set, which all link, are one text.
    Rows with a null id are named by others of their text or not at all. In a component over ``max_weight``
    only the classes that share a prefix shingle meet, by two blocks where these are too many.
    """
    found = _Candidates(docs, n, num, den, max_weight, spread, id_col, text_col)
    whole = found.placed.filter("blocks = 1").select("rep", F.xxhash64("cell").alias("cell"), F.col("rep").alias("label"))
    split = found.token_cells(found.placed.filter("blocks > 1").select("rep", "weight"))
    totals = split.groupBy("cell").agg(F.sum("weight").alias("whole")).withColumn("blocks", _blocks("whole", max_weight))
    parts = skew_join(split, totals, "cell").withColumn("block", _block("rep", F.col("blocks")))
    other = parts.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    label = F.when(F.col("block") == F.col("other"), F.col("rep")).otherwise(F.col("block")).cast("long")
    met = other.select("rep", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"), F.lit("met")).alias("cell"), label.alias("label"))
    return _join_cells(found.sets, whole.unionByName(met), num, den, every=True).filter("a <> b").distinct()


def ngram_join(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, max_weight: int = 1 << 21, spread: float = 2.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set holds the
    distinct ``n``-word shingles, or all words as one shingle if there are fewer. Rows link when
    ``den * |A and B| >= num * |A or B|``; ``component_id`` is the smallest id reachable by links, itself
    included. Null, empty and blank texts have the empty set and link with nothing. Ids are integers, or strings of
    such. Repeated rows are linked like copies under other ids; texts under one id whose sets that id
    represents are one node. A row with a null id belongs to the component of its text, if another row has
    that text. Very long texts are read whole; a set may be heavier than ``max_weight``, which is the number of shingles, and
    64 a set, that a task holds at once. An empty table gives no rows; other columns are not read.

    ``spread`` times ``1 - num / den`` is the share of the shingle space in which shingles of a single text are counted
    beforehand. It changes the work, never the result.
    """
    found = _Candidates(docs, n, num, den, max_weight, spread, id_col, text_col)
    placed = found.placed
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("rep", F.lit("hub")), F.ceil(F.col("members") / HUBS)) == 0)
    where = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = placed.select("rep", F.explode(where).alias("block"), "cell").select("rep", F.xxhash64("cell", "block").alias("cell"), F.col("rep").alias("label"))
    links = cut(_join_cells(found.sets, first, num, den))
    split = placed.filter("blocks > 1")
    if not split.isEmpty():
        roots = connected_components(links)
        labelled = cut(split.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "weight", "cell", F.coalesce("root", "rep").alias("label")))
        parts = labelled.groupBy("cell", "label").agg(F.sum("weight").alias("w"))
        rest = parts.groupBy("cell").agg((F.sum("w") - F.max("w")).alias("rest"))
        marked = skew_join(labelled, rest, "cell")
        apart = found.token_cells(marked.filter(F.col("rest") > max_weight).select("rep", "weight", "label"))
        near = marked.filter(F.col("rest") <= max_weight).select("rep", "weight", "cell", "label")
        links = cut(links.unionByName(_join_cells(found.sets, _leftover_cells(near.unionByName(apart), max_weight), num, den)))
    roots = connected_components(links)
    rooted = found.classes.join(roots, F.col("rep") == F.col("node")).select("set_id", F.col("root").alias("component"), "rep")
    lone = found.classes.join(roots, F.col("rep") == F.col("node"), "left_anti").select("set_id", F.col("rep").alias("component"), "rep")
    named = rooted.unionByName(lone).select("set_id", "component")
    return skew_join(found.table, named, "set_id", how="left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of linked documents: the one of the smallest id.

    Of rows repeated with id and text the one whose other columns come first, as JSON, stays; different texts
    under the id that stays all do. Texts without words are linked with nothing: they stay, once for each id and text, and so does
    every row with a null id. The columns stay, whatever their names. An empty table stays empty.
    """
    found = cut(ngram_join(docs, id_col=id_col, text_col=text_col, **how).filter("doc_id is not null"))
    touched = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    touched = cut(touched.filter("n > 1 or not stays").select(F.col("doc_id").alias("id"), "stays"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), packed(docs).alias("row"))
    bits = id_bitmaps(touched)
    free = in_bitmaps(own, bits, "id", False).select("row")
    near = in_bitmaps(own, bits, "id", True).join(touched, "id", "left").filter("coalesce(stays, true)")
    once = near.groupBy("id", F.col(f"row.`{text_col}`").alias("text")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return free.unionByName(once.select("row")).select("row.*")
