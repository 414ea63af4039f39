"""Line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is its text stripped of ASCII white space at both ends with A-Z lower-cased; keys of at
least ``min_points`` code points are counted, as 128-bit digests, once per document. The exact
reference-count table (``h1, h2, n_docs, keep_id``) is aggregated before the shuffle. From it each
shard of the digest space builds a page: a cuckoo filter over its frequent keys and, behind it, the
exact sorted keys with their counts' outcome. Lines meet the page of their shard in a streaming pass
over (shard, salt) cells: the filter turns most lines away, the exact table confirms the rest.
Salting by document spreads a line that a third of all documents hold; memory is one page and one
batch of lines, whatever the group's size.

``LineIndex`` keeps counts and filters on storage and takes insertions and deletions of documents.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import SPACE_BYTES, as_bytes, cut, id_and_text, mixed
from relspark.sources.storage import Storage

KEY_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
DROP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
SLOTS, KICKS = 4, 200
#: Stands for a null id, which is below all others.
NO_ID = -1 << 63


def line_digest(line: bytes, min_points: int) -> bytes | None:
    """The 128-bit digest of a line's key, or None if the key is too short to count."""
    key = line.strip(SPACE_BYTES).lower()
    if len(key) < min_points or len(key) < 4 * min_points and len(key.decode()) < min_points:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, buckets of four, deletions allowed."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.8 < max(len(keys), room, 1):
            buckets *= 2
        while True:
            out = cls(buckets)
            if all(out.insert(int(k)) for k in keys):
                return out
            buckets *= 2

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mixed(np.asarray(keys).astype(np.int64).view(np.uint64))
        prints = np.maximum((h >> np.uint64(48)).astype(np.uint16), 1)
        mask = np.uint64(self.buckets - 1)
        first = h & mask
        return prints, first, first ^ (mixed(prints.astype(np.uint64)) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, key: int) -> bool:
        prints, first, second = self._places(np.array([key]))
        mark, at = prints[0], int(first[0])
        mask = self.buckets - 1
        for n in range(KICKS):
            for place in (at, int(second[0])) if n == 0 else (at,):
                if len(free := np.flatnonzero(self.table[place] == 0)):
                    self.table[place, free[0]] = mark
                    return True
            slot = (n * 7 + int(mark)) % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(mixed(np.array([mark], np.uint64))[0]) & mask
        return False

    def delete(self, key: int) -> bool:
        prints, first, second = self._places(np.array([key]))
        for place in (int(first[0]), int(second[0])):
            if len(held := np.flatnonzero(self.table[place] == prints[0])):
                self.table[place, held[0]] = 0
                return True
        return False


class Page:
    """A shard's filter and its exact table of frequent keys, sorted by digest."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, keep: np.ndarray, filt: CuckooFilter | None = None):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.keep = h1[order], h2[order], keep[order]
        self.filter = filt or CuckooFilter.of(self.h2)
        runs = np.unique(self.h1, return_counts=True)[1]
        self.longest = int(runs.max()) if len(runs) else 0

    def to_bytes(self) -> bytes:
        head = struct.pack("<qq", len(self.h1), self.filter.buckets)
        return head + self.filter.table.tobytes() + b"".join(x.astype("<i8").tobytes() for x in (self.h1, self.h2, self.keep))

    @classmethod
    def from_bytes(cls, data: bytes) -> Page:
        n, buckets = struct.unpack_from("<qq", data)
        table = np.frombuffer(data, np.uint16, buckets * SLOTS, 16).reshape(buckets, SLOTS).copy()
        h1, h2, keep = np.frombuffer(data, "<i8", 3 * n, 16 + table.nbytes).reshape(3, n)
        return cls(h1, h2, keep, CuckooFilter(buckets, table))

    def to_drop(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the lines go: frequent keys, but not in the document that keeps them."""
        out = np.zeros(len(h1), bool)
        maybe = np.flatnonzero(self.filter.contains(h2))
        at = np.searchsorted(self.h1, h1[maybe])
        for step in range(self.longest):
            i = np.minimum(at + step, len(self.h1) - 1)
            hit = (self.h1[i] == h1[maybe]) & (self.h2[i] == h2[maybe])
            out[maybe] |= hit & (self.keep[i] != doc[maybe])
        return out


def line_keys(docs: DataFrame, min_points: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h1, h2``: the distinct digests of each row's countable lines."""

    def split(parts):
        for batch in parts:
            ids, n, digests = batch.column(0), [], []
            for text in as_bytes(batch, "text"):
                found = {d for line in text.split(b"\n") if (d := line_digest(line, min_points))}
                n.append(len(found))
                digests.extend(found)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([ids.take(take), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=KEY_SCHEMA)

    return id_and_text(docs, id_col, text_col).mapInArrow(split, "doc_id long, h1 long, h2 long")


def reference_counts(keys: DataFrame) -> DataFrame:
    """The exact table: ``h1, h2, n_docs, keep_id`` (the largest id that holds the key)."""
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id"))


def build_pages(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """``shard, page`` for every shard with a key of at least ``min_docs`` documents."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2, keep = (table[c].to_numpy() for c in ("h1", "h2", "keep_id"))
        return pa.table({"shard": table["shard"][:1], "page": pa.array([Page(h1, h2, keep).to_bytes()], pa.binary())})

    frequent = counts.filter(F.col("n_docs") >= min_docs).select(
        F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", F.coalesce("keep_id", F.lit(-1 << 63)).alias("keep_id")
    )
    return frequent.groupBy("shard").applyInArrow(build, "shard int, page binary")


def probe(keys: DataFrame, pages: DataFrame, shards: int, salts: int) -> DataFrame:
    """``doc_id, digest`` of the lines to drop, by streaming lines past the page of their cell."""

    def stream(parts):
        cell, page = None, None
        for batch in parts:
            shard, salt = (batch.column(i).to_numpy() for i in (0, 1))
            kind, doc = batch.column(2).to_numpy(), batch.column(5)
            cells = shard.astype(np.int64) * salts + salt
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            ids = doc.fill_null(-1 << 63).to_numpy()
            cuts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)).tolist() + [len(cells)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if cells[lo] != cell:
                    cell, page = cells[lo], None
                if kind[lo] == 0:
                    page = Page.from_bytes(batch.column(6)[lo].as_py())
                    lo += 1
                if page is None or lo == hi:
                    continue
                at = np.flatnonzero(page.to_drop(h1[lo:hi], h2[lo:hi], ids[lo:hi])) + lo
                both = np.stack([h1[at], h2[at]], 1).astype("<i8")
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array([x.tobytes() for x in both], pa.binary())], schema=DROP_SCHEMA)

    lines = keys.select(
        F.pmod("h1", F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "h1", "h2", "doc_id", F.lit(None).cast("binary").alias("page"),
    )
    zero = F.lit(0).cast("long")
    copies = pages.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"),
        zero.alias("h1"), zero.alias("h2"), zero.alias("doc_id"), "page",
    )
    cells = lines.unionByName(copies).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return cells.mapInArrow(stream, "doc_id long, digest binary")


def apply_drops(docs: DataFrame, drops: DataFrame, min_points: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` after the lines in ``drops`` are taken out of ``docs``."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def rewrite(parts):
        for batch in parts:
            texts, lines, dropped = [], [], []
            for text, gone in zip(as_bytes(batch, "text"), batch.column(2).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                lines.append(n)
                if gone:
                    gone = set(gone)
                    kept = [x for x in text.split(b"\n") if line_digest(x, min_points) not in gone]
                    text, n = b"\n".join(kept), n - len(kept)
                dropped.append(n if gone else 0)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], schema=out)

    by_doc = drops.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("digest").alias("gone"))
    joined = id_and_text(docs, id_col, text_col).join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(rewrite, "doc_id long, text string, n_lines long, n_dropped long")


def dedup_lines(
    docs: DataFrame,
    min_points: int = 40,
    min_docs: int = 5,
    shards: int | None = None,
    salts: int = 16,
    page_keys: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, text, n_lines, n_dropped``.

    Lines whose key has ``min_points`` code points and is held by ``min_docs`` rows are dropped
    everywhere but in the largest id holding them (all its occurrences stay there). Null or empty
    text is one empty line. Every row counts as a document, so a repeated row counts again; rows
    that share the keeping id all keep the line. A null id is below all others. An empty table gives
    no rows; columns other than id and text are not read.
    """
    keys = cut(line_keys(docs, min_points, id_col, text_col))
    counts = reference_counts(keys)
    if shards is None:  # so that a page stays small, however many frequent lines there are
        counts = cut(counts.filter(F.col("n_docs") >= min_docs))
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // page_keys))
    pages = build_pages(counts, min_docs, shards)
    return apply_drops(docs, probe(keys, pages, shards, salts), min_points, id_col, text_col)


class LineIndex:
    """Line deduplication that takes batches in and documents out again.

    Under ``path`` lie immutable folders and one manifest a version, which names the folders that make it up:

    - ledger runs ``h1, h2, doc_id, delta``: their sums say which documents hold a key, and how often;
    - count runs ``h1, h2, n_docs, keep_id, version``: the newest row of a key is its exact reference count;
    - pages, of which the newest of each shard holds.

    A change looks up the keys of its batch alone among the counts, writes their new counts as a run and turns the
    pages on which a key became or ceased to be frequent or found another keeper: such keys are inserted into or
    deleted from the shard's cuckoo filter and exact table. The ledger is read for deletions only: for the rows that
    go, and for the holders of keys whose keeper goes. A new run takes in the runs before it that are not much larger,
    so that there are logarithmically many and a row is written again that often. Shards are dealt anew once the pages
    hold more than ``page_keys`` keys each. The manifest is created last and exclusively: a failed change leaves no
    trace but folders that no manifest names, and of two writers of one version the second fails.

    Ids are integers; a null id is below all others. A row inserted twice counts twice and goes one at a time;
    documents or lines to delete that were never inserted are ignored. Empty batches make a version without a change.
    """

    SCHEMAS = {
        "ledger": "h1 long, h2 long, doc_id long, delta long",
        "counts": "h1 long, h2 long, n_docs long, keep_id long, version long",
        "pages": "shard int, page binary, version long",
    }
    MANY_PAGE_FOLDERS = 8

    def __init__(self, spark: SparkSession, path: str, min_points: int = 40, min_docs: int = 5, shards: int = 16, version: int = 0, page_keys: int = 20_000):
        """``version`` reopens an index at one of its versions, 0 starts a new one; only the newest takes changes."""
        self.spark, self.path, self.min_points, self.min_docs, self.page_keys = spark, path, min_points, min_docs, page_keys
        self.store = Storage(spark, path)
        self.state = json.loads(self.store.read(f"manifest/v{version}.json")) if version else {"version": 0, "shards": shards, "keys": 0, "ledger": [], "counts": [], "pages": []}

    @property
    def version(self) -> int:
        return self.state["version"]

    @property
    def shards(self) -> int:
        return self.state["shards"]

    def _read(self, kind: str, runs: list[dict] | None = None) -> DataFrame:
        folders = [f"{self.path}/{run['folder']}" for run in (self.state[kind] if runs is None else runs)]
        if not folders:
            return self.spark.createDataFrame([], self.SCHEMAS[kind])
        return self.spark.read.schema(self.SCHEMAS[kind]).parquet(*folders)

    def _write(self, kind: str, rows: DataFrame) -> dict:
        run = {"folder": f"{kind}/{uuid.uuid4().hex}"}
        rows.write.parquet(f"{self.path}/{run['folder']}")
        return run | {"rows": self._read(kind, [run]).count()}

    def _added(self, kind: str, rows: DataFrame) -> list[dict]:
        """The runs with a new one, merged with those before it that are at most twice its size."""
        runs = self.state[kind] + [self._write(kind, rows.sortWithinPartitions("h1", "h2"))]
        first, size = len(runs) - 1, runs[-1]["rows"]
        while first and runs[first - 1]["rows"] <= 2 * size:
            first -= 1
            size += runs[first]["rows"]
        if first < len(runs) - 1:
            net = _balance if kind == "ledger" else _newest
            runs[first:] = [self._write(kind, net(self._read(kind, runs[first:])).sortWithinPartitions("h1", "h2"))]
        return runs

    def _pages(self, folders: list[dict] | None = None) -> DataFrame:
        rows = self._read("pages", folders)
        newest = rows.groupBy("shard").agg(F.max("version").alias("version"))
        return rows.join(newest, ["shard", "version"], "left_semi")

    def counts(self) -> DataFrame:
        """The exact reference counts: ``h1, h2, n_docs, keep_id``."""
        return _newest(self._read("counts")).filter("n_docs > 0").drop("version")

    def _counts_of(self, keys: DataFrame) -> DataFrame:
        return _newest(self._read("counts").join(keys.select("h1", "h2"), ["h1", "h2"], "left_semi")).drop("version")

    def _batch(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        keys = line_keys(docs, self.min_points, id_col, text_col)
        return cut(keys.groupBy("h1", "h2", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).agg(F.count("*").alias("n")))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        batch = self._batch(docs, id_col, text_col)
        added = batch.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc_id").alias("doc_id"))
        held = F.coalesce("n_docs", F.lit(0))
        now = added.join(self._counts_of(added), ["h1", "h2"], "left").select(
            "h1", "h2", held.alias("n_before"), (held + F.col("n")).alias("n_docs"),
            F.when(held > 0, F.greatest("keep_id", "doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        )
        self._change(batch.withColumnRenamed("n", "delta"), now)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take out documents that were inserted before, given with the same texts."""
        key, row = ["h1", "h2"], ["h1", "h2", "doc_id"]
        batch = self._batch(docs, id_col, text_col)
        held = _balance(self._read("ledger").join(batch.select(row), row, "left_semi"))
        gone = cut(batch.join(held, row).select(*row, F.least("n", "delta").alias("n"), (F.col("n") >= F.col("delta")).alias("whole")))
        lost = gone.groupBy(key).agg(F.sum("n").alias("n"), F.max(F.when(F.col("whole"), F.col("doc_id"))).alias("doc_id"))
        now = cut(lost.join(self._counts_of(lost), key).select(
            *key, F.col("n_docs").alias("n_before"), (F.col("n_docs") - F.col("n")).alias("n_docs"), "keep_id",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("bereft"),
        ))
        bereft = now.filter("bereft and n_docs > 0").select(key)
        others = _balance(self._read("ledger").join(bereft, key, "left_semi")).join(gone.filter("whole").select(row), row, "left_anti")
        heirs = others.groupBy(key).agg(F.max("doc_id").alias("heir"))
        now = now.join(heirs, key, "left").select(*key, "n_before", "n_docs", F.coalesce("heir", "keep_id").alias("keep_id"))
        self._change(gone.select(*row, (-F.col("n")).alias("delta")), now)

    def _change(self, moved: DataFrame, now: DataFrame) -> None:
        """Commit a version with ``moved`` in the ledger and ``now`` as the counts of the keys in it."""
        now, version, shards = cut(now), self.version + 1, self.shards
        was, is_ = F.col("n_before") >= self.min_docs, F.col("n_docs") >= self.min_docs
        turns = now.filter(was | is_)
        n_turns, keys = turns.agg(F.count("*"), F.coalesce(F.sum(is_.cast("long") - was.cast("long")), F.lit(0))).first()
        keys += self.state["keys"]
        state = {"version": version, "keys": keys, "ledger": self._added("ledger", moved)}
        state["counts"] = self._added("counts", now.select("h1", "h2", "n_docs", "keep_id", F.lit(version).cast("long").alias("version")))
        folders, stamp = self.state["pages"], F.lit(version).cast("long").alias("version")
        if keys > shards * self.page_keys:
            shards = 2 * -(-keys // self.page_keys)
            fresh = build_pages(_newest(self._read("counts", state["counts"])), self.min_docs, shards)
            folders = [self._write("pages", fresh.select("shard", "page", stamp))]
        elif n_turns:
            changes = turns.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), "h1", "h2", "keep_id", is_.alias("frequent"))
            old = self._pages().select("shard", "page").join(changes.select("shard").distinct(), "shard", "left_semi")
            fresh = changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_turn_page, "shard int, page binary")
            folders = folders + [self._write("pages", fresh.select("shard", "page", stamp))]
            if len(folders) > self.MANY_PAGE_FOLDERS:
                folders = [self._write("pages", self._pages(folders))]
        state |= {"shards": shards, "pages": folders}
        if not self.store.create(f"manifest/v{version}.json", json.dumps(state)):
            raise RuntimeError(f"version {version} was committed by another writer")
        self.state = state

    def dedup(self, docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, text, n_lines, n_dropped`` of ``docs`` under the present counts."""
        keys = cut(line_keys(docs, self.min_points, id_col, text_col))
        drops = probe(keys, self._pages().select("shard", "page"), self.shards, salts)
        return apply_drops(docs, drops, self.min_points, id_col, text_col)

    def vacuum(self) -> None:
        """Delete the folders that the present version does not name, while nobody writes; older versions are lost."""
        named = {run["folder"] for kind in self.SCHEMAS for run in self.state[kind]}
        for kind in self.SCHEMAS:
            for name in self.store.names(kind):
                if f"{kind}/{name}" not in named:
                    self.store.delete(f"{kind}/{name}")


def _balance(ledger: DataFrame) -> DataFrame:
    """``h1, h2, doc_id, delta`` of the rows that are held, over several runs."""
    return ledger.groupBy("h1", "h2", "doc_id").agg(F.sum("delta").alias("delta")).filter("delta != 0")


def _newest(counts: DataFrame) -> DataFrame:
    """The newest row of each key."""
    last = F.max(F.struct("version", "n_docs", "keep_id")).alias("last")
    return counts.groupBy("h1", "h2").agg(last).select("h1", "h2", "last.n_docs", "last.keep_id", "last.version")


def _turn_page(changes: pa.Table, old: pa.Table) -> pa.Table:
    """The next page of a shard: keys put in and taken out, the filter changed in place."""
    out = pa.schema([("shard", pa.int32()), ("page", pa.binary())])
    held, filt = {}, None
    if old.num_rows:
        page = Page.from_bytes(old["page"][0].as_py())
        held = dict(zip(zip(page.h1.tolist(), page.h2.tolist(), strict=True), page.keep.tolist(), strict=True))
        filt = page.filter
    for h1, h2, keep, frequent in zip(*(changes[c].to_pylist() for c in ("h1", "h2", "keep_id", "frequent")), strict=True):
        if frequent:
            fits = not filt or (h1, h2) in held or filt.insert(h2)
            held[h1, h2] = keep
        else:
            known = held.pop((h1, h2), None) is not None
            fits = not filt or not known or filt.delete(h2)
        filt = filt if fits else None
    h1, h2 = np.array(list(held), np.int64).reshape(-1, 2).T
    page = Page(h1, h2, np.fromiter(held.values(), np.int64, len(held)), filt)
    return pa.Table.from_pydict({"shard": [changes["shard"][0].as_py()], "page": [page.to_bytes()]}, schema=out)
