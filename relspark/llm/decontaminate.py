"""Benchmark decontamination by winnowing.

Of every window of ``w`` consecutive ``k``-gram hashes the (rightmost) minimum is kept as a
fingerprint. A span of at least ``k + w - 1`` words shared by a document and an item contains a whole
window on both sides, so both keep the same fingerprint of it: no shared window of ``window`` words
can be missed with ``w = window - k + 1``. An item too short for a window is one of its own length, whose hash is its
fingerprint; documents have those of every such length there is, twelve at most.

Fingerprints of documents and items are joined. Only texts with hits, found again through a bitmap of fixed size, are
read on: each hit is extended to the windows around it, which are joined with the items' windows by 128-bit hashes.
The benchmark is never gathered: fingerprints are broadcast up to ``max_broadcast`` of them and joined by
shuffle beyond that, windows and items meet in joins that AQE splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import MIX, MIX2, WORD_TABLE, WordIds, cut, each_text, gram_hashes, id_and_text, id_bitmaps, in_bitmaps, mixed, packed, skew_join, text_or_empty

IS_WORD = np.array([c != 32 for c in WORD_TABLE])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost minimum of every ``w`` consecutive hashes (of all, if fewer)."""
    if len(grams) <= w:
        return np.array([len(grams) - 1 - int(grams[::-1].argmin())]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    at = np.arange(len(views)) + (w - 1) - views.argmin(1)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def window_hashes(ids: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``length`` words at ``starts``."""
    out = [ids[starts].copy(), mixed(ids[starts])]
    for j in range(1, length):
        for h, base in zip(out, (MIX, MIX2), strict=True):
            h *= base
            h += ids[starts + j]
    return mixed(out[0]), mixed(out[1] + np.uint64(length))


def marked(hashes: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of windows of ``length`` words, which differ from those of any other length."""
    return mixed(hashes + np.uint64(length)).view(np.int64)


class Prints:
    """Fingerprints of texts: winnowed for full windows, whole windows of the lengths of short items."""

    def __init__(self, window: int, k: int, short: list[int]):
        self.window, self.k, self.w, self.short = window, k, window - k + 1, short
        self.ids = WordIds()

    def words(self, text: bytes) -> np.ndarray:
        return self.ids(words_of(text))

    def of(self, ids: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Window length, places and fingerprints, for each length that the text reaches."""
        found = []
        for n in (*self.short, self.window):
            if len(ids) >= n:
                grams = gram_hashes(ids, self.k if n == self.window else n)
                at = winnow(grams, self.w) if n == self.window else np.arange(len(grams))
                found.append((n, at, marked(grams[at], n)))
        return found

    def around(self, ids: np.ndarray, hit: np.ndarray):
        """Length, starts and hashes of the windows that contain a fingerprint of ``hit``."""
        for n, at, prints in self.of(ids):
            at = at[np.isin(prints, hit)]
            if n == self.window:
                at = np.unique(at[:, None] - np.arange(self.w))
                at = at[(at >= 0) & (at <= len(ids) - n)]
            if len(at):
                yield n, at, *window_hashes(ids, at, n)


def union_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[new], np.append(ends[new[1:] - 1], ends[-1])


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """``item, n, h1, h2, print`` of every window; full windows have a fingerprint where winnowing kept one."""

    def build(parts):
        prints = Prints(window, k, [])
        for batch in parts:
            columns = [[np.empty(0, np.int64)] for _ in range(5)]
            for item, text in zip(batch.column(0).to_pylist(), each_text(batch, "text"), strict=True):
                ids = prints.words(text)
                n = min(window, len(ids))
                if n:
                    starts = np.arange(len(ids) - n + 1)
                    h1, h2 = window_hashes(ids, starts, n)
                    grams = gram_hashes(ids, k if n == window else n)
                    kept = marked(grams[winnow(grams, prints.w)] if n == window else grams, n)
                    rows = max(len(starts), len(kept))  # of a long item there are fewer fingerprints than windows
                    one = (np.full(rows, item, np.int64), np.full(rows, n, np.int64), h1.view(np.int64), h2.view(np.int64), np.resize(kept, rows))
                    for column, values in zip(columns, one, strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["item", "n", "h1", "h2", "print"])

    return items.mapInArrow(build, "item long, n long, h1 long, h2 long, print long")


def doc_prints(texts: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """``key, print``: the distinct fingerprints of each text."""

    def build(parts):
        prints = Prints(window, k, short)
        for batch in parts:
            found = [[p for _, _, p in prints.of(prints.words(text))] for text in each_text(batch, "text")]
            kept = [np.unique(np.concatenate(f)) if f else np.empty(0, np.int64) for f in found]
            take = pa.array(np.repeat(np.arange(len(kept)), [len(x) for x in kept]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64))], names=["key", "print"])

    return texts.mapInArrow(build, "key long, print long")


def word_counts(rows: DataFrame) -> DataFrame:
    """``doc_id, key, n_words`` of rows ``doc_id, doc_key, text``: the first bytes of words, counted a batch at a time."""

    def build(parts):
        for batch in parts:
            texts = batch.column(2).cast(pa.binary())
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
            held = IS_WORD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.empty(0, bool)
            ends = ends - ends[0]
            before = np.append(False, held)[: len(held)]
            before[ends[:-1][ends[:-1] < len(held)]] = False
            at = np.flatnonzero(held & ~before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(np.searchsorted(at, ends)))], names=["doc_id", "key", "n_words"])

    return rows.mapInArrow(build, "doc_id long, key long, n_words long")


def hit_windows(texts: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """``key, n, start, h1, h2``: the windows around the hits of texts ``key, text, prints``."""

    def build(parts):
        prints = Prints(window, k, short)
        for batch in parts:
            columns = [[np.empty(0, np.int64)] for _ in range(5)]
            for key, text, hit in zip(batch.column(0).to_pylist(), each_text(batch, "text"), batch.column(2).to_pylist(), strict=True):
                for n, at, h1, h2 in prints.around(prints.words(text), np.array(hit, np.int64)):
                    one = (np.full(len(at), key, np.int64), np.full(len(at), n, np.int64), at, h1.view(np.int64), h2.view(np.int64))
                    for column, values in zip(columns, one, strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "n", "start", "h1", "h2"])

    return texts.mapInArrow(build, "key long, n long, start long, h1 long, h2 long")


def _unite(parts):
    """Unite the spans found in each text."""
    for batch in parts:
        starts, ends = [], []
        for places in batch.column(1).to_pylist():
            s, e = union_spans(*(np.array([p[c] for p in places], np.int64) for c in ("start", "end")))
            starts.append(s.astype(np.int32))
            ends.append(e.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["key", "starts", "ends"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    k: int = 6,
    share: int = 20,
    max_broadcast: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per input row: ``doc_id, doc_key, n_words, n_hit, starts, ends, items, contaminated``.

    ``doc_key`` is the xxhash64 of the text. ``starts``/``ends`` are the united word spans (end exclusive) that windows of
    items cover, ``items`` the sorted ids of the items with occurring windows, ``contaminated`` is ``n_hit > 0 and share *
    n_hit >= n_words``. Ids of documents and items are integers, or strings of such. Null or wordless text has no words and is
    clean; items that are null, have a null id or no words are skipped; items that share an id count once. Equal texts,
    repeated rows among them, are judged once and reported as often as they occur. Very long texts are read whole. Empty tables
    give no rows or no hits. Other columns are not read.
    """
    text = F.col("text")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64(text).alias("doc_key"), "text")
    texts = rows.select(F.col("doc_key").alias("key"), "text")
    known = benchmark.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
    windows = cut(item_windows(id_and_text(known, item_col, text_col), window, k).distinct())
    short = sorted(r[0] for r in windows.filter(F.col("n") < window).select("n").distinct().collect())  # fewer than ``window``
    prints = cut(windows.select("print").distinct())
    few = prints.limit(max_broadcast + 1).count() <= max_broadcast
    own = doc_prints(texts, window, k, short)
    met = own.join(F.broadcast(prints), "print") if few else skew_join(own, prints, "print")
    hits = cut(met.groupBy("key").agg(F.collect_set("print").alias("prints")))
    near = in_bitmaps(texts, id_bitmaps(hits.select(F.col("key").alias("id"))), "key", True)
    once = near.groupBy("key").agg(F.any_value("text").alias("text")).join(hits, "key")  # equal texts once
    places = hit_windows(once.select("key", "text", "prints"), window, k, short)
    shapes = windows.select("n", "h1", "h2").distinct()
    found = cut(skew_join(places, shapes, "n", "h1", "h2"))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("places")).mapInArrow(_unite, "key long, starts array<int>, ends array<int>")
    named = skew_join(found.select("key", "n", "h1", "h2").distinct(), windows.select("n", "h1", "h2", "item").distinct(), "n", "h1", "h2")
    items = named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = spans.join(items, "key")
    counted = word_counts(rows)
    whole = skew_join(counted, judged, "key", how="left")
    none = F.array().cast("array<int>")
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    full = whole.select(
        "doc_id", F.col("key").alias("doc_key"), "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )
    return full.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose id and text are contaminated.

    Rows with null, empty or wordless text stay; rows repeated with id and text go or stay together; very long texts
    are judged whole. A null id is like any other. The columns stay, whatever their names; an empty table stays empty.
    """
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("doc_key").alias("id")).distinct()
    bad = cut(bad)
    bits = id_bitmaps(bad)
    own = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text_or_empty(text_col)).alias("own_key"))
    free, near = (in_bitmaps(own, bits, "own_key", hit) for hit in (False, True))
    kept = near.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("id")), "left_anti")
    return free.unionByName(kept).select("row.*")
