"""Substring deduplication by sliding sentence spans.

Texts are cut into sentences after words that end in a full stop, question or exclamation mark and at
line ends. A sentence that runs past ``max_words`` words is cut after each further word whose hash
says so, so these cuts move with the content and a passage is cut alike wherever it stands; a word of
punctuation alone cuts only after another such word. Every run of ``span`` consecutive sentences with
``min_words`` words or more is hashed to 128 bits over its words. With ``extend``, runs with fewer words grow until
they have enough, forward from each sentence and backward from each, and a text too short for that is one
run, so that every sentence is in a run.
Equal runs meet in one aggregation for the smallest id that holds them and a join back; sentences
covered by any run that is not its first are removed. Runs are counted once a document, aggregated
before the shuffle, and AQE splits the join of a hot run, so no run's places are ever gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import MIX, SPACE_BYTES, WORD_TABLE, as_bytes, id_and_text, mixed, skew_join

MORE = np.uint64(0x5851F42D4C957F2D)
IS_SPACE = np.array([c in SPACE_BYTES for c in range(256)])
#: What a byte adds to its word's hash: lower-cased word bytes themselves, others nothing.
WEIGHT = np.array([0 if c == 32 else c + 1 for c in WORD_TABLE], np.uint64)
LOWEST = -(1 << 63)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: np.uint64):
        self.bases = (int(base), pow(int(base), -1, 1 << 64))
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.multiply.accumulate(np.array([1] + [b] * (size - 1), np.uint64)) for b in self.bases)
        return self.up, self.down


class Splitter:
    """Sentences of a text and hashes of their runs."""

    def __init__(self, span: int, min_words: int, max_words: int, cut_every: int, extend: bool = False):
        self.span, self.min_words, self.max_words, self.cut_every, self.extend = span, min_words, max_words, cut_every, extend
        self.byte_powers, self.word_powers = Powers(MIX), [Powers(MIX), Powers(MORE)]

    def sentences(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte of each sentence, its end in words, and the hash of every word."""
        data = np.frombuffer(text, np.uint8)
        space = IS_SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
        up, down = self.byte_powers(len(data) + 1)
        sums = np.append(np.uint64(0), np.cumsum(WEIGHT[data] * up[: len(data)]))
        words = mixed((sums[ends] - sums[starts]) * down[starts])
        last = data[ends - 1]
        lines = np.append(0, np.cumsum(data == 10))
        following = np.append(starts[1:], len(data))
        stop = (last == 46) | (last == 33) | (last == 63) | (lines[following] > lines[ends])
        first = np.append(0, np.flatnonzero(stop[:-1]) + 1)
        place = np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))
        bare = words == 0  # punctuation alone
        cuts = (words % np.uint64(self.cut_every) == 0) & (~bare | np.append(False, bare[:-1]))
        stop |= (place >= self.max_words - 1) & cuts
        stop[-1] = True
        stops = np.flatnonzero(stop) + 1
        begins = starts[np.append(0, stops[:-1])]
        begins[0] = 0
        return begins, stops, words

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First sentence of each run and the one after its last, given the sentences' bounds in words."""
        n = len(stops)
        if not self.extend:
            low = np.flatnonzero(stops[self.span - 1 :] - starts[: max(n - self.span + 1, 0)] >= self.min_words)
            return low, low + self.span
        low, high = np.arange(n), np.arange(1, n + 1)
        until = np.maximum(low + self.span, np.searchsorted(stops, starts + self.min_words) + 1)
        since = np.minimum(high - self.span, np.searchsorted(starts, stops - self.min_words, "right") - 1)
        back = (since >= 0) & (until[np.maximum(since, 0)] != high)
        lows, highs = np.append(low[until <= n], since[back]), np.append(until[until <= n], high[back])
        return (lows, highs) if len(lows) or not n else (np.zeros(1, np.int64), np.full(1, n))

    def runs(self, stops: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First sentences of the runs, those after their last, and both hash halves."""
        starts = np.append(0, stops[:-1])[: len(stops)]
        low, high = self.spans(starts, stops)
        if not len(low):
            return (np.empty(0, np.int64),) * 4
        place = np.arange(len(words)) - np.repeat(starts, stops - starts)
        halves = []
        for powers, salt in zip(self.word_powers, (MIX, MORE), strict=True):
            up, down = powers(len(words))
            sums = np.add.reduceat(mixed(words ^ salt) * up[place], starts)
            whole = np.append(np.uint64(0), np.cumsum(mixed(sums + (stops - starts).astype(np.uint64)) * up[: len(stops)]))
            halves.append(mixed((whole[high] - whole[low]) * down[low] + (high - low).astype(np.uint64)).view(np.int64))
        return low, high, *halves


def run_table(rows: DataFrame, splitter: Splitter) -> DataFrame:
    """``h1, h2, doc_id``: every distinct run of each row."""

    def build(parts):
        for batch in parts:
            n, h1s, h2s = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in as_bytes(batch, "text"):
                _, stops, words = splitter.sentences(text)
                _, _, h1, h2 = splitter.runs(stops, words)
                first = np.unique(h1, return_index=True)[1]
                n.append(len(first))
                h1s.append(h1[first])
                h2s.append(h2[first])
            take = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h1s)), pa.array(np.concatenate(h2s)), batch.column(0).take(take)], names=["h1", "h2", "doc_id"])

    return rows.mapInArrow(build, "h1 long, h2 long, doc_id long")


def dedup_substrings(
    docs: DataFrame,
    span: int = 3,
    min_words: int = 8,
    max_words: int = 8,
    cut_every: int = 4,
    extend: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, text, n_sentences, n_removed``.

    Words are compared with A-Z lower-cased and without the ASCII punctuation that follows them. A
    run's first place is its first occurrence in the smallest id that holds it, a null id being below
    all others; rows that share that id all keep it once. Without ``extend``, runs with fewer than ``min_words``
    words and texts with fewer than ``span`` sentences are not compared. Null text counts as empty; empty and blank
    texts have no sentences and stay as they are. An empty table gives no rows; columns other than
    id and text are not read.
    """
    splitter = Splitter(span, min_words, max_words, cut_every, extend)
    rows = id_and_text(docs, id_col, text_col)
    runs = run_table(rows.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "text"), splitter)
    firsts = runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    later = skew_join(runs, firsts.filter("n > 1").select("h1", "h2", "first"), "h1", "h2").filter("doc_id <> first")
    gone = later.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("h1").alias("gone"))
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])

    def rewrite(parts):
        for batch in parts:
            texts, n, removed = [], [], []
            marks = batch.column(2)
            flat, at = marks.flatten().to_numpy(), np.append(0, np.cumsum(marks.value_lengths().fill_null(0).to_numpy()))
            for i, text in enumerate(as_bytes(batch, "text")):
                begins, stops, words = splitter.sentences(text)
                low, high, h1, _ = splitter.runs(stops, words)
                later_here = np.ones(len(h1), bool)
                later_here[np.unique(h1, return_index=True)[1]] = False
                if at[i + 1] > at[i]:
                    later_here |= np.isin(h1, flat[at[i] : at[i + 1]])
                depth = np.zeros(len(begins) + 1, np.int64)
                np.add.at(depth, low[later_here], 1)
                np.add.at(depth, high[later_here], -1)
                keep = np.cumsum(depth)[:-1] == 0
                if not keep.all():
                    bounds = np.append(begins, len(text)).tolist()
                    text = b"".join(text[bounds[j] : bounds[j + 1]] for j in np.flatnonzero(keep).tolist())
                texts.append(text)
                n.append(len(begins))
                removed.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], schema=out)

    joined = rows.join(gone, F.coalesce("doc_id", F.lit(LOWEST)) == F.col("id"), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(rewrite, "doc_id long, text string, n_sentences long, n_removed long")
