"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a labelled document of label 1 over one of label 0. The chance that the first
wins is the logistic function of the difference of their linear scores, so training is logistic
loss on feature differences. The cut is a quantile of the training scores, the share of label 0, and
the score returned is the logistic function of the distance from it, scaled so that the cut is at
``cut_score``. The model is fitted on the driver from a bounded sample of labelled rows; scoring
reads every whole text on the executors with the few hundred weights in the task's closure.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import as_bytes, each_text, id_and_text, slices

BUCKETS = 64
DENSE = 16
WIDTH = 256 + BUCKETS + DENSE
FOLDS = 5


def features(text: bytes) -> np.ndarray:
    """Byte histogram, hashed word-shape histogram and a few rates, each between 0 and about 1."""
    out = np.zeros(WIDTH, np.float32)
    n = len(text)
    if not n:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[:256] = np.sqrt(hist / n)
    words = text.split()
    lines = text.split(b"\n")
    w = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    tails: dict[bytes, int] = {}
    for x, c in counts.items():
        t = x[-2:]
        tails[t] = tails.get(t, 0) + c
    for t, c in tails.items():
        out[256 + xxhash.xxh32_intdigest(t) % BUCKETS] += c
    out[256 : 256 + BUCKETS] = np.sqrt(out[256 : 256 + BUCKETS] / w)
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    high = hist[128:].sum()
    space = hist[32] + hist[9:14].sum()
    other = n - upper - lower - digits - high - space
    long_lines = [x for x in lines if len(x) > 20]
    dense = [
        upper / n, lower / n, digits / n, high / n, space / n, other / n,
        len(counts) / w, max(counts.values(), default=0) / w,
        1 - len(set(long_lines)) / max(len(long_lines), 1),
        min(n / w, 40) / 40, np.log1p(n) / 16, np.log1p(w) / 14, len(lines) / w,
        (hist[46] + hist[44]) / w, sum(c for x, c in counts.items() if len(x) == 1) / w, 1.0,
    ]
    out[256 + BUCKETS :] = dense
    return out


@dataclass
class Ranker:
    """Weights over standardised features, the cut and the spread of the training scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float
    cut_score: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        odds = (raw - self.cut) / self.spread + np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int, cut_score: float, seed: int = 7, steps: int = 300, l2: float = 1e-3) -> Ranker:
    """Learn by full-batch gradient steps (Adam) on ``pairs`` drawn preference pairs."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    z = np.clip((x - mean) / scale, -8, 8).astype(np.float64)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1] if len(x) else WIDTH)
    if not len(good) or not len(bad):  # nothing to prefer: every document scores alike, as its label
        return Ranker(mean, scale, weights, -5.0 if len(good) else 5.0 if len(bad) else -5.0, 1.0, cut_score)
    draw = np.random.default_rng(seed)
    first, second = draw.choice(good, pairs), draw.choice(bad, pairs)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        at = draw.integers(0, pairs, min(pairs, 4096))
        diff = z[first[at]] - z[second[at]]
        lose = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
        grad = -(lose[:, None] * diff).mean(0) + l2 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z @ weights
    order = np.sort(raw)
    k = len(bad)
    cut = (order[k - 1] + order[k]) / 2 if k < len(order) else order[-1]
    return Ranker(mean, scale, weights, float(cut), float(max(raw.std(), 1e-6)), cut_score)


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20_000,
    pairs: int = 100_000,
    cut_score: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Ranker:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold, picked by hash.

    Rows with a null id, label or no document are skipped; a repeated id may be sampled once each.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    sample = known.filter("doc_id is not null and label is not null").filter(fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    table = F.broadcast(sample.withColumnRenamed("doc_id", "known_id"))  # at most max_rows rows of 12 bytes
    rows = id_and_text(docs, id_col, text_col).join(table, F.col("doc_id") == F.col("known_id")).select("doc_id", "text", "label")
    out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary())])

    def extract(parts):
        for batch in parts:
            x = [features(t).tobytes() for t in each_text(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], schema=out)

    got = rows.mapInArrow(extract, "doc_id long, label int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(max_rows).toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return fit(x, got["label"].to_numpy(), pairs, cut_score)


def score_quality(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text enters the score. Null text counts as empty; empty texts are scored like any other.
    ``held_out`` is crc32 of the id as text modulo 5 equal to 0, false for a null id. Repeated rows
    score alike; an empty table gives no rows; other columns are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(parts):
        for batch in parts:
            for part in slices(batch):
                scores = model.score(np.stack([features(t) for t in as_bytes(part, "text")]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], schema=out)

    scored = id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= model.cut_score).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores below the cut; a score equal to it stays.

    Null text counts as empty, and empty texts are scored like any other; very long texts are read whole. Repeated rows go or
    stay together, ids are not read. The columns stay, whatever their names; an empty table stays empty.
    """
    names = docs.columns

    def keep(parts):
        at = names.index(text_col)
        for batch in parts:
            for part in slices(batch):  # what goes back to the JVM is as small
                texts = part.column(at).fill_null("").cast(pa.binary()).to_pylist()
                good = model.score(np.stack([features(t) for t in texts])) >= model.cut_score
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
