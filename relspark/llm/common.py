"""Helpers shared by the corpus operators: shared storage, byte-level tokenising, hashing.

Texts are handled as UTF-8 bytes: ``bytes.lower`` touches only A-Z, ``bytes.split()`` splits
on exactly ``[\\x20\\x09-\\x0D]`` and ``bytes.translate`` is a single C loop, so ASCII rules hold
whatever the language of the text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]`` as bytes and as a Java/RE2 character class.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder set in ``spark.checkpoint.dir``; one of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            shared = tempfile.mkdtemp(prefix="relspark-checkpoint-")
        sc.setCheckpointDir(shared)
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits that a set of ids is hashed to, in maps of 4 KB: 8 MB in all, however many ids there are.
ID_BITS, MAP_BITS = 1 << 26, 1 << 15


def _slot(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(ID_BITS))


def id_bitmaps(ids: DataFrame) -> DataFrame:
    """The column ``id`` as bits of a table of fixed size, to leave rows out of a join before they are shuffled."""
    slot = _slot("id")
    return cut(ids.groupBy(F.floor(slot / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg(slot % MAP_BITS).alias("bits")))


def in_bitmaps(rows: DataFrame, bitmaps: DataFrame, id_col: str, hit: bool) -> DataFrame:
    """Rows whose id may be in the set (``hit``) or certainly is not; a null id never is.

    The table of bits is broadcast: 8 MB at most. A set of more ids than bits lets nearly all rows through.
    """
    slot = _slot(id_col)
    placed = rows.withColumns({"__map": F.floor(slot / MAP_BITS).cast("int"), "__at": (slot % MAP_BITS).cast("int")})
    found = placed.join(F.broadcast(bitmaps.select(F.col("map").alias("__map"), F.col("bits").alias("__bits"))), "__map", "left")
    byte = "cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    held = F.col(id_col).isNotNull() & F.coalesce(F.expr(f"shiftright({byte}, __at % 8) % 2 = 1"), F.lit(False))
    return found.filter(held if hit else ~held).select(*rows.columns)


def skew_join(rows: DataFrame, lookup: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with one ``lookup`` row a key so that AQE can split a hot key.

    A lookup that was aggregated by its key lies dealt by it already and would be joined without an
    exchange of its own, and AQE splits only joins with one on both sides. A bit hashed from the key as a
    further join column has both sides dealt anew.
    """
    dealt = [d.withColumn("__bit", F.hash(*keys).bitwiseAND(1)) for d in (rows, lookup)]
    return dealt[0].join(dealt[1], [*keys, "__bit"], how).drop("__bit")


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so that others cannot clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def packed(docs: DataFrame) -> Column:
    """A whole row as one struct, so that an operator's own columns clash with none of it; ``row.*`` unpacks it."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores after it until no column has it."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, step: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows each, none of them empty; their columns share the batch's memory."""
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def each_text(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a batch one by one, of which only a few are copied at a time."""
    for part in slices(batch):
        yield from as_bytes(part, name)


class WordIds:
    """Word to 64-bit hash with a memo of bounded size."""

    def __init__(self, limit: int = 200_000):
        self.memo: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > self.limit:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and ranges of hashes behave like random ones."""
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every run of ``k`` ids, mixed."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = ids[:n].copy()
    for j in range(1, k):
        out *= MIX
        out += ids[j : j + n]
    return mixed(out)


def batches(rows: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict(rows, schema=schema)
