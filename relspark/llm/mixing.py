"""Mixing sources to target weights by Poisson replication.

Every source gets a rate: the mean number of times each of its documents is to appear so that the
source's share of all code points comes to its target weight. A document's count is drawn by inverting
the Poisson distribution at a uniform number hashed from seed, id and text, so it is the same on
every run and needs no coordination. Documents are exploded by their count and dealt to partitions,
and sorted within them, by another hash: a global shuffle. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import cut, packed, text_or_empty

#: A rate above this is drawn as the sum of independent parts, as exp(-rate) would underflow.
PART = 64.0


def hashed_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits, from md5 of the parts joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The smallest n with P(N <= n) > u for N ~ Poisson(rate <= PART).

    Terms are summed up to a bound where the tail is below the resolution of ``u``.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("below"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * rate / k
        return F.struct(term.alias("term"), (s["below"] + term).alias("below"), (s["n"] + F.when(s["below"] <= u, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """``name, rate``: per source ``epochs * weight * all code points / its code points``.

    Sources not named in ``weights`` get rate 0; without ``weights`` a source's weight goes with the
    square root of its size, so small sources are raised and large ones lowered.
    """
    sizes = docs.select(F.col(source_col).alias("name"), F.length(text_or_empty(text_col)).cast("double").alias("points")).groupBy("name").agg(F.sum("points").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("w", F.sqrt("size"))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "known string, w double")
        weighed = sizes.join(table, F.col("name").cast("string").eqNullSafe(F.col("known")), "left").select("name", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum("w").alias("all_w"))
    return weighed.join(F.broadcast(totals)).select(  # one row of totals beside one row a source
        "name",
        F.when((F.col("size") > 0) & (F.col("all_w") > 0), F.lit(float(epochs)) * F.col("w") / F.col("all_w") * F.col("all_size") / F.col("size")).otherwise(F.lit(float(epochs))).alias("rate"),
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_broadcast_sources: int = 10_000,
    copy_col: str | None = None,
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a globally shuffled order.

    The columns stay, whatever their names; ``copy_col``, if named, numbers a row's copies from 0. A null source is a
    source of its own (named None in ``weights``); null text counts as empty, and a source of empty
    texts only has rate ``epochs``. Ids are of any type. Rows repeated with id and text share their draw, and rows of equal place
    in the shuffle lie next to each other in no fixed order. Very long texts count in full. An empty table
    gives no rows. The table of rates has a row for each source; up to ``max_broadcast_sources`` it
    is broadcast, beyond that joined by shuffle, where AQE splits a hot source.
    """
    rates = cut(source_rates(docs, weights, epochs, source_col, text_col))
    few = rates.limit(max_broadcast_sources + 1).count() <= max_broadcast_sources
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty(text_col)))
    own = docs.select(packed(docs).alias("row"), F.col(source_col).alias("source"), key.alias("key"))
    joined = own.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("name")))
    keyed = joined.select("row", "key", "rate", F.greatest(F.ceil(F.col("rate") / PART).cast("int"), F.lit(1)).alias("parts"))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda total, i: total + poisson_inverse(hashed_uniform(F.lit(f"count-{seed}"), F.col("key"), i.cast("string")), F.col("rate") / F.col("parts")),
    )
    counted = keyed.withColumn("count", count).filter("count > 0")
    copies = counted.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    placed = copies.select("row", "copy", F.xxhash64(F.lit(seed), "key", "copy").alias("place"))
    shuffled = placed.repartition("place").sortWithinPartitions("place")
    return shuffled.select("row.*", *([F.col("copy").alias(copy_col)] if copy_col else []))
