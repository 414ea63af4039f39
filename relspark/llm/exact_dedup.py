"""Exact deduplication by a tree merge of sorted digest runs.

Every partition turns its documents into a run of ``(sha256, -length, doc_id, count)`` rows sorted
by digest. Runs are exchanged in rounds: in each, ``radix`` neighbouring origins send the rows of
one digest to the same place, where they are merged and only the best row and the count stay. After
``log_radix(partitions)`` rounds each digest is left once. Only digests travel, never texts, and a
digest that a third of all rows share shrinks by ``radix`` at every level, so no task ever sees more
than ``radix`` rows of it from any one level below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import SPACE_CLASS, cut, packed, skew_join, text_or_empty


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, n_points``: sha256 of the text without ASCII white space, and its length."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, f"{SPACE_CLASS}+", ""), 256).alias("digest"),
        F.length(text).cast("long").alias("n_points"),
    )


def merge_runs(rows: DataFrame, radix: int = 16, partitions: int | None = None) -> DataFrame:
    """One row per digest: ``digest, best (rank, doc_id), group_size``, merged level by level.

    ``min`` over a struct plans as a sort aggregate: each task sorts its run by digest, the
    exchange brings runs together and a merge pass keeps the smallest entry of each digest.
    """
    spark = rows.sparkSession
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.select(
        (F.spark_partition_id() % F.lit(width)).alias("origin"),
        "digest",
        F.struct((-F.col("n_points")).alias("rank"), F.col("doc_id")).alias("best"),
        F.lit(1).cast("long").alias("group_size"),
    )
    while True:
        width = -(-width // radix)
        runs = (
            runs.withColumn("origin", F.floor(F.col("origin") / radix).cast("int"))
            .groupBy(*(["origin"] if width > 1 else []), "digest")
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        if width <= 1:
            return runs


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 16, partitions: int | None = None
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; the row with most code points,
    then the smallest id, stays. Null text counts as empty, and empty or blank texts are equal to
    each other. A null id sorts before all others. Rows repeated with id and text are all counted,
    and all carry ``kept`` if their id is the one that stays. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    rows = cut(digest_rows(docs, id_col, text_col))
    best = merge_runs(rows, radix, partitions)
    winners = best.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size")
    return skew_join(rows.select("doc_id", "digest"), winners, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id does not stay.

    Null and empty texts are equal to each other, so one of their ids stays; a null id, which sorts first, stays like any other.
    Rows repeated with an id that stays all do; very long texts are compared whole. The columns stay, whatever their
    names; an empty table stays empty.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    own = docs.select(packed(docs).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    return own.join(kept, F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select("row.*")
