"""Structured Streaming into a table, each micro-batch once."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from relspark.engine import Engine, run_again


def stream_into(engine: Engine, table: str, stream: DataFrame, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Append a stream's micro-batches to a table under all of its constraints.

    The number of the last batch is kept in the catalog and committed with the batch's rows, so a
    batch that is run again after a failure is recognised and left out.
    """

    @run_again
    def add(engine: Engine, rows: DataFrame, batch: int) -> None:
        with engine._change() as txn:
            seen = txn.state.setdefault("streams", {})
            if seen.get(name, -1) >= batch:
                return
            engine.tables.insert(txn, table, rows)
            seen[name] = batch

    writer = stream.writeStream.foreachBatch(partial(add, engine)).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(**trigger) if trigger else writer).start()
