"""Shards kept by size-tiered compaction under versioned manifests.

``append`` writes arrivals as small immutable shards; nothing that exists is touched. ``compact`` takes
the shards tier by tier (a tier holds shards whose sizes differ by less than ``fanout``) and, where a
tier has ``fanout`` of them, merges neighbours into shards of up to the target size. Each change writes
data first and then commits a manifest, the list of live shards, under the next version number by a
create that fails if the file exists: a reader sees one version whole. A writer that loses the race commits upon the
winner's version; only a compaction whose shards another one merged fails. A lost executor or a failed writer leaves only files
that no manifest names, which ``vacuum`` deletes when they are old. The create is exclusive on HDFS and local disks; on an
object store, whose renames are not, one writer at a time may commit. All access goes through Spark and Hadoop's file system, so the
store may be any that Spark reaches.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Collection
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm.common import ensure_checkpoint_dir, free_name
from relspark.sources.storage import Storage


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int


class Overtaken(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    """A folder of immutable Parquet files, the shards, and manifests ``manifest/v<number>.json``.

    Bytes are those of the texts in UTF-8, so plans do not hang on what a codec makes of them. The
    manifest has a line for each shard; a shard is near ``target_bytes``, so 100 TB are some hundred
    thousand lines.
    """

    def __init__(self, spark: SparkSession, path: str, small_bytes: int = 8_000_000, target_bytes: int = 128_000_000, fanout: int = 4, text_col: str = "text", codec: str = "zstd", max_broadcast: int = 100_000):
        self.spark, self.path, self.text_col = spark, path.rstrip("/"), text_col
        self.small_bytes, self.target_bytes, self.fanout, self.codec = small_bytes, target_bytes, fanout, codec
        self.max_broadcast = max_broadcast
        self._store = Storage(spark, self.path)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        names = self._store.names("manifest")
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The live shards of a version, the newest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return []
        return [Shard(**x) for x in json.loads(self._store.read(f"manifest/v{version}.json"))]

    def _commit(self, version: int, shards: list[Shard]) -> int:
        """Create the manifest of a version; fails if the version exists."""
        if not self._store.create(f"manifest/v{version}.json", json.dumps([asdict(s) for s in shards])):
            raise Overtaken(f"version {version} was committed by another writer")
        return version

    def _swap(self, gone: Collection[str], made: list[Shard]) -> int:
        """Commit ``made`` in place of the shards ``gone``, upon whatever version is the newest by then."""
        while True:
            version = self.version()
            live = self.manifest(version)
            if not set(gone) <= {s.path for s in live}:
                raise Overtaken("another writer merged the same shards")
            try:
                return self._commit(version + 1, [s for s in live if s.path not in gone] + made)
            except Overtaken:
                continue

    def tier(self, size: int) -> int:
        return int(math.log(max(size / self.small_bytes, 1), self.fanout) + 1e-9)

    def _write(self, rows: DataFrame) -> str:
        """Write rows as they are dealt, a file for each task that has some; gives the folder of the files."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", self.codec).option("maxRecordsPerFile", 0).parquet(folder)
        return folder

    def _measured(self, folder: str) -> list[Shard]:
        """The shards of a folder of arrivals, with their rows and bytes of text; files without rows are none."""
        back = self.spark.read.parquet(folder)
        name = back.metadataColumn("_metadata")["file_name"].alias("name")
        size = F.coalesce(F.octet_length(F.col(f"`{self.text_col}`")), F.lit(0)).cast("long").alias("size")
        sizes = back.select(name, size).groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        return [Shard(f"{folder}/{r['name']}", r["n"], r["b"], self.tier(r["b"])) for r in sizes.orderBy("name").toLocalIterator()]

    def append(self, rows: DataFrame) -> int:
        """Add rows as they lie, a small shard for each task that has some: no shuffle and no sort."""
        return self._swap((), self._measured(self._write(rows)))

    def plan(self, shards: list[Shard], final: bool = False) -> list[list[Shard]]:
        """Groups to merge: neighbours of a full tier, up to the target size (``final``: any tier)."""
        groups = []
        open_ones = [s for s in shards if s.bytes < self.target_bytes * 3 // 4]
        tiers = {None: open_ones} if final else {t: [s for s in open_ones if s.tier == t] for t in sorted({s.tier for s in open_ones})}
        for members in tiers.values():
            if len(members) < (2 if final else self.fanout):
                continue
            group, size = [], 0
            for s in members:
                if group and size + s.bytes > self.target_bytes:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, final: bool = False) -> int:
        """Merge until no tier is full (``final``: until only full-sized shards and one rest remain).

        One job merges all groups of a round: each row finds its group by the file it comes from, and each group, at
        most the target size, is dealt to a task of its own, which writes the rows as they come, unsorted, as one file.
        """
        while True:
            version = self.version()
            live = self.manifest(version)
            groups = self.plan(live, final)
            if not groups:
                return version
            gone = {s.path: i for i, g in enumerate(groups) for s in g}
            rows = self.spark.read.parquet(*gone)
            shard = free_name("__shard", rows.columns)
            folder = self._write(self._tagged(rows, gone, shard).repartitionById(len(groups), shard).drop(shard))
            files = self._files(folder)
            made = []
            for i, g in enumerate(groups):  # a merged shard has what its parts had: no text is read again
                size = sum(s.bytes for s in g)
                made.append(Shard(f"{folder}/{files[i]}", sum(s.rows for s in g), size, self.tier(size)))
            self._swap(gone, made)

    def _files(self, folder: str) -> dict[int, str]:
        """The file of each task that wrote into a folder, by the task's number."""
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))
        return {int(n.split("-")[1]): n for n in names if n.startswith("part-")}

    def _tagged(self, rows: DataFrame, numbers: dict[str, int], name: str) -> DataFrame:
        """``rows``, read from shards, with the number of each row's shard.

        Up to ``max_broadcast`` numbers are broadcast, more are joined by shuffle, where AQE splits large shards.
        """
        keys = [("/".join(path.rsplit("/", 2)[1:]), n) for path, n in numbers.items()]
        here, folder = free_name("__here", [*rows.columns, name]), free_name("__folder", [*rows.columns, name])
        table = self.spark.createDataFrame(keys, f"`{folder}` string, `{name}` int")
        found = rows.withColumn(here, F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], "([^/]+/[^/]+)$", 1))
        joined = found.join(F.broadcast(table) if len(keys) <= self.max_broadcast else table, F.col(here) == F.col(folder))
        return joined.select(*(F.col(f"`{c}`") for c in rows.columns), name)

    def vacuum(self, older_than: float = 7 * 86_400) -> int:
        """Delete data that the newest manifest does not name and that is older than so many seconds.

        The age must exceed the longest append or compaction, which names its files only at its end, and the longest
        read of an older version. Gives the number of folders deleted.
        """
        live = {s.path.rsplit("/", 1)[0] for s in self.manifest()}
        folder = self._path(f"{self.path}/data")
        if not self._fs.exists(folder):
            return 0
        before = (time.time() - older_than) * 1000
        gone = [s.getPath() for s in self._fs.listStatus(folder) if f"{self.path}/data/{s.getPath().getName()}" not in live and s.getModificationTime() <= before]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; ``shard_col`` adds the number of the row's shard in its manifest."""
        shards = self.manifest(version)
        if not shards:
            raise ValueError("no rows were ever appended")
        rows = self.spark.read.parquet(*[s.path for s in shards])
        return rows if shard_col is None else self._tagged(rows, {s.path: i for i, s in enumerate(shards)}, shard_col)


def compact_into_shards(
    docs: DataFrame, path: str | None = None, arrivals: int = 2, id_col: str = "doc_id", shard_col: str = "shard", **how
) -> DataFrame:
    """Append ``docs`` in ``arrivals`` batches, compact, and read the newest version.

    Gives the rows of ``docs``, all columns and repeated rows included, with ``shard_col``, the number of
    the row's shard in the manifest. Nulls are stored as they are; null text has no bytes. Ids are of any type, ties
    need no order, and a text longer than the target is a shard of its own. A column of ``docs`` named like ``shard_col`` is an error, other
    names are free. An empty table gives no rows. Without a ``path`` the store is a new one of this call, and what compaction
    replaced is deleted; in a caller's store nothing is.
    """
    spark = docs.sparkSession
    if shard_col in docs.columns:
        raise ValueError(f"docs has a column {shard_col}; name another")
    store = ShardStore(spark, path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", **how)
    batch = F.pmod(F.xxhash64(id_col), F.lit(arrivals))
    for i in range(arrivals):
        store.append(docs.filter(batch == i))
    store.compact()
    if path is None:
        store.vacuum(older_than=-60)
    if not store.manifest():
        return docs.limit(0).withColumn(shard_col, F.lit(0))
    return store.read(shard_col=shard_col).select(*docs.columns, shard_col)
