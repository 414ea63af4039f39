from concurrent.futures import ThreadPoolExecutor

import pytest

from relspark.llm.sharding import ShardStore, compact_into_shards


def test_round_trip_and_sizes(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    store = ShardStore(spark, f"file://{tmp_path}/store", small_bytes=20_000, target_bytes=200_000)
    for k in range(3):
        store.append(docs.filter(f"doc_id % 3 = {k}"))
    assert store.version() == 3
    before = store.manifest()
    assert store.compact() > 3
    after = store.manifest()
    assert len(after) < len(before)
    assert sum(s.rows for s in after) == docs.count()
    largest = max(r[0] for r in docs.selectExpr("octet_length(text)").collect())
    assert all(s.bytes <= max(200_000, largest + 200_000) for s in after)
    assert all(s.bytes > 0.5 * 200_000 for s in after[:1]) or len(after) == 1
    key = sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, store.read().select(*docs.columns).collect())) == key
    assert sorted(map(tuple, store.read(3).select(*docs.columns).collect())) == key  # an older version stays readable
    staged = store._write(docs.limit(3))  # of a writer that has not committed yet
    assert store.vacuum() == 0 and spark.read.parquet(staged).count() == 3
    assert store.vacuum(older_than=-60) > 1
    assert sorted(map(tuple, store.read().select(*docs.columns).collect())) == key
    numbered = store.read(shard_col="shard").groupBy("shard").count().collect()
    assert sorted((r[0], r[1]) for r in numbered) == [(i, s.rows) for i, s in enumerate(store.manifest())]


def test_a_version_is_committed_once(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/store")
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    store.append(df)
    with pytest.raises(RuntimeError, match="committed"):
        store._commit(1, [])
    assert [r[0] for r in store.read().collect()] == [1]


def test_writers_at_once_all_land(spark, tmp_path):
    stores = [ShardStore(spark, f"file://{tmp_path}/store") for _ in range(6)]
    rows = [spark.createDataFrame([(i, "a")], "doc_id long, text string").coalesce(1) for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: stores[i].append(rows[i]), range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert sorted(r[0] for r in stores[0].read().collect()) == [0, 1, 2, 3, 4, 5]
    merged = stores[1].manifest()[:2]
    stores[0]._swap({s.path for s in merged}, merged[:1])
    with pytest.raises(RuntimeError, match="merged the same"):
        stores[1]._swap({s.path for s in merged}, [])


def test_edges(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as __folder", "2 as __shard", "3 as __here", "4 as __shard_", "null as bytes", "5 as _metadata")
    df = df.withColumn("bytes", df["bytes"].cast("int"))
    out = compact_into_shards(df)
    assert out.columns == [*df.columns, "shard"]
    assert sorted((r[0:2] for r in out.collect()), key=repr) == sorted((tuple(r)[:2] for r in df.collect()), key=repr)
    assert compact_into_shards(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="shard"):
        compact_into_shards(out)


def test_shards_are_whole_files_without_a_sort(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    store = ShardStore(spark, f"file://{tmp_path}/store", small_bytes=20_000, target_bytes=200_000)
    store.append(docs.filter("doc_id % 2 = 0"))
    store.append(docs.filter("doc_id % 2 = 1"))
    for version in (2, store.compact(final=True)):
        for s in store.manifest(version):
            row = spark.read.parquet(s.path).selectExpr("count(*)", "coalesce(sum(octet_length(text)), 0)").first()
            assert tuple(row) == (s.rows, s.bytes)
    assert store.append(docs.limit(0)) == store.version() and all(s.rows for s in store.manifest())


def test_many_shards_are_numbered_by_a_shuffled_join(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    out = compact_into_shards(docs, f"file://{tmp_path}/store", small_bytes=20_000, target_bytes=200_000, max_broadcast=0)
    assert sorted(map(tuple, out.drop("shard").collect())) == sorted(map(tuple, docs.collect()))
    assert len(list((tmp_path / "store" / "data").iterdir())) > 2  # nothing of a caller's store is deleted
