import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    one = corpus_pipeline.near_duplicates(spark, docs, sf)
    want = brute.ngram_components([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    assert one.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, docs, sf)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, v in brute.contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], bench).items() if v[-1]}
    assert bad and sorted(r[0] for r in clean.select("doc_id").collect()) == sorted({r[0] for r in docs.select("doc_id").collect()} - bad)
    assert clean.columns == docs.columns
    mixed = corpus_pipeline.mix(spark, docs, sf)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.shard(spark, docs, sf)
    assert out.columns == [*docs.columns, "shard"] and out.count() == docs.count()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r[0] for r in out.select("doc_id").collect()} <= ids and out.count() > 0


def test_empty(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_odd_rows(spark, sf):
    good = "The and of this that with words in the usual order, and so on. " * 3
    rows = [(1, good, "en", "a", 5), (2, good + "more", None, None, None), (None, None, None, None, None), (3, "", "", "", 0), (4, good, "en", "b", 5), (4, good, "en", "b", 5), (5, "x" * 100_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as label", "2 as score", "array(3) as tokens", "1 as row", "2 as id", "3 as key", "4 as own_id", "5 as own_key", "6 as __head_id", "7 as __bad_id", "8 as __kept_id", "9 as __shard", "10 as __folder", "11 as __place", "12 as stays")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        others = {str(tuple(r)[5:20]) for r in out.collect()}
        assert not others or others == {str(tuple(docs.first())[5:20])}, name
    kept = [r[0] for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect()]
    assert sorted(kept, key=repr) == sorted([1, None, 3, 5], key=repr)
