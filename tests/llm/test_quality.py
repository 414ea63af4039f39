import zlib

from relspark.llm.quality import drop_rejected, score_quality, train


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = train(docs, labels)
    out = score_quality(docs, model)
    rows = [r for r in out.join(labels, "doc_id").collect()]
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    right = sum(r.predicted == r.quality for r in held) / len(held)
    kept = [r.predicted for r in held if r.quality == 1]
    caught = [1 - r.predicted for r in held if r.quality == 0]
    print("accuracy", right, sum(kept) / len(kept), sum(caught) / len(caught))
    assert right > 0.95 and sum(kept) / len(kept) > 0.97 and sum(caught) / len(caught) > 0.8
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "A!! " * 50_000), (3, "A!! " * 50_000), (4, "plain words here")], "doc_id long, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (2, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    out = {r[0]: r for r in score_quality(docs, model).collect()}
    assert set(out) == {1, 2, 3, 4, None} and out[1].score == out[2].score and not out[None].held_out
    assert score_quality(docs.limit(0), model).collect() == []
    untrained = train(docs, labels.limit(0))
    assert {r.predicted for r in score_quality(docs, untrained).collect()} == {1}
    kept = drop_rejected(docs, untrained)
    assert kept.schema == docs.schema and kept.count() == docs.count()
