from relspark.llm.decontaminate import contamination, drop_contaminated
from tests.llm import brute


def result(df):
    return sorted(((r[0], r[1], r[2], len(r.items), brute.sha(",".join(sorted(map(str, r.items)))), r.contaminated) for r in df.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()), key=repr)


def want(docs, items):
    return sorted(((d, *v) for d, t in docs for v in [brute.contamination([(d, t)], items)[d]]), key=repr)


def test_on_documents(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = want([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert result(contamination(docs, bench)) == expected
    assert result(contamination(docs, bench, max_broadcast=0)) == expected
    assert any(x[-1] for x in expected)


def test_edges(spark):
    long_item = " ".join(f"q{i}" for i in range(14))
    items = [(1, long_item), (2, "Short item, here"), (3, None), (4, "..."), (None, "lost words"), (5, "short ITEM here"), (10, "a a a a a a a a a a a a a a a")]
    docs = [
        (1, None), (2, ""), (3, "!!"), (4, f"x {long_item} y"), (5, long_item[:-4]), (6, "short-item-here and short item there"),
        (None, "short item here"), (7, "lost words"), (8, "a " * 40), (9, f"{long_item} " * 3), (9, f"{long_item} " * 3),
        (11, "z " * 500 + "short item here"), (13, "y " * 300_000 + long_item + " y" * 300_000), (12, " ".join(f"q{i}" for i in range(12))),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as starts", "3 as doc_key", "4 as key", "5 as print")
    b = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    assert result(contamination(d, b)) == want(docs, known)
    assert result(contamination(d, b, max_broadcast=3)) == want(docs, known)
    assert result(contamination(d, b.limit(0))) == want(docs, [])
    assert contamination(d.limit(0), b).collect() == []
    left = drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted([d for (d, *_, bad) in want(docs, known) if not bad], key=repr)
