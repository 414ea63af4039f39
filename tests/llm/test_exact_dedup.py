import pytest

from relspark.llm.exact_dedup import drop_copies, exact_dedup
from tests.llm import brute


def want(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault("".join(c for c in t or "" if c not in brute.WS), []).append((-len(t or ""), d is not None, d))
    out = []
    for key, rows in groups.items():
        keep = min(rows)[2]
        out += [(d, keep, len(rows), d == keep, brute.sha(key)) for _, _, d in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("radix", "partitions"), [(16, None), (2, 13), (3, 1)])
def test_like_brute_force(spark, sf, radix, partitions):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9002, ""), (9003, " \n "), (9004, "a\u00a0b"), (9005, "a b"), (9006, "ab"), (None, "a  b"), (9007, "\U0001F600" * 3), (9007, "\U0001F600" * 3), (9008, "y" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as origin").repartition(6)
    assert sorted((tuple(r) for r in exact_dedup(df, radix=radix, partitions=partitions).collect()), key=repr) == want(docs)


def test_edges(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert exact_dedup(df.limit(0)).collect() == []
    assert sorted((r[0] for r in drop_copies(df).collect()), key=repr) == [1, None]
