import hashlib
import math

from pyspark.sql import functions as F

from relspark.llm.mixing import mix_sources, poisson_inverse


def test_inverse(spark):
    rates = [0.01, 0.5, 1.0, 3.7, 20.0, 64.0]
    df = spark.createDataFrame([(u, r) for r in rates for u in (0.0, 0.1, 0.5, 0.9, 0.999999, 1 - 1e-9)], "u double, r double")
    for u, r, n in df.select("u", "r", poisson_inverse(F.col("u"), F.col("r"))).collect():
        below, k, term = math.exp(-r), 0, math.exp(-r)
        while below <= u and k < r + 12 * math.sqrt(r) + 29:
            k += 1
            term *= r / k
            below += term
        assert n == k, (u, r)


def test_weights_are_met(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('x', 10 + cast(id % 7 as int)) as text", "case when id % 3 = 0 then 'a' when id % 30 = 1 then null else 'b' end as source")
    out = mix_sources(docs, {"a": 3.0, None: 1.0}, epochs=2.0, copy_col="copy")
    size = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(F.length("text"))).collect()}
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert set(size) == {"a", None}
    assert abs(size["a"] - 1.5 * total) < 0.05 * total
    assert abs(size[None] - 0.5 * total) < 0.12 * total
    again = mix_sources(docs.repartition(9), {"a": 3.0, None: 1.0}, epochs=2.0, copy_col="copy")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert out.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0


def test_large_rates_and_edges(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (None, None, None), (2, "y" * 999, "b"), (3, "", "c"), (3, "", "c")], "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as w", "3 as `__place`", "4 as __count", "5 as __copy", "6 as __key", "7 as __rate", "8 as row", "9 as key", "10 as place", "11 as name", "12 as parts", "13 as rate", "14 as count", "15 as copy")
    out = mix_sources(docs, {"a": 1.0}, epochs=1.0)
    assert out.columns == docs.columns
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(docs.first())[3:]}
    n = out.filter("source = 'a'").count()
    assert 850 < n < 1150
    assert mix_sources(docs.limit(0)).collect() == []
    few = mix_sources(docs, max_broadcast_sources=0)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, mix_sources(docs).collect()), key=repr)


def test_parts_of_large_rates_like_plain_version(spark):
    docs = [(i, "x" * (i + 1), "tiny") for i in range(3)] + [(10 + i, "y" * 2000, "hot") for i in range(200)]
    size = {"tiny": 6, "hot": 400_000}
    roots = {s: math.sqrt(n) for s, n in size.items()}
    want = {}
    for d, t, s in docs:
        rate = roots[s] / sum(roots.values()) * sum(size.values()) / size[s]
        parts = max(math.ceil(rate / 64), 1)
        assert parts > 1 or s == "hot"
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"count-42:{d}:{hashlib.md5(t.encode()).hexdigest()}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            k, term = 0, math.exp(-rate / parts)
            below = term
            while below <= u:
                k += 1
                term *= rate / parts / k
                below += term
            want[d] = want.get(d, 0) + k
    got = {r[0]: r[1] for r in mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n} and max(want.values()) > 200
