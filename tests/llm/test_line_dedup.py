import numpy as np
import pytest

from relspark.llm.line_dedup import CuckooFilter, LineIndex, Page, dedup_lines
from tests.llm import brute

LONG, OTHER = "This Line Is Long Enough To Be Counted As A Key", "é" * 40


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def cases():
    docs = [(i, f"{LONG}\nshort\n  {LONG.lower()}\t\n{OTHER}{i}") for i in range(6)]
    docs += [(i, OTHER + "\n" + "é" * 39) for i in range(6, 11)]
    return docs + [(20, None), (21, ""), (22, "\n\n"), (23, LONG), (23, LONG), (24, "x" * 200_000)]


def test_like_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(100_000 + i, t) for i, t in cases()]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as gone", "3 as shard")
    assert rows(dedup_lines(df)) == brute.dedup_lines(docs)
    assert rows(dedup_lines(df, shards=3, salts=2)) == brute.dedup_lines(docs)
    assert dedup_lines(df.limit(0)).collect() == []


def test_null_id_is_lowest(spark):
    df = spark.createDataFrame([(None, LONG)] * 4 + [(1, LONG)], "doc_id long, text string")
    assert rows(dedup_lines(df)) == sorted([(None, "", 1, 1)] * 4 + [(1, LONG, 1, 0)], key=repr)


def test_cuckoo_filter():
    draw = np.random.default_rng(0)
    keys = draw.integers(-(2**63), 2**63, 5000)
    filt = CuckooFilter.of(keys)
    assert filt.contains(keys).all()
    assert filt.contains(draw.integers(-(2**63), 2**63, 20000)).mean() < 0.01
    assert all(filt.delete(int(k)) for k in keys[:2500])
    assert filt.contains(keys[2500:]).all()
    assert filt.contains(keys[:2500]).mean() < 0.01
    page = Page(keys, keys[::-1].copy(), np.arange(5000))
    again = Page.from_bytes(page.to_bytes())
    assert again.to_drop(keys, keys[::-1].copy(), np.full(5000, -1)).all()
    assert not again.to_drop(keys, keys, np.full(5000, -1)).any()


def test_index_takes_documents_out_again(spark, tmp_path):
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = LineIndex(spark, f"file://{tmp_path}/index", shards=3)
    index.insert(df.filter("doc_id < 3"))
    index.insert(df.filter("doc_id >= 3"))
    assert rows(index.dedup(df)) == brute.dedup_lines(docs)
    index = LineIndex(spark, index.path, shards=3, version=index.version)
    index.delete(df.filter("doc_id in (2, 23)"))
    left = [d for d in docs if d[0] not in (2, 23)]
    assert rows(index.dedup(df.filter("doc_id not in (2, 23)"))) == brute.dedup_lines(left)
    index.delete(df.filter("doc_id = 3"))
    left = [d for d in left if d[0] != 3]
    assert rows(index.dedup(df.filter("doc_id not in (2, 3, 23)"))) == brute.dedup_lines(left)
    index.insert(df.filter("doc_id in (2, 3, 23)"))
    assert rows(index.dedup(df)) == brute.dedup_lines(docs)


def test_index_after_many_changes(spark, tmp_path):
    """Batches in and out, with repeated rows, ids that are null and texts that were never inserted."""
    draw = np.random.default_rng(1)
    lines = [f"{i:03d} a line of more than forty code points, repeated" for i in range(12)]
    schema = "doc_id long, text string"
    index, held = LineIndex(spark, f"file://{tmp_path}/index", min_docs=2, shards=2, page_keys=3), []
    for step in range(6):
        fresh = [(int(draw.integers(0, 30)), "\n".join(draw.choice(lines, draw.integers(1, 4)))) for _ in range(5)]
        index.insert(spark.createDataFrame(fresh + [(None, lines[step])], schema))
        held += fresh + [(None, lines[step])]
        if step % 2:
            gone = [held.pop(int(draw.integers(0, len(held)))) for _ in range(4)]
            index.delete(spark.createDataFrame(gone + [(99, lines[0]), (0, "never " * 10)], schema))
    counts = {}
    for doc, text in held:
        for line in set(text.split("\n")):
            n, keep = counts.get(line, (0, -1 << 63))
            counts[line] = n + 1, max(keep, -1 << 63 if doc is None else doc)
    assert sorted((r.n_docs, r.keep_id) for r in index.counts().collect()) == sorted(counts.values())
    assert index.state["keys"] == sum(n > 1 for n, _ in counts.values()) <= index.shards * index.page_keys
    assert index.shards > 2 and len(index.state["counts"]) < 6

    def kept(doc, text):
        return "\n".join(x for x in text.split("\n") if counts[x][0] < 2 or counts[x][1] == (-1 << 63 if doc is None else doc))

    known = spark.createDataFrame(held, schema)
    index.vacuum()
    index = LineIndex(spark, index.path, min_docs=2, version=index.version, page_keys=3)
    assert sorted(((r.doc_id, r.text) for r in index.dedup(known).collect()), key=repr) == sorted(((d, kept(d, t)) for d, t in held), key=repr)
    index.insert(known.limit(0))
    index.delete(known)
    assert index.counts().collect() == [] and index.state["keys"] == 0


def test_index_has_one_writer_a_version(spark, tmp_path):
    df = spark.createDataFrame(cases()[:8], "doc_id long, text string")
    index, other = (LineIndex(spark, f"file://{tmp_path}/index") for _ in range(2))
    index.insert(df)
    with pytest.raises(RuntimeError, match="another writer"):
        other.insert(df)
    assert other.version == 0
