import random

import numpy as np

from relspark.llm.queries import op10_substring_dedup
from relspark.llm.substring_dedup import Splitter, dedup_substrings


def passage(seed, n, stops=True):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(n)]
    return " ".join(w + ("." if stops and draw.random() < 0.12 else "") for w in words)


def test_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    s = Splitter(3, 8, 8, 4)
    cut, runs = {}, {}
    for d, t in docs:
        t = t.encode()
        begins, stops, words = s.sentences(t)
        bounds = [*begins.tolist(), len(t)]
        assert b"".join(t[a:b] for a, b in zip(bounds, bounds[1:])) == (t if len(begins) else b"")
        cut[d] = [tuple(w.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~").lower() for w in t[a:b].split()) for a, b in zip(bounds, bounds[1:])]
        for i in range(len(begins) - 2):
            run = tuple(cut[d][i : i + 3])
            if sum(map(len, run)) >= 8:
                runs.setdefault(run, []).append((d, i))
    gone = {d: set() for d, _ in docs}
    for places in runs.values():
        for d, i in sorted(places)[1:]:
            gone[d] |= {i, i + 1, i + 2}
    got = {r[0]: (r.n_sentences, r.n_removed) for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: (len(cut[d]), len(gone[d])) for d in gone}
    assert any(gone.values())


def test_planted_passages(spark):
    for stops in (True, False):
        shared = passage(1, 60, stops)
        docs = [(i, f"{passage(10 + i, 80)} {shared} {passage(50 + i, 70)}") for i in range(8)] + [(100 + i, passage(200 + i, 150)) for i in range(20)]
        out = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert out[0].text == docs[0][1]
        for i in range(1, 8):
            lost = len(docs[i][1].split()) - len(out[i].text.split())
            assert 35 <= lost <= 60, (stops, lost)
        assert all(out[100 + i].text == docs[8 + i][1] for i in range(20))


def test_edges(spark):
    text = passage(3, 60)
    docs = [(1, None), (2, ""), (3, " \n "), (None, text), (4, text.upper()), (5, text + " " + text), (6, "Word." * 3), (6, "Word." * 3), (7, "a b c. " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as gone", "3 as first", "4 as id")
    out = dedup_substrings(df).collect()
    found = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and found[None].text == text and found[1].text == "" and found[3].text == " \n "
    assert found[4].n_removed == found[4].n_sentences and found[5].n_removed >= 20 and found[5].n_removed < found[5].n_sentences
    assert found[7].n_removed > 19_000
    assert dedup_substrings(df.limit(0)).collect() == []


def test_word_hashes_do_not_depend_on_place():
    s = Splitter(3, 8, 8, 4)
    a, b = s.sentences(b"xx yy zz zz")[2], s.sentences(b"\n long lead-in before it zz yy, XX")[2]
    assert a[0] == b[-1] and a[1] == b[-2] and a[2] == a[3] == b[-3]
    assert len(np.unique(a)) == 3


def test_short_sentences_are_compared(spark):
    lone = [" ".join(f"{w}!!" for w in passage(5, 60, False).split()), " ".join(["!!"] * 60), " ".join(["|"] * 60), passage(6, 60, False).replace(" ", "\n")]
    lone += ["| a | bb | ccc | dd | e | ff " * 12, "Two words.", "One. Two. Three.", "First sentence of two here. Second one of the text, also with words."]
    docs = [(i, t) for i, t in enumerate(lone)] + [(100 + i, t) for i, t in enumerate(lone)]
    mixed_in = [(200, passage(7, 40) + "\n" + lone[3] + "\n" + passage(8, 40)), (201, passage(9, 40) + "\nEnd.")]
    out = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(docs + mixed_in + [(301, mixed_in[1][1])], "doc_id long, text string"), extend=True).collect()}
    for i in range(len(lone)):
        assert out[100 + i].text == "" and out[100 + i].n_removed == out[100 + i].n_sentences, lone[i]
    assert out[0].text == lone[0] and out[3].text == lone[3] and [out[i].text for i in range(5, 8)] == lone[5:8]
    assert out[200].n_removed == 60 and out[301].text == "" and out[201].text == mixed_in[1][1]


def test_extended_runs_by_definition():
    s, draw = Splitter(3, 8, 8, 4, extend=True), random.Random(4)
    for _ in range(300):
        sizes = [draw.choice([1, 1, 2, 3, 9]) for _ in range(draw.randint(1, 20))]
        stops = np.cumsum(sizes)
        fits = [(a, b) for b in range(len(sizes) + 1) for a in range(b - 2) if sum(sizes[a:b]) >= 8]
        least = {f for f in fits if not any(g[0] == f[0] and g[1] < f[1] for g in fits)} | {f for f in fits if not any(g[1] == f[1] and g[0] > f[0] for g in fits)}
        low, high = s.spans(np.append(0, stops[:-1]), stops)
        assert sorted(zip(low.tolist(), high.tolist())) == sorted(least or {(0, len(sizes))})
        assert set().union(*(range(a, b) for a, b in zip(low, high))) == set(range(len(sizes)))


def test_query_extends_runs(spark, tmp_path):
    text = "\n".join(passage(11, 60, False).split())
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_removed for r in op10_substring_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 60}


def test_query_like_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    s, cut, runs = Splitter(3, 20, 20, 3), {}, {}
    for d, t in sorted(docs):
        begins, _, _ = s.sentences(t.encode())
        bounds = [*begins.tolist(), len(t.encode())]
        words = [tuple(w.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~").lower() for w in t.encode()[a:b].split()) for a, b in zip(bounds, bounds[1:])]
        sizes, n, cut[d] = [len(w) for w in words], len(words), words
        ahead = [next(((a, b) for b in range(a + 3, n + 1) if sum(sizes[a:b]) >= 20), None) for a in range(n)]
        back = [next(((a, b) for a in range(b - 3, -1, -1) if sum(sizes[a:b]) >= 20), None) for b in range(1, n + 1)]
        for a, b in sorted({r for r in ahead + back if r} or ({(0, n)} if n else set())):
            runs.setdefault(tuple(words[a:b]), []).append((d, a, b))
    gone = {d: set() for d in cut}
    for places in runs.values():
        for d, a, b in places[1:]:
            gone[d] |= set(range(a, b))
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in op10_substring_dedup(spark, sf).collect()}
    assert got == {d: (len(cut[d]), len(gone[d])) for d in cut} and any(gone.values())
