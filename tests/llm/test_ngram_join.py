import random

import numpy as np
import pytest

from relspark.llm.common import id_bitmaps, in_bitmaps
from relspark.llm.ngram_join import PrefixTree, keep_one, lone_shingles, ngram_join, ngram_links, pack_chunk
from tests.llm import brute


def near_copies(n=60, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, n):
        copy = list(base)
        for _ in range(draw.randint(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        docs.append((i, " ".join(copy)))
    for i in range(n, n + 30):  # short texts around the smallest sizes that can link
        size = draw.randint(1, 14)
        text = " ".join(base[:size]) + (" x" if draw.random() < 0.5 else "")
        docs.append((i, text))
    return docs


@pytest.mark.parametrize(("n", "num", "how"), [(3, 90, {}), (5, 80, {}), (3, 90, {"max_weight": 1500}), (5, 80, {"max_weight": 900, "spread": 0.0}), (3, 90, {"max_weight": 1, "spread": 10.0})])
def test_like_brute_force(spark, n, num, how):
    docs = near_copies()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: (r[1], r[2]) for r in ngram_join(df, n=n, num=num, **how).collect()}
    assert got == brute.ngram_components(docs, n, num)


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.ngram_components([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r[0]: (r[1], r[2]) for r in ngram_join(docs).collect()} == want


def test_edges(spark):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "One"), (3, "oNE"), (9, "one two"), (None, "one"), (8, "One")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as row", "3 as stays", "4 as rep", "map(1, 2) as cell", "5 as __map", "6 as __bits")
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join(df).collect()), key=repr)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (3, 1, 3), (9, 1, 9), (None, 1, 3), (8, 1, 3)], key=repr)
    assert ngram_join(df.limit(0)).collect() == []
    assert keep_one(df).columns == df.columns
    assert sorted((r[0] for r in keep_one(df.unionAll(df.filter("doc_id = 3"))).collect()), key=repr) == sorted([5, 6, 7, 3, 9, None], key=repr)
    rows = [(1, "a b", "y"), (1, "a b", "x"), (1, "other", "z"), (None, "a b", "v"), (None, "a b", "v"), (2, "a B", "u")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, more string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a b", "x"), (1, "other", "z"), (None, "a b", "v"), (None, "a b", "v")], key=repr)


def test_lone_shingles_are_those_of_one_class():
    draw = np.random.default_rng(1)
    sets = {int(t) + 1: np.unique(draw.integers(0, 900, draw.integers(1, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for t in range(60)}
    packs = {}
    for chunk in (range(1, 31), range(25, 61)):  # six classes are in both
        for bucket, runs, counts, hashes in pack_chunk({t: sets[t] for t in chunk}, 7):
            tags = np.repeat(np.frombuffer(runs, np.uint64), np.frombuffer(counts, np.uint32))
            packs.setdefault(bucket, []).append((np.frombuffer(hashes, np.uint32), tags))
    got = dict.fromkeys(sets, 0)
    for rows in packs.values():
        for tag, lone in zip(*lone_shingles(*map(np.concatenate, zip(*rows, strict=True))), strict=True):
            got[int(tag)] += int(lone)
    holders = {}
    for tag, s in sets.items():
        for x in s.tolist():
            holders.setdefault(x, set()).add(tag)
    assert got == {t: sum(len(holders[x]) == 1 for x in s.tolist()) for t, s in sets.items()}


def test_bitmaps_hold_all_ids(spark):
    ids = spark.range(0, 100_000, 7)
    rows = spark.range(-500, 100_000).selectExpr("id as doc_id").unionAll(spark.sql("select cast(null as long)"))
    bits = id_bitmaps(ids)
    hit = {r[0] for r in in_bitmaps(rows, bits, "doc_id", True).collect()}
    free = {r[0] for r in in_bitmaps(rows, bits, "doc_id", False).collect()}
    assert hit >= set(range(0, 100_000, 7)) and len(hit) < 16_000 and None in free
    assert not hit & free and len(hit | free) == 100_501


def test_one_hot_shingle_and_one_large_group(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    common = "all rights reserved by the owner of this text"
    docs = [(i, " ".join([common, *draw.choices(words, k=draw.randint(0, 60))])) for i in range(400)]
    base = draw.choices(words, k=150)
    for i in range(400, 700):
        copy = list(base)
        for _ in range(draw.randint(0, 5)):
            copy[draw.randrange(150)] = draw.choice(words)
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute.ngram_components(docs)
    for how in ({}, {"max_weight": 9_000}):
        assert {r[0]: (r[1], r[2]) for r in ngram_join(df, **how).collect()} == want


def global_order(sets):
    tokens, df = np.unique(np.concatenate(sets), return_counts=True)
    held = dict(zip(tokens.tolist(), df.tolist(), strict=True))
    return [np.sort(np.array([(held[x] << 52) | x for x in s.tolist()], np.int64)) for s in sets]


def test_tree_finds_all_links():
    draw = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = draw.integers(0, 3000, 80)
        for _ in range(draw.integers(1, 12)):
            sets.append(np.unique(np.append(base[draw.random(80) > 0.05], draw.integers(0, 3000, draw.integers(0, 6)))).astype(np.uint64))
    sets, sizes = global_order(sets), [len(s) for s in sets]
    _, roots = PrefixTree(sets, sizes).links(90, 100)
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y))]
    want = brute.components(links, range(len(sets)))
    got = brute.components(enumerate(roots.tolist()), range(len(sets)))
    assert got == want
    labels = [want[i] if i % 3 else i + 1000 for i in range(len(sets))]
    before, after = PrefixTree(sets, sizes).links(90, 100, np.array(labels))
    moved = [(i, r) for i, r in enumerate(after.tolist()) if r != before[i]]
    same = [(i, j) for i in range(len(sets)) for j in range(i) if labels[i] == labels[j]]
    assert brute.components(moved + same, range(len(sets))) == want


@pytest.mark.parametrize(("num", "max_weight"), [(90, 1 << 21), (80, 1500), (90, 1)])
def test_all_links_like_brute_force(spark, num, max_weight):
    docs = near_copies()
    docs += [(200 + i, t) for i, t in docs[:3]]
    sets = {}
    for d, t in docs:
        sets.setdefault(brute.shingle_set(t, 3), d)
    want = {(a, b) for x, a in sets.items() for y, b in sets.items() if a < b and 100 * len(x & y) >= num * len(x | y)}
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (300, "")], "doc_id long, text string")
    got = [tuple(r) for r in ngram_links(df, num=num, max_weight=max_weight).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > len(sets) - len(set(brute.components(want, sets.values()).values()))
