import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeatlas.llm import common, near_dedup

from .helpers import DOCS, ODD, by_id, documents


def brute(texts):
    """Components by exact set comparison: {id: (set size, least id)}."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(4, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for s in sets[i] for j in seen[s]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    got = by_id(near_dedup.near_duplicates(df), "n_shingles", "component_id", "kept")
    want = brute(texts)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_synthetic_table(spark, sf_dir):
    check(spark, {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()})


def test_large_group_of_near_copies_with_outliers(spark):
    """Buckets that no star settles: many texts at 0.6 to 0.9 from each other."""
    r = random.Random(3)
    base = [f"w{r.randrange(9999)}" for _ in range(120)]
    texts = {}
    for i in range(220):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 5, 7, 9))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    check(spark, texts)


@pytest.mark.parametrize("seed", [1])
def test_buckets_settled_in_blocks(spark, seed, monkeypatch):
    """Crowds compared whole and bucket by bucket, in small blocks, of sets of many sizes, with hot keys dealt over tasks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(common.spread, "__defaults__", ("inner", 5))
    r = random.Random(seed)
    texts = {}
    for family in range(3):
        base = [f"w{family}x{r.randrange(9999)}" for _ in range(90)]
        for _ in range(60):
            w = base[: r.choice((50, 60, 72, 90))]
            for _ in range(r.choice((0, 1, 2, 4, 6))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    check(spark, texts | {len(texts) + i: texts[0] for i in range(20)})


def test_spread_joins_as_a_join_does(spark):
    big = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (None, 5), (3, 12)) for i in range(n)], "k long, i long")
    small = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "k long, v string")
    for how in ("inner", "left"):
        got, want = (sorted(map(tuple, f(big).collect()), key=str) for f in (lambda b: common.spread(b, small, "k", how, 4), lambda b: b.join(small, "k", how)))
        assert got == want and len(got) == (52 if how == "inner" else 60)


def test_odd_texts(spark):
    texts = {i + 1: t for i, t in enumerate(ODD)} | {20: "one two three", 21: "ONE  two\tthree", 22: "one two", 23: "a b c d\x1ce"}
    check(spark, texts)
    assert near_dedup.near_duplicates(documents(spark, ODD, extra=True)).count() == len(ODD)
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_without_an_id_link_others(spark):
    """Documents 1 and 2 are 0.72 alike; each is 0.86 like a text that only rows with a null id hold."""
    w = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(w[14:])), (None, " ".join(w)), (None, " ".join(w)), (2, " ".join(w[:-14])), (None, "all alone here"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (None, 1, False), (None, 1, False), (None, None, True), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(df.filter("doc_id is null")).filter("kept").count() == 4
    stayed = near_dedup.stage(spark, df, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in stayed), key=str) == sorted([(1, rows[0][1]), (None, "all alone here"), (None, None)], key=str)
    assert near_dedup.stage(spark, df.limit(0), "").count() == 0


def test_stage_keeps_one_of_a_group(spark):
    kept = near_dedup.stage(spark, documents(spark, ["a b c d e", "a b c d e", "other words are here now", None], extra=True), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and "cid" in kept.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 100)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["cid"]: r["label"] for r in got.collect()} == {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50}


@pytest.mark.parametrize("n", [1, 2, 5, 40, 400, 5000])
def test_signatures_agree_as_often_as_sets_do(n):
    r = np.random.default_rng(n)
    s = np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    fewer = s[: max(1, n * 9 // 10)] if n > 1 else s
    a, b = (near_dedup.signature(np.sort(x), near_dedup.bounds()) for x in (r.permutation(s), s))
    assert (a == b).all() and set(a.tolist()) <= set(s.tolist())
    share = (near_dedup.signature(np.sort(r.permutation(s)[: len(fewer)]), near_dedup.bounds()) == b).mean()
    assert abs(share - len(fewer) / n) < 0.25
