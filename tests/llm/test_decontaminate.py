import random
import time
import tracemalloc

import pytest

from codeatlas.llm import common, decontaminate
from codeatlas.llm.decontaminate import Index, normal

from .helpers import ODD, documents

ITEM = "The quick brown foxes jumped over those lazy dogs while seven wizards quietly boxed."


def edit_distance(p, t):
    """Least edits of p against any part of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        last, row = row, [i] + [0] * len(t)
        for j, d in enumerate(t, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


@pytest.mark.parametrize("seed", range(6))
def test_regions_are_those_of_the_full_table(seed):
    """No region within the budget is missed, and none over it is reported."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 40)))) for i in range(6)]
    index = Index(items)
    for _ in range(12):
        item, text = r.choice(items)
        s = list(text)
        for _ in range(r.randint(0, max(1, len(s) // 8))):
            at = r.randrange(len(s))
            s[at : at + 1] = r.choice(([], ["z"], [s[at], "q"]))
        b = normal(" ".join(word() for _ in range(r.randint(0, 30))) + " " + "".join(s) + " " + " ".join(word() for _ in range(r.randint(0, 30))))
        found = {f[0]: f[3] for f in index.search(b)}
        for k, (own, w) in enumerate(index.windows):
            best = edit_distance(w, b)
            if best <= index.edits[k]:
                assert own in found
            if own in found:
                assert best <= found[own] <= index.edits[k]


def test_exact_near_and_clean(spark):
    near = ITEM.replace("seven wizards", "eleven wizards").upper()
    docs = documents(spark, [f"Before. {ITEM} After.", f"x\n{near}", "The quick brown foxes went home.", ITEM[:40], *ODD], extra=True)
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, "ab")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.hits(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7]["edits"] == 0 and f"Before. {ITEM} After."[got[1, 7]["start"] : got[1, 7]["end"]] == ITEM[:-1]
    assert 0 < got[2, 7]["edits"] <= 8
    kept = decontaminate.clean(docs, bench)
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {1, 2} and kept.columns == docs.columns


def test_part_of_a_long_item(spark):
    r = random.Random(5)
    item = " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(150))
    assert [f[0] for f in Index([(1, item)]).search(normal("start " + item[300:700] + " end"))] == [1]


@pytest.mark.parametrize(("size", "length", "edits"), [(470, 240, 0), (470, 240, 23), (500, 240, 0), (500, 270, 23), (900, 240, 23), (384, 230, 0), (384, 230, 23)])
def test_excerpts_at_every_offset(size, length, edits):
    r = random.Random(size + length + edits)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    item = normal(" ".join(word() for _ in range(size)))[:size].decode()
    around = " ".join(word() for _ in range(40))
    index = Index([(1, item), (2, " ".join(word() for _ in range(60)))])
    for at in range(len(item) - length + 1):
        s = list(item[at : at + length])
        for i in r.sample(range(length), edits):
            s[i] = r.choice(("", "z", s[i] + "q"))
        assert [f[0] for f in index.search(normal(f"{around} {''.join(s)} {around}"))] == [1], at


@pytest.mark.parametrize(("text", "item"), [("a" * 60_000, "a" * 60_000), ("ab" * 20_000, "ba" * 20_000), ("a" * 60_000, "a" * 90 + "b" * 150)])
def test_repetitive_texts_in_bounded_memory_and_time(text, item):
    """As many shared q-grams as places times offsets; no text holds the last item."""
    tracemalloc.start()
    began = time.monotonic()
    got = Index([(1, item)]).search(normal(text))
    assert time.monotonic() - began < 20 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [(f[0], f[3]) for f in got] == ([] if "b" * 9 in item else [(1, 0)])


@pytest.mark.parametrize("seed", range(4))
def test_repetitive_regions_are_those_of_the_full_table(seed):
    r = random.Random(seed)
    items = [(i, "".join(r.choice(("ab", "a", "aaab", "ba")) for _ in range(r.randint(10, 40)))) for i in range(5)]
    index = Index(items)
    for _ in range(8):
        s = list(r.choice(items)[1])
        for _ in range(r.randint(0, max(1, len(s) // 9))):
            s[r.randrange(len(s))] = r.choice(("", "b", "ab"))
        b = normal("a" * r.randint(0, 30) + "".join(s) + "ab" * r.randint(0, 20))
        found = {f[0]: f[3] for f in index.search(b)}
        for k, (own, w) in enumerate(index.windows):
            assert (edit_distance(w, b) <= index.edits[k]) == (own in found)


def test_long_texts_in_pieces(monkeypatch):
    """What lies across two pieces is found, whatever the place."""
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    monkeypatch.setattr(decontaminate, "COUNTED", 50)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    item = " ".join(word() for _ in range(60))
    for at in range(0, 2000, 61):
        before = normal(" ".join(word() for _ in range(500)))[:at].decode()
        text = normal(before + " . " + item + " " + " ".join(word() for _ in range(300)))
        assert [(f[0], text[f[1] : f[2]], f[3]) for f in Index([(3, item)]).search(text)] == [(3, item.encode(), 0)]


def test_repeated_rows_each_give_their_rows(spark):
    docs, bench = documents(spark, [f"x {ITEM}", "clean"]), spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate.hits(docs.union(docs), bench).count() == 2 and decontaminate.clean(docs.union(docs), bench).count() == 2
    assert decontaminate.hits(docs, bench.union(bench)).count() == 1


def test_empty_tables_and_blocks(spark, monkeypatch):
    docs, bench = documents(spark, [ITEM]), spark.createDataFrame([(7, ITEM), (8, ITEM[::-1])], "item_id long, text string")
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 1
    assert decontaminate.hits(docs.limit(0), bench).count() == 0
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert len(decontaminate.blocks(bench)) == 3 and decontaminate.clean(docs, bench).count() == 0
    assert [r["item_id"] for r in decontaminate.hits(docs, bench).collect()] == [7]


def test_synthetic_table(spark, sf_dir):
    docs, bench = ({r[0]: r["text"] for r in common.table(spark, sf_dir, n).collect()} for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, sf_dir).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in bench.items() if x in t} <= got
    assert all(edit_distance(normal(bench[i]), normal(docs[d])) <= 0.1 * len(normal(bench[i])) for d, i in got)
