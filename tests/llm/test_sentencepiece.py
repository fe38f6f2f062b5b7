import itertools
import random

import pytest

from codeatlas.llm import common
from codeatlas.llm import sentencepiece_lattice as sp

from .helpers import DOCS, ODD, by_id, documents


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


@pytest.mark.parametrize("hot_words", [sp.HOT_WORDS, 3])
def test_ids_equal_the_library(spark, sf_dir, vocabulary, library, hot_words):
    """All documents: with the words in the broadcast tables, and with nearly all of them joined."""
    own = common.table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in own.collect()}
    got = by_id(sp.encode(own, vocabulary, hot_words), "ids", "round_trip")
    assert {i: list(x) for i, (x, _) in got.items()} == {i: library.encode(t or "") for i, t in texts.items()}
    assert all(same for _, same in got.values())


def test_odd_texts(spark, vocabulary, library):
    texts = [*ODD, "a▁b", "tabs\tand\r\nlines", "   leading", "x" * 47, " " * 100, "日本語 ﬁ"]
    got = by_id(sp.encode(documents(spark, texts, extra=True), vocabulary), "ids", "n_pieces", "round_trip")
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, n, same = got[i + 1]
        assert n == len(ids) and same == ("▁" not in (t or ""))
        assert list(ids) == library.encode(t or ""), (t or "")[:60]
    back = by_id(sp.decode(sp.encode(documents(spark, texts), vocabulary), vocabulary), "text")
    assert all(back[i + 1] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))


@pytest.mark.parametrize("hot_words", [sp.HOT_WORDS, 0])
def test_long_words_equal_the_library(spark, vocabulary, library, hot_words):
    """Words of over 48 characters without a seam: DNA, rule lines, compounds, and a mix of each with others."""
    compound = "donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft"
    r = random.Random(3)
    texts = ["acgt" * 40, "=" * 130, "th" * 40, compound, f"the {compound} and {'-' * 77} it\n{'_' * 49}", "x" * 3000, " " * 200 + "a"]
    texts += ["".join(r.choice("acgt") for _ in range(n)) for n in (49, 97, 500, 2000)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(n)) for n in (48, 60, 300)]
    got = by_id(sp.encode(documents(spark, texts), vocabulary, hot_words), "ids", "round_trip")
    for i, t in enumerate(texts):
        assert (list(got[i + 1][0]), got[i + 1][1]) == (library.encode(t), True), t[:60]


def test_shards(spark, sf_dir, vocabulary, library, monkeypatch):
    """Words broadcast in several ranges of their hashes, some of them empty, texts encoded a few at a time."""
    monkeypatch.setattr(sp, "SHARD", 7)
    monkeypatch.setattr(sp, "ENCODED", 2000)
    texts = ["a few words to share", "more of the few words", "", "wordlets alone", "ever more words come " * 300]
    got = by_id(sp.encode(documents(spark, texts), vocabulary), "ids")
    assert {i: list(x) for i, x in got.items()} == {i + 1: library.encode(t) for i, t in enumerate(texts)}


def test_pieces_of_any_length(spark):
    """The longest piece comes from the model: one of over 16 characters, and one of over a state word."""
    a, b = "abcdefghijklmnopqrst", "x" * 60
    scores = {c: -9.0 for c in {*a, *b}} | {a: -1.0, b: -2.0}
    v = sp.Vocabulary.of([(p, i + 10, s) for i, (p, s) in enumerate(scores.items())], "unigram", {})
    found = sp.lattice(spark.createDataFrame([(a, 1), (a + "a", 1)], "word string, n long"), v).collect()
    assert {r["word"]: [v.pieces[k][0] for k in r["path"]] for r in found} == {a: [a], a + "a": [a, "a"]}
    assert [v.pieces[k][0] for k in sp.Folder(v).path(b + "x")] in ([b, "x"], ["x", b])


def test_empty_table(spark, vocabulary):
    assert sp.encode(spark.createDataFrame([], DOCS), vocabulary).count() == 0


def test_repeated_rows(spark, vocabulary):
    df = documents(spark, ["a rare wordlet"])
    assert sp.encode(df.union(df), vocabulary, 0).count() == 2


def best_path(word, scores):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[last:i])
                last = i
        if all(x in scores for x in parts):
            total = sum(scores[x] for x in parts)
            best = max(best or (total, parts), (total, parts), key=lambda b: b[0])
    return best


def test_viterbi_of_a_unigram_model(spark):
    scores = {"▁": -3.0, "a": -2.5, "b": -2.6, "c": -2.9, "ab": -4.2, "bc": -3.1, "abc": -6.1, "▁a": -3.3, "ca": -4.4, "cab": -6.7}
    v = sp.Vocabulary.of([(p, i + 10, s) for i, (p, s) in enumerate(scores.items())], "unigram", {})
    words = ["▁abc", "▁abcabcab", "▁bca", "▁a", "▁cabbc"]
    found = sp.lattice(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), v).collect()
    for r in found:
        parts = [v.pieces[k][0] for k in r["path"]]
        want = best_path(r["word"], scores)
        assert "".join(parts) == r["word"] and abs(sum(scores[p] for p in parts) - want[0]) < 1e-9
    assert len(found) == len(words)
    folder = sp.Folder(v)
    assert {r["word"]: r["path"] for r in found} == {w: folder.path(w) for w in words}
