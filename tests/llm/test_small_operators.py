import random

import duckdb
import pytest

from codeatlas.llm import chat_format, common, toxicity
from codeatlas.llm.sentencepiece_lattice import SPACE, Vocabulary
from codeatlas.llm.token_counts import Automaton, count_tokens

from .helpers import ODD, by_id, documents


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        size = max((k for k in range(1, len(word) - i + 1) if word[i : i + k] in pieces), default=0)
        n += 1 if size else len(word[i].encode())
        i += max(size, 1)
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_counts_what_greedy_matching_cuts(seed):
    r = random.Random(seed)
    pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(25)}
    a = Automaton(sorted(pieces))
    for _ in range(400):
        word = "".join(r.choice("abcdé") for _ in range(r.randint(0, 25)))
        assert a.count(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark):
    pieces = {p for p, _, _ in Vocabulary().pieces}
    texts = [*ODD[:4], *ODD[5:], "x" * 3000, "tokenization of  words\n日本語"]
    got = by_id(count_tokens(documents(spark, texts, extra=True)), "n_words", "n_tokens", "max_word_tokens")
    for i, t in enumerate(texts):
        each = [greedy(SPACE + w, pieces) for w in (t or "").split()]
        assert got[i + 1] == (len(each), sum(each), max(each, default=0))
    assert count_tokens(documents(spark, ["x"]).limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def chats(spark, rows):
    return {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(rows, TURNS)).collect()}


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = [(c, i, *talk[i]) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for i in range(n)] + [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "assistant", "hi")]
    got = chats(spark, rows)
    assert set(got) == {3, 5, 6} and got[3]["n_logged"] == 2 and got[3]["n_turns"] == 3
    assert got[5]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_odd_turns(spark):
    rows = [(1, None, None, None), (1, 2, "User", "<|im_end|>"), (1, 2, "User", "<|im_end|>"), (None, 0, "user", "x"), (2, 5, "user", ""), (2, 9, "user", "y" * 50_000)]
    got = chats(spark, rows)
    assert set(got) == {1, 2, None} and got[1]["n_turns"] == 2
    assert got[1]["rendered"] == "<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n<\\|im_end|><|im_end|>\n"
    assert chat_format.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    plan = chat_format.format_chats(spark.createDataFrame(rows, TURNS + "")).select("conv_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def test_boundaries_between_role_and_text_count(spark):
    assert set(chats(spark, [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (2, 1, "x", "y")])) == {1, 2}


def test_chats_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    want = sorted(map(tuple, con.execute(f"SELECT conv_id, n_turns, n_logged, rendered FROM ({chat_format.ORACLE_SQL})").fetchall()))
    assert sorted(map(tuple, chat_format.query(spark, sf_dir).select("conv_id", "n_turns", "n_logged", "rendered").collect())) == want


BAD = ["vile", "rotten", "foul", "nasty", "horrid"]


def labelled(spark, n=400):
    r = random.Random(2)
    clean = ["".join(r.choice("klmopstu") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        words = [r.choice(clean) for _ in range(r.randint(20, 60))]
        for _ in range(toxic * r.randint(1, 6)):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append(" ".join(words))
        labels.append((i + 1, 1, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_grades(spark):
    docs, labels = labelled(spark)
    known = labels.filter("doc_id <= 300")
    model = toxicity.fit(docs, known)
    assert model.thresholds == sorted(model.thresholds) and set(BAD) <= {w for w, x in model.weights.items() if x > 0}
    got = by_id(toxicity.score(docs, model), "toxic", "severity")
    truth = {r["doc_id"]: bool(r["toxic"]) for r in labels.filter("doc_id > 300").collect()}
    assert sum(got[i][0] == t for i, t in truth.items()) >= 0.97 * len(truth)
    more = by_id(toxicity.score(documents(spark, ["some words", "some vile", "some vile rotten", "vile rotten foul nasty horrid"]), model), "severity")
    assert more[1] < more[2] < more[3] < more[4] <= toxicity.GRADES - 1


def test_toxicity_of_odd_texts_and_without_labels(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.score(documents(spark, ODD, extra=True), model), "toxic", "severity")
    assert len(got) == len(ODD) and not any(t for t, _ in got.values()) and got[1] == got[2]
    none = toxicity.fit(docs, labels.limit(0))
    assert not any(by_id(toxicity.score(docs, none), "toxic").values())
    assert not any(by_id(toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))), "toxic").values())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_on_the_synthetic_table(spark):
    at = "/root/testdata/sf0.01"
    labels = common.table(spark, at, "labels").join(toxicity.query(spark, at).withColumnRenamed("toxic", "said"), "doc_id").collect()
    assert sum(r["said"] == bool(r["toxic"]) for r in labels) >= 0.93 * len(labels)
