import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import common, pii

from .helpers import ODD, by_id, documents

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def fits(kind, hit):
    n = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in hit.split(".")), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]


def spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(name, m.group())]
    return [(name, s, e) for s, _, name, e in sorted(found)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.Model(spark)


def test_base_spans_equal_the_plain_patterns(spark, model):
    r = random.Random(4)
    parts = ["a@b.co", "x.y+z@mail-1.example.com_c@d.ef", "a@b", "@", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.03.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111111", "+1 (555) 010-9999", "+1.2", "+", "++49 30 1234567",
             "12 34 56 78 90 12", "é", "\U0001f600", "word", "(0) 1", ".", "-", "_", "%", "0" * 13, "\n", "  "]
    texts = ["".join(r.choice(parts) + r.choice(("", " ", ".")) for _ in range(r.randint(1, 14))) for _ in range(300)] + ODD
    texts += ["1 " * 20_000, "a" * 30_000 + "@", "+1" + "(" * 30_000, "1.2.3." * 5_000, "a@b.c " * 3_000]
    got = by_id(pii.find(documents(spark, texts, extra=True), model), "pii_base", "pii_spans")
    for i, t in enumerate(texts):
        base = [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in got[i + 1][0]]
        assert base == spans(t), t
        every = [(pii.KINDS[x["kind"]], x["start"], x["end"]) for x in got[i + 1][1]]
        assert set(base) <= set(every)
        added = [x for x in every if x not in base]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in base)


@pytest.mark.parametrize(
    ("text", "kind"),
    [('set token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now', "secret"), ("Tel. 030 1234-5678 bitte", "phone"), ("schreib an jürgen@beispiel.de ", "email"), ("a plain sentence without any of it", None), ("order 20240131 55512 arrived", None), ("see sometimes_very_long_identifier_names here", None),
     ("the server 10[.]0[.]12[.]250 answers", "ip"), ("card 4111.1111.1111.1111 was used", "card"), ("card 4111.1111.1111.1112 was used", None), ("version 1 . 2 . 300 . 4 is out", None)],
)
def test_added_spans(spark, model, text, kind):
    got = pii.find(documents(spark, [text]), model).first()["pii_spans"]
    assert [pii.KINDS[x["kind"]] for x in got] == ([kind] if kind else [])


def test_redaction(spark):
    docs = documents(spark, ["mail a@b.co or 10.0.0.1!", "\U0001f600 a@b.co", "nothing", None], extra=True).selectExpr("*", "'own' as pii_base", "'own' as text_")
    kept = pii.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("pii_base = 'own' and text_ = 'own'").count() == 4
    assert by_id(kept, "text", "n_chars") == {1: ("mail [EMAIL] or [IP]!", 21), 2: ("\U0001f600 [EMAIL]", 9), 3: ("nothing", 7), 4: (None, 0)}


def test_main_path_has_no_python(spark, sf_dir):
    plan = pii.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_synthetic_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, sf_dir, "documents").collect()}
    for i, (n, sha) in by_id(pii.query(spark, sf_dir), "n_email", "base_sha256").items():
        own = spans(texts[i])
        assert n == sum(k == "email" for k, _, _ in own)
        assert sha == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest()


def test_trees_are_those_of_a_plain_search():
    """Each split is the best of all by a search over every feature and cut; leaves and scores follow."""
    r = np.random.default_rng(5)
    x = np.round(r.random((60, 4)) * 6)
    y = ((x[:, 0] > 3) ^ (x[:, 2] > 4) | (r.random(60) < 0.1)).astype(float)
    bias, trees = pii.boosted(x, y)
    score = [bias] * 60

    def best(rows, g, h):
        worth = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + 1)
        out = None
        for f in range(4):
            values = sorted({v for v in x[:, f]})
            for c in [(a + b) / 2 for a, b in zip(values, values[1:])]:
                left, right = [i for i in rows if x[i, f] < c], [i for i in rows if x[i, f] >= c]
                if left and right and (out is None or worth(left) + worth(right) > out[0] + 1e-9):
                    out = (worth(left) + worth(right), f, c)
        return out

    def walk(tree, rows, g, h, depth):
        if isinstance(tree, float):
            assert tree == pytest.approx(pii.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1))
            for i in rows:
                score[i] += tree
            return
        assert depth and best(rows, g, h)[1:] == (tree[0], pytest.approx(tree[1]))
        walk(tree[2], [i for i in rows if x[i, tree[0]] < tree[1]], g, h, depth - 1)
        walk(tree[3], [i for i in rows if x[i, tree[0]] >= tree[1]], g, h, depth - 1)

    for tree in trees:
        p = [1 / (1 + math.exp(-s)) for s in score]
        walk(tree, list(range(60)), [y[i] - p[i] for i in range(60)], [v * (1 - v) for v in p], 2)
    assert np.allclose(score, bias + sum(pii.value(t, x) for t in trees))


def test_expression_scores_as_the_trees_do(spark, model):
    rows = spark.createDataFrame([(text,) for _, _, text, _ in pii.examples(60, 9)], "text string").select(F.explode(pii.candidates(F.col("text"))).alias("c"))
    got = rows.select("c.*", model.score(F.col("c")).alias("score")).collect()
    x = np.array([[r[f] for f in pii.FEATURES] for r in got])
    assert np.allclose([r["score"] for r in got], model.bias + sum(pii.value(t, x) for t in model.trees)) and len(got) > 40


def test_weak_labels(spark, sf_dir):
    """Overlaps with base spans are personal data, failed checksums are none, and nothing else is labelled."""
    text = "call +49 30 1234567 or 12-34-5 6, card 4111 1111 1111 1111 and 4111 1111 1111 1112, a@b.co, ü@ä.de, 300.1.2.3 and 10.1.2.3"
    got = {(pii.KINDS[int(r["c"]["kind"])], r["c"]["start"]): r["y"] for r in pii.weak(documents(spark, [text, None])).collect()}
    at = text.index
    assert got[("card", at("4111 1111 1111 1111"))] == 1 and got[("card", at("4111 1111 1111 1112"))] == 0 and got[("email", at("a@b.co"))] == 1
    assert got[("ip", at("300.1"))] == 0 and got[("ip", at("10.1.2.3"))] == 1 and ("email", at("ü@ä.de")) not in got
    assert pii.weak(common.table(spark, sf_dir, "documents")).count() > 0


def test_long_local_parts_and_repeated_rows(spark, model):
    text = "ü" + "x" * 200 + "@beispiel.de "
    df = documents(spark, [text, text])
    spans = [[(x["start"], x["end"]) for x in r["pii_spans"]] for r in pii.find(df.union(df), model).collect()]
    assert len(spans) == 4 and spans[0] == spans[1] == spans[2] == spans[3]


def test_empty_table(spark):
    empty = documents(spark, ["x"]).limit(0)
    assert pii.find(empty).count() == 0 and pii.stage(spark, empty, "").count() == 0
