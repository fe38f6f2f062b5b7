import math
import re
from collections import Counter

import numpy as np
import pytest

from codeatlas.llm import common, language_id

from .helpers import DOCS, ODD, by_id, documents

WORDS = {"en": "the thing there that other with which".split(), "de": "der schöne über nicht einung keit auch".split(), "es": "niño señor está aquí corazón mañana".split()}


def corpus(spark, n=120):
    import random

    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(3, 60))), lang, "s", 0))
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.fit(corpus(spark))


def test_held_out_rows_are_right_and_never_learned_from(spark, model):
    docs = corpus(spark)
    got = by_id(language_id.predict(docs, model), "lang_pred", "rejected")
    for r in docs.filter(language_id.held_out(docs["doc_id"])).collect():
        assert got[r["doc_id"]] == (r["lang"], False)
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert language_id.fit(changed).langs == model.langs


def test_odd_texts(spark, model):
    got = by_id(language_id.predict(documents(spark, [*ODD, "123 456", "the thing"], extra=True), model), "lang_pred", "score", "rejected")
    assert len(got) == len(ODD) + 2
    for i in (1, 2, 3, 10):
        assert got[i] == ("und", 0.0, True)
    assert got[11][0] == "en" and not got[11][2]
    assert got[8] == got[9] and all(0 <= s <= 1 for _, s, _ in got.values())


def test_far_texts_are_rejected(spark, model):
    docs = documents(spark, ["снег идёт и ветер воет над полем " * 5, "the other thing with that " * 5])
    kept = language_id.stage(spark, corpus(spark).unionByName(docs.selectExpr("doc_id + 10000 as doc_id", "text", "cast(null as string) as lang", "source", "n_chars")), "")
    ids = {r["doc_id"] for r in kept.collect()}
    assert 10001 not in ids and 10002 in ids and len(ids) == 121 and kept.columns == docs.columns


def test_texts_of_unknown_languages_are_rejected(spark, sf_dir):
    """Italian, Portuguese and Finnish aren't among the corpus' languages; its own documents stay."""
    docs = common.table(spark, sf_dir, "documents")
    foreign = [
        "La Repubblica Italiana è uno Stato membro dell'Unione europea, situato nell'Europa meridionale, il cui territorio coincide in gran parte con l'omonima regione geografica.",
        "Portugal, oficialmente República Portuguesa, é um país soberano unitário localizado no sudoeste da Europa, cujo território se situa na zona ocidental da Península Ibérica.",
        "Suomen tasavalta eli Suomi on valtio Pohjois-Euroopassa Itämeren rannalla. Se rajoittuu idässä Venäjään, lännessä Ruotsiin ja pohjoisessa Norjaan.",
    ]
    model = language_id.fit(docs)
    got = by_id(language_id.predict(documents(spark, foreign), model), "rejected")
    assert got == {1: True, 2: True, 3: True}, (got, model.floor)
    own = language_id.predict(docs, model).join(docs.filter("text rlike '\\\\p{L}'").select("doc_id"), "doc_id", "left_semi")
    assert own.filter("rejected").count() <= 0.005 * own.count()


def plain_counts(text):
    """1-, 2- and 3-grams of letters, each run of others as a mark, in a dictionary of the same bins."""
    a = "".join(c if c.isalpha() else "\0" for c in text.lower())
    a = "\0" + re.sub("\0+", "\0", a).strip("\0") + "\0"
    bins = Counter()
    for k in (1, 2, 3):
        for i in range(len(a) - k + 1):
            gram = sum(ord(c) << 21 * (k - 1 - j) for j, c in enumerate(a[i : i + k]))
            if gram or k > 1:
                bins[((gram + (1 << 60 if k == 2 else 0)) * int(language_id.MULT) % (1 << 64)) >> (64 - language_id.DIM.bit_length() + 1)] += 1
    return bins


def test_cosines_are_those_of_plain_loops(spark, model):
    texts = ["the thing, there!", "der schöne Tag", "niño señor 12 está", "a", "x y z " * 30, "Grüße \U0001f600"]
    got = by_id(language_id.predict(documents(spark, texts), model), "lang_pred", "score")
    for i, t in enumerate(texts):
        x = {b: math.log1p(n) * float(model.idf[b]) for b, n in plain_counts(t).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        scores = [sum(v * float(c[b]) for b, v in x.items()) / norm for c in model.centroids]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        assert got[i + 1][1] == pytest.approx(min(1.0, max(0.0, scores[best])), abs=1e-5)
        assert scores[model.langs.index(got[i + 1][0]) :][: language_id.CLUSTERS] and max(s for s, lang in zip(scores, model.langs, strict=True) if lang == got[i + 1][0]) >= scores[best] - 1e-5


def test_centroids_are_those_of_plain_k_means():
    r = np.random.default_rng(4)
    x = np.abs(r.normal(size=(40, 12))).astype(np.float32)
    x[:20, :6] *= 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seeds = [0]
    while len(seeds) < 3:
        seeds.append(min(range(40), key=lambda i: (max(float(x[i] @ x[j]) for j in seeds), i)))
    c = [x[j].astype(float) for j in seeds]
    for _ in range(12):
        of = [max(range(3), key=lambda k, v=v: (float(v @ c[k]), -k)) for v in x]
        for k in range(3):
            if k in of:
                total = sum(x[i].astype(float) for i in range(40) if of[i] == k)
                c[k] = total / np.linalg.norm(total)
    assert np.allclose(language_id.spherical(x, 3), c, atol=1e-5)


def test_equal_cosines_take_the_first_language_and_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(i, "same words here", lang, "s", 0) for i in range(40) for lang in ("b", "a")], DOCS)
    found = language_id.predict(docs, language_id.fit(docs))
    assert found.count() == 80 and {r["lang_pred"] for r in found.collect()} == {"a"}
    assert language_id.stage(spark, docs, "").count() == 80 and language_id.stage(spark, docs.limit(0), "").count() == 0


def test_without_labels(spark):
    docs = documents(spark, ["some text"], lang=None)
    assert by_id(language_id.predict(docs, language_id.fit(docs)), "lang_pred") == {1: "und"}
    empty = spark.createDataFrame([], DOCS)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0


def test_frequent_languages_come_first(spark):
    """Over 1,000 rare labels, as junk tags are, don't push a language out."""
    rows = [(i, f"text {i}", "en", "s", 0) for i in range(60)] + [(100 + i, f"text {i}", f"x{i}", "s", 0) for i in range(1600)]
    docs = spark.createDataFrame(rows, DOCS)
    langs = [r["lang"] for r in language_id.sampled(docs, 400).collect()]
    assert langs.count("en") > 30 and len(set(langs)) == language_id.MAX_LANGS
    assert {r["lang"] for r in language_id.sampled(docs, 400, 1).collect()} == {"en"}


def test_accuracy_on_the_synthetic_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    got = language_id.query(spark, sf_dir).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 0
