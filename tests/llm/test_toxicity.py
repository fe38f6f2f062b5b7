import math
import random

import numpy as np
import pytest

from codeatlas.llm import toxicity

from .helpers import DOCS, by_id, documents


def loss(w, free, rows, grade, used):
    """The penalised likelihood, text by text, in plain loops."""
    t = [free[0]]
    for x in free[1:]:
        t.append(t[-1] + math.exp(x))
    total = 0.0
    for terms, g in zip(rows, grade, strict=True):
        s = sum(w[i] for i in terms)
        above = [1.0, *(1 / (1 + math.exp(x - s)) for x in t), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / used + toxicity.PENALTY / 20 / used * sum(x * x for x in w)


def problem(seed, n=60, n_terms=8):
    r = random.Random(seed)
    rows = [sorted(r.sample(range(n_terms), r.randint(0, 4))) for _ in range(n)]
    grade = [min(3, max(0, round(sum(1.5 if i < 3 else -0.5 for i in t) + r.gauss(0, 0.7)))) for t in rows]
    row = np.array([i for i, t in enumerate(rows) for _ in t], np.int64)
    return rows, grade, row, np.array([i for t in rows for i in t], np.int64)


@pytest.mark.parametrize("seed", range(3))
def test_gradient_is_the_numerical_one(seed):
    rows, grade, row, column = problem(seed)
    r = np.random.default_rng(seed)
    x = np.concatenate((r.normal(size=8), [0.3], r.normal(size=toxicity.GRADES - 2) * 0.3))
    got = np.concatenate(toxicity.gradient(x[:8], x[8:], row, column, np.array(grade), np.full(60, 1 / 60)))
    for i in range(len(x)):
        step = np.eye(len(x))[i] * 1e-5
        slope = (loss((x + step)[:8], (x + step)[8:], rows, grade, 60) - loss((x - step)[:8], (x - step)[8:], rows, grade, 60)) / 2e-5
        assert got[i] == pytest.approx(slope, abs=1e-6)


def test_fit_is_near_the_least_loss():
    """No plain descent from the fitted parameters gets far below their loss, and thresholds are ordered."""
    rows, grade, row, column = problem(7)
    w, t = toxicity.cumulative_logit(row, column, np.array(grade), 8, np.ones(60, bool))
    assert list(t) == sorted(t)
    x = np.concatenate((w, t[:1], np.log(np.diff(t))))
    fitted = best = loss(x[:8], x[8:], rows, grade, 60)
    for _ in range(300):
        x = x - 0.2 * np.concatenate(toxicity.gradient(x[:8], x[8:], row, column, np.array(grade), np.full(60, 1 / 60)))
        best = min(best, loss(x[:8], x[8:], rows, grade, 60))
    assert fitted - best < 0.01 < loss(np.zeros(8), x[8:], rows, grade, 60) - fitted


def test_expected_severity_in_plain_loops():
    m = toxicity.Model({"bad": 2.0, "worse": 1.5, "fine": -1.0}, [0.5, 1.2, 2.6], 1.0)
    for found in ({"bad"}, {"bad", "worse", "other"}, {"fine"}, set()):
        s = sum(m.weights.get(w, 0) for w in found)
        above = [1 / (1 + math.exp(t - s)) for t in m.thresholds]
        chance = [a - b for a, b in zip([1, *above], [*above, 0], strict=True)]
        severity, grade = m.severity(found)
        assert severity == pytest.approx(sum(k * p for k, p in enumerate(chance))) and grade == chance.index(max(chance))


def test_equal_odds_and_repeated_rows(spark):
    """Words that only occur together get one weight between them, whatever their order; repeated rows each get their row."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join(r.sample(words, 12)) + (" zork blat" if i % 4 == 0 else ""), "en", "s", 0) for i in range(240)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.weights["zork"] > 0 and model.weights["zork"] == pytest.approx(model.weights["blat"], abs=1e-6)
    own = documents(spark, ["the zork blat thing", "the thing", None])
    got = by_id(toxicity.score(own, model), "toxic", "grade")
    assert got[1][0] and not got[2][0] and not got[3][0] and got[3][1] == 0
    assert toxicity.score(own.union(own), model).count() == 6 and toxicity.score(own.limit(0), model).count() == 0
