"""Toxicity by cumulative-link ordinal regression: one set of weights, ordered thresholds, expected severity."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 8_000
#: Terms that get a weight, at most: those whose log-odds are furthest from 0, and over LEAST_Z standard errors away.
MAX_TERMS, LEAST_Z = 4096, 2.6
#: A term needs so many different labelled texts; texts count as one if so many minima of hashed terms agree.
MIN_TEXTS, MINIMA = 3, 3
#: Severity grades 0 (not toxic) to GRADES - 1.
GRADES = 4
PENALTY, STEPS = 2.0, 400
TOKEN = regex.compile(r"\p{L}+")


def terms(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: list[float]  # ascending: between grade k and k + 1
    cut: float  # expected severity from which a text counts as toxic

    def severity(self, found: set[str]) -> tuple[float, int]:
        """Expected grade, and the likeliest one."""
        s = sum(self.weights[w] for w in found & self.weights.keys())
        above = [1 / (1 + np.exp(t - s)) for t in self.thresholds]
        chance = -np.diff([1.0, *above, 0.0])
        return float(sum(above)), int(chance.argmax())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a hashed sample of labelled rows of at most max_rows; without toxic rows nothing is toxic.

    The labels only say toxic or not. Grades of toxic texts are thirds of how many marked terms (log-odds over 2) they hold,
    so the thresholds order texts by how much of what makes texts toxic they hold.
    """
    own = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = 1e6 * min(1.0, 0.8 * max_rows / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1_000_000)) < share).limit(max_rows)
    own = F.broadcast(own)  # max_rows rows at most

    def make():
        return lambda x: {"toxic": x["toxic"], "terms": [sorted(terms(t)) for t in x["text"]]}

    rows = common.by_batch(docs.select("doc_id", "text").filter("text is not null").join(own, "doc_id").select(F.col("toxic").cast("int"), "text"), make, "toxic int, terms array<string>").collect()
    # copies and near copies would make terms of one text look telling
    texts: dict[tuple[int, ...], list[tuple[tuple[str, ...], int]]] = {}
    for r in rows:
        if t := tuple(r["terms"]):
            texts.setdefault(tuple(min(xxhash.xxh3_64_intdigest(w, k) for w in t) for k in range(MINIMA)), []).append((t, r["toxic"]))
    data = sorted((min(x)[0], int(2 * sum(y for _, y in x) > len(x))) for x in texts.values())
    y = np.array([b for _, b in data], np.int64)
    n = [Counter(), Counter()]
    for t, b in data:
        n[b].update(t)
    if not data or y.min() == y.max():
        return Model({}, [float("inf")] * (GRADES - 1), float("inf"))
    size = [(y == 0).sum(), y.sum()]
    odds = {w: float(np.log((n[1][w] + 0.5) / (size[1] + 1)) - np.log((n[0][w] + 0.5) / (size[0] + 1))) for w in n[1].keys() | n[0].keys() if n[0][w] + n[1][w] >= MIN_TEXTS}
    z = {w: abs(x) / np.sqrt(1 / (n[0][w] + 0.5) + 1 / (n[1][w] + 0.5)) for w, x in odds.items()}
    best = sorted((w for w in odds if z[w] >= LEAST_Z), key=lambda w: (-z[w], w))[:MAX_TERMS]
    at = {w: i for i, w in enumerate(best)}
    marks = np.array([sum(odds.get(w, 0) > 2 for w in t) for t, _ in data])
    bounds = np.quantile(marks[y == 1], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grade = np.where(y == 1, 1 + (marks[:, None] > bounds).sum(axis=1), 0)
    row = np.concatenate([np.full(len([w for w in t if w in at]), i) for i, (t, _) in enumerate(data)]).astype(np.int64)
    column = np.array([at[w] for t, _ in data for w in t if w in at], np.int64)
    test = np.arange(len(data)) % 4 == 3
    weights, thresholds = cumulative_logit(row, column, grade, len(best), ~test)
    kept = {w: float(weights[i]) for w, i in at.items() if abs(weights[i]) > 1e-4}
    model = Model(kept, [float(t) for t in thresholds], 0.0)
    score = np.array([model.severity(set(t))[0] for t, _ in data])
    part = test if y[test].any() else np.ones(len(y), bool)
    # a text without any weighted term is never toxic
    return Model(kept, model.thresholds, max(best_cut(score[part], y[part]), model.severity(set())[0] + 1e-6))


def cumulative_logit(row, column, grade, n_terms, use) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade > k) = logistic(x.w - threshold k), by Adam on the penalised likelihood of the rows in use."""
    present = [max(1e-3, (grade[use] > k).mean()) for k in range(GRADES - 1)]
    first = -np.log(present[0] / (1 - min(present[0], 0.999)))
    free = np.concatenate(([first], np.log(np.full(GRADES - 2, 0.7))))
    w, weight, state = np.zeros(n_terms), use / max(1, use.sum()), np.zeros((2, n_terms + len(free)))
    for step in range(1, STEPS + 1):
        g = np.concatenate(gradient(w, free, row, column, grade, weight))
        state = np.stack((0.9 * state[0] + 0.1 * g, 0.99 * state[1] + 0.01 * g * g))
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, free = w - move[:n_terms], free - move[n_terms:]
    return w, thresholds_of(free)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds of free numbers: the first one, then the logs of the gaps."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def gradient(w, free, row, column, grade, weight) -> tuple[np.ndarray, np.ndarray]:
    """By the weights and by the free numbers, of - sum(weight * log P(grade)) + PENALTY / 20 / (rows in use) * w.w."""
    n, k, t = len(grade), np.arange(len(grade)), thresholds_of(free)
    s = np.bincount(row, w[column], minlength=n)
    above = np.concatenate((np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40))), np.zeros((n, 1))), axis=1)
    slope = above * (1 - above)
    p = np.maximum(above[k, grade] - above[k, grade + 1], 1e-9)
    ds = -(slope[k, grade] - slope[k, grade + 1]) / p * weight
    g_t = np.zeros((n, GRADES + 1))
    g_t[k, grade] += slope[k, grade] / p * weight
    g_t[k, grade + 1] -= slope[k, grade + 1] / p * weight
    g_t = g_t[:, 1:-1].sum(axis=0)
    g_free = np.cumsum(g_t[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
    return np.bincount(column, ds[row], minlength=len(w)) + PENALTY * w / max(1, (weight > 0).sum()) / 10, g_free


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F-measure, in the middle of its gap."""
    s = np.unique(score)
    cuts = (s[1:] + s[:-1]) / 2
    if not len(cuts):
        return float(s[0]) if len(s) else float("inf")
    cuts = np.unique(np.quantile(cuts, np.linspace(0, 1, 400)))
    f = [2 * (y[score >= c]).sum() / max(1, (score >= c).sum() + y.sum()) for c in cuts]
    near = cuts[np.array(f) >= max(f) - 1e-9]
    return float((near[0] + near[-1]) / 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade, toxic for every row of docs.

    Null and empty texts, and texts without a weighted term, get the severity of the thresholds alone and grade 0. Terms count
    once however often they occur; whole texts of any length are read. Repeated rows each get their row; other columns of
    docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def run(x):
            found = [m.severity(terms(t)) for t in x["text"]]
            return {"doc_id": x["doc_id"], "severity": [f[0] for f in found], "grade": [f[1] for f in found], "toxic": [f[0] >= m.cut for f in found]}

        return run

    return common.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, severity double, grade int, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
