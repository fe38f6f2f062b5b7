"""Language ID by nearest centroid: TF-IDF vectors of hashed character n-grams against several centroids a language."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 8192
#: Labelled rows that the classifier is fitted on, at most, for each language.
MAX_PER_LANG = 400
#: Languages that the classifier knows, at most: those of the most rows. Each takes 128 KB of the model that workers hold.
MAX_LANGS = 1000
CLUSTERS = 4
#: Letters of the shortened texts that the rejection distance is fitted on, beside whole texts.
LENGTHS = (16, 64, 256)
#: A text is rejected if its cosine is below what FOREIGN of the fitted texts of its size reach with centroids of languages
#: other than their own, as texts of an unknown language do; but never above SLACK times the least that whole fitted texts
#: have, nor what all but LOW of the shortened ones have; LONE times the least of both for a single language, and for texts
#: of under 32 letters, which can't be told from foreign ones.
FOREIGN, SLACK, LOW, LONE = 0.95, 0.9, 0.01, 0.6
MULT = np.uint64(0x9E3779B97F4A7C15)
_alpha: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one 0; starts and ends with 0. Empty without a letter."""
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate(([0], np.where(_alpha[a], a, 0), [0])).astype(np.uint32)
    keep = a != 0
    if not keep.any():
        return a[:0]
    keep[1:] |= a[:-1] != 0
    keep[0] = True
    return a[keep]


def counts(a: np.ndarray) -> np.ndarray:
    """Counts of 1-, 2- and 3-grams in DIM hashed bins."""
    shift = np.uint64(64 - DIM.bit_length() + 1)
    one = a.astype(np.uint64)
    two = (one[:-1] << np.uint64(21)) | one[1:]
    three = (two[:-1] << np.uint64(21)) | one[2:]
    grams = np.concatenate((one[one != 0], two + np.uint64(1 << 60), three))
    return np.bincount(((grams * MULT) >> shift).astype(np.int64), minlength=DIM)


@dataclass(frozen=True)
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: list[float]  # by size class: below that cosine a text is rejected

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows, dtype=np.float32)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether the text is rejected, of each text."""
        out = [("und", 0.0, True)] * len(texts)
        found = [(i, a) for i, t in enumerate(texts) if t and len(a := letters(t))]
        for at in range(0, len(found) if self.langs else 0, 128):
            part = found[at : at + 128]
            cosine = self.vectors(np.stack([counts(a) for _, a in part])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            for (i, a), k, row in zip(part, best, cosine, strict=True):
                out[i] = (self.langs[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.floor[size_class(len(a))]))
        return out


def size_class(n: int) -> int:
    return sum(n >= 2 * x for x in LENGTHS)


def sampled(docs: DataFrame, max_per_lang: int, max_langs: int = MAX_LANGS) -> DataFrame:
    """Training rows: about max_per_lang of each language by a hash of id and text, and never more than twice that in all.

    Of more than max_langs languages those with the most rows are taken (ties by name); rows of the rest take no part.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = rows.groupBy("lang").agg((F.lit(1e6 * max_per_lang) / F.count("*")).alias("share"))
    mark = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1_000_000))
    spark = docs.sparkSession
    shares = {r["lang"]: r["share"] for r in share.orderBy("share", "lang").limit(max_langs).collect()}
    if not shares:
        return rows.limit(0)
    of = spark.createDataFrame(list(shares.items()), "lang string, share double")
    return rows.join(F.broadcast(of), "lang").filter(mark < F.col("share")).select("lang", "text").limit(2 * max_per_lang * len(shares))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_per_lang: int = MAX_PER_LANG, clusters: int = CLUSTERS, max_langs: int = MAX_LANGS) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out; without any, the model knows no language and predicts `und`.

    The model knows the max_langs languages with the most rows: a text of another gets the nearest of them, or is rejected.
    Executors fit each language's centroids in a task of its own and the cosines for the rejection; the driver gets the
    finished centroids alone.
    """

    def make():
        def run(x):
            out = {"lang": [], "size": [], "at": [], "n": []}
            for lang, text in zip(x["lang"], x["text"], strict=True):
                a = letters(text)
                for size, b in enumerate([*(a[:k] for k in LENGTHS), a]):
                    if len(b) and (size == len(LENGTHS) or len(a) > LENGTHS[size]):
                        c = counts(b)
                        at = np.flatnonzero(c)
                        for k, v in (("lang", lang), ("size", size if size < len(LENGTHS) else -1), ("at", at.astype(np.int32)), ("n", c[at].astype(np.int32))):
                            out[k].append(v)
            return out

        return run

    spark = docs.sparkSession
    rows = common.cut(common.by_batch(sampled(docs, max_per_lang, max_langs), make, "lang string, size int, at array<int>, n array<int>"), "samples")
    whole = rows.filter("size < 0")
    n, present = whole.count(), np.zeros(DIM)
    for r in whole.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # DIM rows at most
        present[r["at"]] = r["count"]
    idf = (np.log((1 + n) / (1 + present)) + 1).astype(np.float32)
    model = Model([], np.zeros((0, DIM), np.float32), idf, [0.0] * (len(LENGTHS) + 1))
    if not n:
        common.drop(rows)
        return model

    def cluster(group):
        group = group.assign(key=[(len(a), bytes(a), bytes(c)) for a, c in zip(group["at"], group["n"], strict=True)]).sort_values("key")
        found = spherical(model.vectors(dense(group["at"], group["n"])), clusters)
        return type(group)({"lang": [group["lang"].iloc[0]] * len(found), "k": range(len(found)), "centroid": list(found)})

    # about 2 * max_per_lang rows a group at most
    fitted = whole.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid array<float>").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    langs = fitted.column("lang").to_pylist()
    centroids = fitted.column("centroid").combine_chunks().flatten().to_numpy().reshape(-1, DIM)
    model = Model(langs, centroids, idf, model.floor)
    floor = floors(rows, spark.sparkContext.broadcast(model))
    common.drop(rows)
    return Model(langs, centroids, idf, floor)


def dense(at, n) -> np.ndarray:
    x = np.zeros((len(at), DIM), np.float32)
    for i, (a, c) in enumerate(zip(at, n, strict=True)):
        x[i, np.asarray(a, np.int64)] = c
    return x


def floors(rows: DataFrame, sent) -> list[float]:
    """The cosine of rejection of each size class, from the samples' cosines with all centroids and with those of other languages."""

    def make():
        model = sent.value
        of = np.array(model.langs)

        def run(x):
            out = {"class": [], "whole": [], "own": [], "foreign": []}
            for at in range(0, len(x["lang"]), 128):
                part = {k: v[at : at + 128] for k, v in x.items()}
                cosine = model.vectors(dense(part["at"], part["n"])) @ model.centroids.T
                others = np.where(np.array(part["lang"])[:, None] != of, cosine, -1.0).max(axis=1)
                out["whole"] += [size < 0 for size in part["size"]]
                out["class"] += [size_class(sum(n) // 3) for n in part["n"]]
                out["own"] += cosine.max(axis=1).astype(float).tolist()
                out["foreign"] += [float(v) if v >= 0 else None for v in others]
            return out

        return run

    best = common.by_batch(rows, make, "class int, whole boolean, own double, foreign double")
    part = F.when(~F.col("whole"), F.col("own"))
    seen = best.groupBy("class").agg(
        F.min("own").alias("least"), F.min(F.when(F.col("whole"), F.col("own"))).alias("whole"), F.percentile_approx(part, LOW, 10_000).alias("part"), F.percentile_approx("foreign", FOREIGN, 10_000).alias("foreign")
    )
    out = [0.0] * (len(LENGTHS) + 1)  # a text of a class that no sample is in isn't rejected
    for r in seen.collect():
        if r["class"] == 0 or r["foreign"] is None:
            out[r["class"]] = LONE * min(r["least"], 0.9 if r["class"] else 1.0)
        else:
            out[r["class"]] = min(x for x in (r["foreign"], SLACK * r["whole"] if r["whole"] else None, r["part"]) if x is not None)
    return out


def spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows by k-means on cosine; starts from rows far from each other."""
    seeds = [0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        c = np.stack([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs.

    A null or letterless text is `und` with score 0 and rejected. Ties take the first centroid in order of language.
    Whole texts of any length count. Repeated rows each get their row; other columns of docs are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(x):
            found = sent.value.predict(x["text"])
            return {"doc_id": x["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

        return run

    return common.by_batch(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that aren't rejected. Null, blank and letterless texts are rejected; without labels, so is every text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in common.slices(batch):
                keep = [not f[2] for f in model.value.predict(part.column(names.index("text")).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return common.mapped(docs, run, docs.schema)
