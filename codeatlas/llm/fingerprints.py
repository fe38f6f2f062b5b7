"""I-Match fingerprints: terms within a band of inverse document frequency, sorted and hashed over randomised lexicon subsets."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import SPACED
from .near_dedup import MUL, Hashes, mixed

U = np.uint64
#: The lexicon is a bitmap of hashed terms with SPACE bits or more for each of its terms, so that a term that isn't in it
#: passes with probability 1 / SPACE at most; up to 2 ** MAX_BITS bits (128 MB, enough for 67 million terms).
SPACE, MIN_BITS, MAX_BITS = 16, 16, 30
#: Distinct terms that a task counts before it passes them on, and bits of the bitmap that a row holds.
FLUSH, BLOCK_BITS = 1_000_000, 16
#: The band: terms in at least MIN_DOCS documents and in at most this share of all.
MIN_DOCS, MAX_SHARE = 2, 0.1
#: A subset of a level holds a term with probability 1 in 2 * DENSITY ** level (5 to 488), whatever the document.
LEVELS, SUBSETS, DENSITY = 6, 16, 2.5
#: A level tells documents apart if at least so many of its subsets hold a term of either.
FILLED = 8
SEEDS = mixed(np.arange(1, LEVELS * SUBSETS + 1, dtype=U) * MUL[0])
LEAST = np.repeat(np.array([int(2**64 / (2 * DENSITY**k)) for k in range(1, LEVELS + 1)], U), SUBSETS)


def terms(text: str, seen: Hashes) -> np.ndarray:
    """Sorted hashes of a text's distinct terms: lower-cased runs of letters and digits."""
    own = set(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split())
    return np.sort(np.fromiter(map(seen.__getitem__, own), U, len(own)))


@dataclass(frozen=True)
class Lexicon:
    """The terms within the band: a bitmap by the first bits of their hashes, and the terms above the band, which never pass."""

    bitmap: np.ndarray
    bits: int
    common: np.ndarray

    def kept(self, h: np.ndarray) -> np.ndarray:
        """Those of sorted hashes that are in the lexicon."""
        slot = h >> U(64 - self.bits)
        h = h[(self.bitmap[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1]
        if not len(self.common):
            return h
        return h[self.common[np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)] != h]


def fingerprint(text: str, lexicon: Lexicon, seen: Hashes) -> tuple[int, np.ndarray]:
    """Hash of all kept terms, and of those in each lexicon subset (0: none). Without a kept term, the hash of the text itself."""
    h = lexicon.kept(terms(text, seen))
    if not len(h):
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), 9), np.zeros(len(SEEDS), np.uint32)
    drawn = mixed(h ^ SEEDS[:, None])
    inside = np.flatnonzero(drawn < LEAST[:, None])
    n = np.bincount(inside // len(h), minlength=len(SEEDS))
    some, sums = np.flatnonzero(n), np.zeros(len(SEEDS), U)
    if len(some):
        # the sum of the hashes of sorted distinct terms is the same as a hash of their list
        sums[some] = np.add.reduceat(mixed(drawn.ravel()[inside] + MUL[1]), (np.cumsum(n) - n)[some])
    part = mixed(sums) >> U(40)
    return int(mixed(mixed(h + MUL[2]).sum(keepdims=True, dtype=U))[0]), np.where(n > 0, np.maximum(part, U(1)), U(0)).astype(np.uint32)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal fingerprints; else the greatest share of equal subsets on a level with FILLED subsets that hold a term, or on all levels together."""
    if a[0] == b[0] and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].reshape(LEVELS, SUBSETS), b[1].reshape(LEVELS, SUBSETS)
    filled = (x | y) != 0
    n, same = filled.sum(axis=1), ((x == y) & filled).sum(axis=1)
    if (n >= FILLED).any():
        return float((same / np.maximum(n, 1))[n >= FILLED].max())
    return float(same.sum() / n.sum()) if n.sum() else 0.0


def printed(f: tuple[int, np.ndarray]) -> str:
    return f"{f[0]:016x}:{f[1].astype('>u4').view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()}"


def frequencies(docs: DataFrame) -> DataFrame:
    """term (hash), n: the document frequency of every term in MIN_DOCS documents or more, counted over all documents."""

    def run(batches):
        seen, found, total = Hashes(), [], 0
        done = np.zeros(0, U), np.zeros(0, np.int32)

        def merged():
            own, of = np.unique(np.concatenate([done[0], *found]), return_inverse=True)
            weights = np.concatenate([done[1], np.ones(total, np.int32)])
            found.clear()
            return own, np.bincount(of, weights, len(own)).astype(np.int32)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(done[0].view(np.int64)), pa.array(done[1])], ["term", "n"])

        for batch in batches:
            for part in common.slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        found.append(terms(text, seen))
                        total += len(found[-1])
                        if total > FLUSH:
                            done, total = merged(), 0
                            if len(done[0]) > FLUSH:
                                yield out()
                                done = np.zeros(0, U), np.zeros(0, np.int32)
        done = merged()
        yield out()

    counts = common.mapped(docs.select("text"), run, "term long, n int").groupBy("term").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= MIN_DOCS)


def lexicon(docs: DataFrame) -> Lexicon:
    """The terms in MIN_DOCS documents or more and in a MAX_SHARE of all at most, by exact counts; the bitmap grows with their number."""
    most = max(MIN_DOCS, int(MAX_SHARE * docs.count()))
    counts = common.cut(frequencies(docs), "terms")
    inside = counts.filter(F.col("n") <= most)
    bits = min(MAX_BITS, max(MIN_BITS, (SPACE * inside.count() - 1).bit_length()))

    def packed(group):
        block = np.zeros(1 << BLOCK_BITS, np.uint8)
        block[group["slot"].to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        return type(group)({"block": group["block"].iloc[:1], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    common.share_code(docs.sparkSession)
    slot = F.shiftrightunsigned("term", 64 - bits).alias("slot")
    # a group has 2 ** BLOCK_BITS different slots at most
    rows = inside.select(slot).distinct().select("slot", F.shiftright("slot", BLOCK_BITS).alias("block"))
    found = rows.groupBy("block").applyInPandas(packed, "block long, bits binary").toArrow()
    size = 1 << BLOCK_BITS >> 3
    bitmap = np.zeros((1 << bits) >> 3, np.uint8)
    for block, part in zip(found.column("block").to_pylist(), found.column("bits"), strict=True):
        bitmap[block * size : (block + 1) * size] = np.frombuffer(part.as_buffer(), np.uint8)
    # terms above the band: their shares add up to a document's mean number of terms, so there are 1 / MAX_SHARE times that at most
    above = np.sort(counts.filter(F.col("n") > most).select("term").toArrow().column("term").to_numpy().view(U))
    common.drop(counts)
    return Lexicon(bitmap, bits, above)


def in_order(docs: DataFrame) -> DataFrame:
    """part, peek, doc_id, text: documents dealt by ranges of doc_id, in each part by descending doc_id, and last (peek) the document that follows the part."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    docs = docs.withColumn("part", F.coalesce(part, F.lit(0)))
    tops = sorted((r["part"], r["top"]) for r in docs.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    # below the least document of a part follows the greatest of the part below; below the least of all, the greatest of all
    after = spark.createDataFrame([(tops[k - 1][1], p) for k, (p, _) in enumerate(tops)], "top long, to int")
    copied = docs.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("top"))).select(F.col("to").alias("part"), F.lit(1).alias("peek"), "doc_id", "text")
    rows = docs.select("part", F.lit(0).alias("peek"), "doc_id", "text").union(copied)
    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "peek", F.desc("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The query's columns for every row of docs.

    A null text is empty. A text without a term in the band, so an empty one too, has its own hash for a fingerprint and is
    like equal texts only. A term outside the band passes for one within with probability 1 / SPACE at most (more beyond 67
    million terms), the same for all documents. Rows that share a doc_id follow each other in order of text; a null doc_id comes last. The only
    document follows itself. Other columns of docs are ignored. Texts are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        seen, kept, last = Hashes(), sent.value, None
        for batch in batches:
            for part in common.slices(batch):
                out = {n: [] for n in names}
                for of, peek, doc, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    own = fingerprint(text, kept, seen)
                    if last is not None and last[0] == of:
                        _, before, old, f = last
                        half = len(old) // 2
                        edited = old[: len(old) - half] + text[:half]
                        g = fingerprint(edited, kept, seen)
                        row = (before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), printed(f), printed(g), likeness(f, g), likeness(f, own))
                        for n, x in zip(names, row, strict=True):
                            out[n].append(x)
                    last = None if peek else (of, doc, text, own)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return common.mapped(in_order(docs), run, schema) if not docs.isEmpty() else docs.sparkSession.createDataFrame([], schema)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
