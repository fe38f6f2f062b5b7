"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 4
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: A bucket of more sets than this that its star leaves in several components is tested in blocks of BLOCK sets.
SMALL, BLOCK = 8, 128
CACHE = 200_000
U = np.uint64
MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U)


class Hashes(dict):
    """64-bit hash of a word's bytes, kept up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        return self.setdefault(word, xxhash.xxh3_64_intdigest(word))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def shingles(text: str | None, seen: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the 4-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(seen.__getitem__, words), U, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        out = mixed(out + h[i : len(h) - n + 1 + i] * MUL[i])
    return np.unique(out)


def bounds() -> np.ndarray:
    return np.array([(i << 64) // BINS for i in range(BINS)], U)


def signature(s: np.ndarray, starts: np.ndarray, full: np.uint64 = U(0)) -> np.ndarray:
    """Least hash of each of BINS equal ranges of a sorted set; an empty bin borrows from bins that a hash of (bin, try) names until one is full."""
    at = np.searchsorted(s, starts)
    filled = np.append(at[1:], len(s)) > at
    own = s[np.minimum(at, len(s) - 1)]
    if filled.all():
        return own
    empty, out, k = np.flatnonzero(~filled), own.copy(), 0
    if filled.sum() == 1:
        return np.full(BINS, own[filled][0], U)
    while len(empty):
        k += 1
        probe = (mixed(empty.astype(U) * MUL[0] + U(k * int(MUL[1]) % (1 << 64))) % U(BINS)).astype(np.int64)
        got = filled[probe]
        out[empty[got]] = own[probe[got]]
        empty = empty[~got]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U) * MUL[2] + U(1)
    for column in sig.reshape(BANDS, ROWS).T:
        key = mixed(key * MUL[3] + column)
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text where doc_id is null), n_shingles, cid (hash of the set; null if empty), bands."""

    def make():
        seen, starts = Hashes(), bounds()

        def run(x):
            out = {"doc_id": x["doc_id"], "row": x["row"], "n_shingles": [], "cid": [], "bands": []}
            for text in x["text"]:
                s = shingles(text, seen)
                out["n_shingles"].append(len(s))
                out["cid"].append(set_id(s) if len(s) else None)
                out["bands"].append(band_keys(signature(s, starts)) if len(s) else None)
            return out

        return run

    docs = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("row"), "text")
    return common.by_batch(docs, make, "doc_id long, row long, n_shingles long, cid long, bands array<long>")


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def sets(docs: DataFrame) -> DataFrame:
    def make():
        seen = Hashes()

        def run(x):
            found = [s for s in (shingles(t, seen) for t in x["text"]) if len(s)]
            return {"cid": [set_id(s) for s in found], "size": [len(s) for s in found], "hashes": [s.view(np.int64) for s in found]}

        return run

    return common.by_batch(docs.select("text"), make, "cid long, size int, hashes array<long>")


def linked(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Of pairs a, b those with 100 * intersection >= 80 * union of their full sets.

    Pairs whose sizes alone are too far apart go before any set is fetched; a set that many pairs share is dealt with them.
    """
    size = full.select("cid", "size")
    sized = common.spread(pairs, size.select(F.col("cid").alias("a"), F.col("size").alias("nx")), "a").join(size.select(F.col("cid").alias("b"), F.col("size").alias("ny")), "b")
    near = common.cut(sized.filter(100 * F.least("nx", "ny") >= 80 * F.greatest("nx", "ny")).select("a", "b"), "near")
    both = common.spread(near, full.select(F.col("cid").alias("a"), F.col("hashes").alias("x")), "a").join(full.select(F.col("cid").alias("b"), F.col("hashes").alias("y")), "b")
    both = both.withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("both") >= 80 * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """cid, label (least cid that it reaches) for every end of an edge a, b.

    Each node hooks to its least lesser neighbour, the trees are flattened by doubling, and the edges are contracted to edges
    between roots, until none is left: edges are joined while they are many only once.
    """
    pairs = common.cut(edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "pairs")
    labels = common.cut(pairs.select(F.explode(F.array("low", "high")).alias("cid")).distinct().withColumn("label", F.col("cid")), "labels")
    while not pairs.isEmpty():
        up = common.cut(pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "hooks")
        old = [pairs, labels, up]
        while True:
            on = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            flat = common.cut(common.spread(up, on, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "hooks")
            old.append(flat)
            up = flat.select("node", "root")
            if flat.filter("moved").isEmpty():
                break
        root = lambda df, name: common.spread(df, up.select(F.col("node").alias(name), F.col("root").alias("r")), name, "left").withColumn(name, F.coalesce("r", name)).drop("r")
        labels = common.cut(root(labels, "label"), "labels")
        pairs = root(root(pairs, "low"), "high").filter("low <> high")
        pairs = common.cut(pairs.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct(), "pairs")
        common.drop(*old)
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after further links."""
    return components(labels.filter("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b")).unionByName(links))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets of three or more that still hold several components."""
    now = common.cut(members.filter("n > 2").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "now")
    several = now.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return common.spread(now, several, "key")


def groups(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups whose sets are to be compared with each other (cid, label, group), and the crowds that are such groups whole (cid, crowd).

    A crowd is what buckets that share sets make up. It is compared whole, or bucket by bucket (those of the same sets once),
    whichever makes fewer pairs.
    """
    star = wide.filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    crowds = components(star).withColumnRenamed("label", "crowd")
    own = common.cut(wide.select("key", "cid", "label").join(crowds, "cid"), "wide")
    buckets = own.groupBy("crowd", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sets"))
    buckets = common.cut(buckets.groupBy("crowd", "n", "sets").agg(F.min("key").alias("key")), "buckets")
    apart = buckets.groupBy("crowd").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    size = crowds.groupBy("crowd").agg(F.count("*").alias("size"))
    whole = common.cut(size.join(apart, "crowd").filter("size * size <= apart").select("crowd"), "whole")
    at_once = crowds.join(whole, "crowd", "left_semi")
    one = own.join(whole, "crowd", "left_semi").select("cid", "label", F.col("crowd").alias("group")).distinct()
    keys = buckets.join(whole, "crowd", "left_anti").select("key")
    return one.unionByName(common.spread(own, keys, "key").select("cid", "label", F.col("key").alias("group"))), at_once


def in_blocks(own: DataFrame, full: DataFrame) -> DataFrame:
    """Links between any two of the same group (cid, label, group) whose labels differ: block against block of about BLOCK sets, as products of incidence matrices.

    Sets are in classes by size, each 1.25 times the last, so that only those of neighbouring classes can be linked. The
    pairs are tested within a task and never become rows; a row is copied once for each block of its class and the next.
    """
    common.share_code(own.sparkSession)
    # 0.8 is 100 / 125: sizes of classes that aren't neighbours differ by more than that ratio
    classed = own.join(full.select("cid", "size"), "cid").withColumn("class", F.floor(F.log("size") / F.log(F.lit(1.25)) + 1e-9).cast("int"))
    size = common.cut(classed.groupBy("group", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    up = size.select("group", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    down = size.select("group", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    size = size.join(up, ["group", "class"], "left").join(down, ["group", "class"], "left").na.fill(0, ["above", "below"])
    dealt = classed.join(size, ["group", "class"]).withColumn("nth", F.pmod(F.xxhash64(F.lit(8), "cid"), F.col("blocks")).cast("int"))
    block = lambda of, i: F.struct(of.alias("of"), i.cast("int").alias("nth"))
    # meetings of a block with those of its class, those above, and those below
    with_own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(block(F.col("class"), F.least(F.col("nth"), i)).alias("i"), block(F.col("class"), F.greatest(F.col("nth"), i)).alias("j")))
    with_up = F.transform(F.filter(F.sequence(F.lit(0), F.col("above")), lambda i: i < F.col("above")), lambda i: F.struct(block(F.col("class"), F.col("nth")).alias("i"), block(F.col("class") + 1, i).alias("j")))
    with_down = F.transform(F.filter(F.sequence(F.lit(0), F.col("below")), lambda i: i < F.col("below")), lambda i: F.struct(block(F.col("class") - 1, i).alias("i"), block(F.col("class"), F.col("nth")).alias("j")))
    dealt = dealt.select("cid", "label", "group", block(F.col("class"), F.col("nth")).alias("own"), F.explode(F.concat(with_own, with_up, with_down)).alias("x"))
    dealt = dealt.select("cid", "label", "group", F.xxhash64("own").alias("own"), F.xxhash64("x.i").alias("i"), F.xxhash64("x.j").alias("j"))

    def test(t):
        x = [np.asarray(v, np.int64) for v in t["hashes"]]
        label, block, cid = t["label"].to_numpy(), t["own"].to_numpy(), t["cid"].to_numpy()
        size = np.array([len(v) for v in x], np.int64)
        row = np.repeat(np.arange(len(x)), size)
        terms, column = np.unique(np.concatenate(x), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(x), len(x)), np.float32)
        for at in range(0, len(terms), 8192):
            lo, hi = np.searchsorted(column, (at, at + 8192))
            m = np.zeros((len(x), min(8192, len(terms) - at)), np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
        n = both.round().astype(np.int64)
        near = 100 * n >= 80 * (size[:, None] + size[None, :] - n)
        near &= (label[:, None] != label[None, :]) & (cid[:, None] < cid[None, :])
        if t["i"].iloc[0] != t["j"].iloc[0]:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        return type(t)({"a": cid[a], "b": cid[b]})

    return common.spread(dealt, full.select("cid", "hashes"), "cid").groupBy("group", "i", "j").applyInPandas(test, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Nodes are the distinct sets, so exact copies cost one node however many there are. In each bucket the least node is the
    centre of a star of candidate edges; links are confirmed on full sets. Buckets that their stars leave in several
    components are settled exactly: large ones, bucket by bucket or joined into crowds where they share sets, block against
    block in `in_blocks`; small ones by the pairs whose ends are in different components and not in one crowd that was
    compared whole. So no pair of a bucket goes untested unless its ends are already connected.
    A null, empty or blank text has an empty set, no links and is its own component. Repeated rows are copies of each other.
    Rows with a null doc_id link others as any row does; they are kept only if no row of their component has an id, and the
    component's id is null then.
    Other columns of docs are ignored.
    """
    return found(docs).drop("row")


def found(docs: DataFrame) -> DataFrame:
    """`near_duplicates` with row: a hash of the text where doc_id is null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = common.cut(sign(docs), "signed")
    classes = common.cut(signed.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.any_value("bands").alias("bands")), "classes")
    rows = classes.select("cid", F.explode("bands").alias("key"))
    shared = common.cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("cid").alias("centre")).filter("n > 1"), "shared")
    members = common.cut(common.spread(rows, shared, "key").select("key", "cid", "n", "centre"), "members")

    wanted = members.select("cid").distinct().join(classes, "cid").select("cid", F.col("least").alias("doc_id"))
    wanted = common.cut(wanted, "wanted")
    own = sets(common.by_ids(docs, wanted.filter("doc_id is not null").select("doc_id"), "left_semi"))
    nameless = wanted.filter("doc_id is null").select("cid")
    if not nameless.isEmpty():  # sets that only rows without an id hold
        own = own.unionByName(sets(docs.filter("doc_id is null")).join(nameless, "cid", "left_semi"))
    full = common.cut(own.dropDuplicates(["cid"]), "sets")

    tested = common.cut(members.filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct(), "tested")
    labels = components(linked(tested, full))
    left = common.cut(unsettled(members, labels), "unsettled")
    own, crowds = groups(left.filter(F.col("n") > SMALL))
    more = common.cut(in_blocks(common.cut(own, "groups"), full), "links")
    if not more.isEmpty():
        labels = joined(labels, more)
    slim = unsettled(members.filter(F.col("n").between(3, SMALL)), labels).join(crowds, "cid", "left")
    slim = common.cut(slim.select("key", "cid", "centre", "label", F.coalesce("crowd", "cid").alias("crowd")), "slim")
    other = slim.filter("cid <> centre").select("key", F.col("cid").alias("a"), F.col("label").alias("of"), F.col("crowd").alias("at"))
    pairs = slim.filter("cid <> centre").join(other, "key").filter("a < cid and label <> of and crowd <> at").select("a", F.col("cid").alias("b")).distinct()
    more = common.cut(linked(common.cut(pairs, "pairs"), full), "links")
    if not more.isEmpty():
        labels = joined(labels, more)

    of = classes.select("cid", "least").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    of = common.cut(common.spread(of.select("cid", "label"), least, "label").select("cid", "component_id"), "components")
    common.drop(shared, members, wanted, full, tested, left, slim, more)
    out = common.spread(signed.select("doc_id", "row", "n_shingles", "cid"), of, "cid", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id, with all rows that repeat it. A row with a null doc_id stays if no row of its group has an id, so null, empty and blank texts all stay."""
    gone = common.cut(found(docs).filter(~F.col("kept")).select("doc_id", "row").distinct(), "gone")
    left = common.by_ids(docs, gone.filter("doc_id is not null").select("doc_id"), "left_anti")
    texts = gone.filter("doc_id is null").select(F.col("row").alias("row_"))
    if texts.isEmpty():
        return left
    return left.join(texts, left["doc_id"].isNull() & (F.xxhash64(left["text"]) == texts["row_"]), "left_anti")
