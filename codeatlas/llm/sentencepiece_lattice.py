"""SentencePiece encoding and decoding over a relational lattice of the distinct words.

Substrings of bounded length are exploded, joined to the piece table and grouped by word; a higher-order aggregate folds
each word's lattice to its best path: Viterbi over the piece scores for a unigram model, the merge order for a BPE model.
Words too long for the aggregate's state are folded by the same rules where their text is encoded.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dedup import mixed

#: A public model: BPE with byte fallback, identity normalisation, a space put before the text.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longest word that is folded in one state word; longer ones without a seam are folded by `Folder`.
MAX_WORD = 48
#: Words whose ids are broadcast, at most: the most frequent (about 20 bytes each), and how many of them the driver holds
#: at once. All others are joined.
HOT_WORDS, SHARD = 4_000_000, 250_000
#: Characters of long words whose paths a task keeps.
KEPT = 1 << 20
#: Distinct words that a task counts before it passes them on, and bytes of text that it counts and encodes at once.
FLUSH, SLICE, ENCODED = 250_000, 1 << 20, 1 << 18
#: Words of a task whose edges are grouped in memory; a task with more sorts them.
GROUPED = 500_000
LOW = (1 << 6) - 1
#: Base of the words' polynomial hash.
BASE = 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces in order of score (best first, ties by id) as (piece, id, score), and ids of the bytes."""

    def __init__(self, path: str = MODEL, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        found = [(model.id_to_piece(i), i, model.get_score(i)) for i in own]
        self.set(found, kind, {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)})

    @classmethod
    def of(cls, pieces: list[tuple[str, int, float]], kind: str, byte_ids: dict[int, int]) -> Vocabulary:
        self = cls.__new__(cls)
        self.set(pieces, kind, byte_ids)
        return self

    def set(self, pieces, kind, byte_ids) -> None:
        self.kind, self.byte_ids = kind, byte_ids
        self.pieces = sorted(pieces, key=lambda p: (-p[2], p[1]))
        self.longest = max((len(p) for p, _, _ in self.pieces), default=1)
        self.chars = sorted({c for p, _, _ in self.pieces for c in p} & {p for p, _, _ in self.pieces})
        at = {c: i + 1 for i, c in enumerate(self.chars)}
        n = len(self.chars) + 1
        self.pairs = np.array(sorted({at[a] * n + at[b] for p, _, _ in self.pieces for a, b in zip(p, p[1:]) if a in at and b in at}), np.int64)

    def bytes_of(self) -> dict[int, bytes]:
        return {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.encode() for p, i, _ in self.pieces}


@dataclass
class Words:
    """The words of several texts end to end in one string: bounds (one more than words), hashes, whether a word is a
    character without a piece, and the words before each text and after the last."""

    string: str
    codes: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    lone: np.ndarray
    of_text: np.ndarray

    def word(self, i: int) -> str:
        return self.string[self.bounds[i] : self.bounds[i + 1]]

    def long(self) -> np.ndarray:
        """Whether each word is too long for one state word."""
        return np.diff(self.bounds) > MAX_WORD


class Splitter:
    """Cuts texts wherever no piece holds both neighbours, so that no piece is lost; a character without a piece stands alone."""

    def __init__(self, v: Vocabulary):
        self.n = len(v.chars) + 1
        self.at = np.zeros(0x110000, np.int32)
        self.at[[ord(c) for c in v.chars]] = np.arange(1, self.n)
        self.joined = np.zeros(self.n * self.n, bool)
        self.joined[v.pairs] = True
        self.powers = np.zeros((2, 0), np.uint64)

    def split(self, texts: list[str | None]) -> Words:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        s = "".join(marked)
        codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.concatenate(([0], np.cumsum([len(m) for m in marked], dtype=np.int64)))
        k = self.at[codes]
        cut = np.ones(len(s) + 1, bool)
        cut[1:-1] = ~self.joined[k[:-1] * self.n + k[1:]] if len(s) else True
        cut[ends] = True
        bounds = np.flatnonzero(cut)
        if not len(s):
            bounds = np.zeros(1, np.int64)
        lone = (np.diff(bounds) == 1) & (k[bounds[:-1]] == 0) if len(s) else np.zeros(0, bool)
        return Words(s, codes, bounds, self.hashes(codes, bounds), lone, np.searchsorted(bounds, ends))

    def hashes(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs of codes between bounds, from sums of code times power that all runs share."""
        if self.powers.shape[1] <= len(codes):
            grow = lambda x: np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(len(codes) + (1 << 18), x, np.uint64))))
            self.powers = np.stack((grow(BASE), grow(pow(BASE, -1, 1 << 64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[0, : len(codes)], dtype=np.uint64)))
        return mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * self.powers[1, bounds[:-1]])


def words(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """word, n: the distinct words of all texts, but for long ones and characters without a piece, and how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        splitter, names, counts = Splitter(sent.value), {}, {}

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(names.values()), pa.string()), pa.array([counts[h] for h in names], pa.int64())], ["word", "n"])
            names.clear()
            counts.clear()
            return batch

        for batch in batches:
            for part in common.slices(batch, SLICE):
                w = splitter.split(part.column(0).to_pylist())
                own, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                known = ~(w.lone | w.long())[first]
                for h, i, c in zip(own[known].tolist(), first[known].tolist(), n[known].tolist(), strict=True):
                    if h in counts:
                        counts[h] += c
                    else:
                        counts[h], names[h] = c, w.word(i)
                if len(names) > FLUSH:
                    yield out()
        yield out()

    return common.mapped(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shifted(x: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x).cast("long") if isinstance(x, int) else x, by.cast("int"))


def merged(word: Column, edges: Column) -> Column:
    """Final pieces of a BPE model: the order of each, or -1 - c for a single character c. An edge is order << 12 | start << 6 | length.

    The state has a bit for each boundary. Edges come best first; one is applied if both its ends are boundaries and exactly
    one lies between them: then its halves are pieces, and it is the best merge that is left.
    """
    size = F.length(word)
    start = lambda e: F.shiftright(e, 6).bitwiseAND(LOW)
    end = lambda e: start(e) + e.bitwiseAND(LOW)
    ends = lambda e: shifted(1, start(e)).bitwiseOR(shifted(1, end(e)))
    inner = lambda e: shifted(1, end(e)) - shifted(2, start(e))

    def step(b, e):
        fits = (b.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(b.bitwiseAND(inner(e))) == 1)
        return F.when(fits, b - b.bitwiseAND(inner(e))).otherwise(b)

    bounds = F.aggregate(F.array_sort(edges), shifted(1, size + 1) - 1, step)

    def pieces(b):
        kept = F.filter(edges, lambda e: (e.bitwiseAND(LOW) > 1) & (b.bitwiseAND(ends(e)) == ends(e)) & (b.bitwiseAND(inner(e)) == 0))
        long = F.transform(kept, lambda e: F.struct(start(e).cast("int").alias("start"), F.shiftright(e, 12).cast("int").alias("order")))
        places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: b.bitwiseAND(shifted(3, i)) == shifted(3, i))
        single = F.transform(places, lambda i: F.struct(i.alias("start"), (-1 - F.ascii(F.substring(word, i + 1, F.lit(1)))).alias("order")))
        return F.transform(F.array_sort(F.concat(long, single)), lambda x: x["order"])

    return F.transform(F.array(bounds), pieces)[0]


def viterbi(edges: Column, size: Column, scores: Column) -> Column:
    """The path of the greatest sum of scores through the lattice (ties: the longer last piece), as the orders of its pieces."""
    start = lambda e: F.shiftright(e, 6).bitwiseAND(LOW)
    end = lambda e: start(e) + e.bitwiseAND(LOW)
    node = lambda score, path: F.struct(score.alias("score"), path.alias("path"))
    none = F.lit(float("-inf"))
    empty = F.slice(F.array(F.lit(0)), 1, 0)

    def reach(nodes, p):
        def better(best, e):
            old = F.element_at(nodes, (start(e) + 1).cast("int"))
            order = F.shiftright(e, 12).cast("int")
            score = old["score"] + F.element_at(scores, order + 1)
            return F.when(score > best["score"], node(score, F.concat(old["path"], F.array(order)))).otherwise(best)

        own = F.array_sort(F.filter(edges, lambda e: end(e) == p), lambda a, b: (start(a) - start(b)).cast("int"))
        return F.concat(nodes, F.array(F.aggregate(own, node(none, empty), better)))

    first = F.array(node(F.lit(0.0), empty))
    return F.aggregate(F.sequence(F.lit(1), size), first, reach, lambda nodes: F.element_at(nodes, -1)["path"])


def lattice(found: DataFrame, v: Vocabulary) -> DataFrame:
    """found (word, ...) with path: the orders of each word's pieces. Rows stay where they are: the words are grouped as they were dealt."""
    spark = found.sparkSession
    pieces = spark.createDataFrame(pa.table({"piece": [p for p, _, _ in v.pieces], "order": pa.array(range(len(v.pieces)), pa.int64())}))
    size, least = F.length("word"), 2 if v.kind == "bpe" else 1
    edges = found.withColumn("s", F.explode(F.sequence(F.lit(0), F.length("word") - 1)))
    # the single character at the start keeps words without longer pieces
    lengths = F.sequence(F.when(F.col("s") == 0, 1).otherwise(F.lit(least)), F.least(F.lit(v.longest), F.length("word") - F.col("s")))
    edges = edges.filter(F.length("word") - F.col("s") >= F.when(F.col("s") == 0, 1).otherwise(F.lit(least))).withColumn("m", F.explode(lengths))
    edges = edges.withColumn("piece", F.substring("word", F.col("s") + 1, F.col("m")))
    small = len(v.pieces) <= common.BROADCAST_ROWS
    edges = edges.join(F.broadcast(pieces) if small else pieces, "piece")
    edge = (F.col("order") * 4096 + F.col("s") * 64 + F.col("m")).alias("edge")
    grouped = edges.groupBy(*found.columns).agg(F.collect_list(edge).alias("edges"))
    if v.kind == "bpe":
        path = merged(F.col("word"), F.col("edges"))
    else:
        path = viterbi(F.col("edges"), size, F.array(*(F.lit(float(s)) for _, _, s in v.pieces)))
    return grouped.select(*found.columns, path.alias("path"))


class Pieces:
    """Ids of a path's numbers: orders of pieces, and -1 - c for a character c."""

    def __init__(self, v: Vocabulary):
        self.ids = np.array([i for _, i, _ in v.pieces], np.int32)
        order = {p: k for k, (p, _, _) in enumerate(v.pieces)}
        self.single = np.zeros(0x110000, np.int32)
        self.single[[ord(c) for c in v.chars]] = [self.ids[order[c]] for c in v.chars]

    def of(self, path: np.ndarray) -> np.ndarray:
        out = self.ids[np.maximum(path, 0)]
        low = path < 0
        out[low] = self.single[-1 - path[low]]
        return out


class Folder:
    """Paths of words of any length, as `merged` and `viterbi` give them for short ones."""

    def __init__(self, v: Vocabulary):
        self.bpe, self.longest = v.kind == "bpe", v.longest
        self.order = {p: k for k, (p, _, _) in enumerate(v.pieces)}
        self.scores = [s for _, _, s in v.pieces]
        self.kept: dict[str, list[int]] = {}
        self.size = 0

    def path(self, word: str) -> list[int]:
        if (path := self.kept.get(word)) is None:
            path = self.merged(word) if self.bpe else self.viterbi(word)
            if self.size + len(word) > KEPT:
                self.kept.clear()
                self.size = 0
            if len(word) <= KEPT:
                self.kept[word] = path
                self.size += len(word)
        return path

    def merged(self, word: str) -> list[int]:
        """The best merge of two neighbours, the leftmost of equal ones, until there is none: n log n by a heap of candidates."""
        n, order, scores = len(word), self.order, self.scores
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at a place; 0: none does
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            c = end[b]
            if c - a <= self.longest and (k := order.get(word[a:c])) is not None:
                heapq.heappush(heap, (-scores[k], a, b, c))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                offer(a, c)
            if a:
                offer(before[a], a)
        path, a = [], 0
        while a < n:
            path.append(order[word[a : end[a]]] if end[a] - a > 1 else -1 - ord(word[a]))
            a = end[a]
        return path

    def viterbi(self, word: str) -> list[int]:
        best, last = [0.0], [(0, 0)]
        for p in range(1, len(word) + 1):
            top, by = float("-inf"), (0, 0)
            for a in range(max(0, p - self.longest), p):
                if (k := self.order.get(word[a:p])) is not None and best[a] + self.scores[k] > top:
                    top, by = best[a] + self.scores[k], (a, k)
            best.append(top)
            last.append(by)
        path, p = [], len(word)
        while p:
            p, k = last[p]
            path.append(k)
        return path[::-1]


class Table:
    """Ids of words by hash: sorted hashes, and each word's run of ids in one array. Made of rows hash, ids."""

    def __init__(self, rows: pa.Table):
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        lists = rows.column("ids").combine_chunks()
        start, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        order = np.argsort(hashes)
        self.hashes, self.size = hashes[order], np.diff(start)[order].astype(np.uint8)
        self.ids = gathered(start[:-1][order], np.diff(start)[order], ids).astype(np.min_scalar_type(int(ids.max(initial=0))))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash; -1 if it isn't there."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Tables:
    """Tables of equal ranges of the hashes, each a broadcast of its own."""

    def __init__(self, parts: list[Table]):
        self.parts = parts
        self.starts = [(np.cumsum(t.size, dtype=np.int64) - t.size).astype(np.int32) for t in parts]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: whether each is there, the numbers of ids of those that are, and their ids end to end."""
        found, size, flat = [], [], []
        ends = np.searchsorted(hashes, np.array([(k << 64) // len(self.parts) for k in range(1, len(self.parts))], np.uint64))
        for part, start, own in zip(self.parts, self.starts, np.split(hashes, ends), strict=True):
            row = part.rows(own)
            found.append(row >= 0)
            row = row[row >= 0]
            size.append(part.size[row].astype(np.int64))
            flat.append(gathered(start[row], part.size[row], part.ids).astype(np.int32))
        return np.concatenate(found), np.concatenate(size), np.concatenate(flat)


def gathered(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], end to end."""
    size = size.astype(np.int64)
    at = np.cumsum(size) - size
    return flat[np.repeat(start - at, size) + np.arange(int(size.sum()))]


class Encoder:
    """Ids of texts from the tables' words, the given rare words, and the bytes of characters without a piece."""

    def __init__(self, v: Vocabulary, tables: Tables):
        self.splitter, self.pieces, self.tables = Splitter(v), Pieces(v), tables
        self.bytes = np.array([v.byte_ids.get(b, 0) for b in range(256)], np.int32)
        self.decoder, self.folder = Decoder(v), Folder(v)

    def encode(self, texts: list[str | None], rare: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Offsets of each text's ids, all ids end to end, and whether decoding them gives the texts back."""
        w = self.splitter.split(texts)
        own, first, at = np.unique(w.hashes, return_index=True, return_inverse=True)
        there, sizes, flat = self.tables.find(own)
        # runs that the tables haven't got: bytes of characters, long words and rare words
        long, runs = w.long(), []
        for i in first[~there].tolist():
            if w.lone[i]:
                runs.append(self.bytes[list(w.word(i).encode("utf-8", "surrogatepass"))])
            else:
                runs.append(self.pieces.of(np.array(self.folder.path(w.word(i)), np.int64)) if long[i] else np.array(rare[w.word(i)], np.int32))
        extra = np.array([len(r) for r in runs], np.int64)
        size, place = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        size[there], size[~there] = sizes, extra
        place[there], place[~there] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(extra) - extra
        flat = np.concatenate((flat, *runs))
        ids = gathered(place[at], size[at], flat)
        ends = np.concatenate(([0], np.cumsum(size[at])))[w.of_text]
        return ends, ids, self.same(w.string, texts, ends, ids)

    def same(self, string: str, texts: list[str | None], ends: np.ndarray, ids: np.ndarray) -> list[bool]:
        if self.decoder.bytes(ids) == string.encode("utf-8", "surrogatepass"):
            return [SPACE not in (t or "") for t in texts]
        return [self.decoder.text(ids[a:b]) == (t or "") for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]


class Decoder:
    def __init__(self, v: Vocabulary):
        of = v.bytes_of()
        top = max(of) + 1
        runs = [of.get(i, b"") for i in range(top)]
        self.size = np.array([len(r) for r in runs], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(runs), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        return gathered(self.start[ids], self.size[ids], self.flat).tobytes()

    def text(self, ids: np.ndarray) -> str:
        """Pieces and bytes end to end, spaces for the space marks, without the space put before."""
        s = self.bytes(ids).decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if s.startswith(" ") else s


def encode(docs: DataFrame, v: Vocabulary | None = None, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, ids, n_pieces, round_trip (decoding gives the text back) for every row of docs.

    Null and empty texts have no ids. A literal space mark (U+2581) comes back as a space, so its text has no round trip.
    Characters without a piece become their UTF-8 bytes' ids. Repeated rows each get their row; other columns of docs are ignored. Texts are encoded whole.
    """
    v = v or Vocabulary()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row"))
    own = spark.sparkContext.broadcast(v)

    def hashed(batches):
        splitter, pieces = Splitter(own.value), Pieces(own.value)
        for batch in batches:
            for part in common.slices(batch, SLICE):
                text = part.column(0).to_pylist()
                codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
                hashes = splitter.hashes(codes, np.concatenate(([0], np.cumsum([len(w) for w in text], dtype=np.int64))))
                paths = part.column(2)
                ends = paths.offsets.to_numpy()
                ids = pieces.of(paths.values.to_numpy()[ends[0] : ends[-1]])
                lists = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes.view(np.int64)), lists], ["word", "n", "hash", "ids"])

    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(GROUPED))
    try:
        found = common.cut(common.mapped(lattice(words(docs, v), v).select("word", "n", "path"), hashed, "word string, n long, hash long, ids array<int>"), "words")
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    # the least count that at most hot_words words reach
    least, hot = 1, 0
    for r in sorted(found.groupBy("n").count().collect(), reverse=True):
        if hot + r["count"] > hot_words:
            least = r["n"] + 1
            break
        hot += r["count"]
    # the driver holds one range of hashes at a time; a range of 2 ** 64 / shards, as signed numbers
    shards = max(1, -(-hot // SHARD))
    common_words, sent = found.filter(F.col("n") >= least).select("hash", "ids"), []
    for k in range(shards):
        lo, hi = ((j << 64) // shards for j in (k, k + 1))
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        inside = F.col("hash").between(signed(lo), signed(hi - 1))
        if lo < 1 << 63 < hi:  # the range passes from the greatest signed number to the least
            inside = (F.col("hash") >= lo) | (F.col("hash") <= signed(hi - 1))
        sent.append(spark.sparkContext.broadcast(Table(common_words.filter(inside).toArrow())))
        common.release()

    def rare(batches):
        tables, splitter = Tables([t.value for t in sent]), Splitter(own.value)
        for batch in batches:
            for part in common.slices(batch, SLICE):
                w = splitter.split(part.column(1).to_pylist())
                distinct, at = np.unique(w.hashes, return_inverse=True)
                low = np.flatnonzero(~tables.find(distinct)[0][at] & ~w.lone & ~w.long())
                text = np.searchsorted(w.of_text, low, "right") - 1
                rows = np.array(part.column(0).to_pylist(), np.int64)[text]
                once = sorted({(r, w.word(i)) for r, i in zip(rows.tolist(), low.tolist(), strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in once], pa.int64()), pa.array([x for _, x in once], pa.string())], ["row", "word"])

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.slices(batch, SLICE):
                raw = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "row", "packed"])

    def run(batches):
        encoder, unpack = Encoder(own.value, Tables([t.value for t in sent])), zstandard.ZstdDecompressor()
        for batch in batches:
            # packed texts are a third of their size
            for part in common.slices(batch, ENCODED // 3 if least > 1 else ENCODED):
                texts = part.column(1).to_pylist()
                if least > 1:
                    texts = [None if t is None else unpack.decompress(t).decode("utf-8", "surrogatepass") for t in texts]
                words = {x["word"]: x["ids"] for got in part.column(2).to_pylist() for x in got or ()}
                ends, ids, same = encoder.encode(texts, words)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "round_trip"])

    if least > 1:
        met = common.mapped(docs.select("row", "text"), rare, "row long, word string").join(found.filter(F.col("n") < least).select("word", "ids"), "word")
        met = met.groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("found"))
        # texts are shuffled to meet their rare words, so they go compressed
        rows = common.mapped(docs.select("doc_id", "row", "text"), packed, "doc_id long, row long, packed binary")
        rows = rows.join(met, "row", "left").select("doc_id", "packed", "found")
    else:
        rows = docs.select("doc_id", "text", F.lit(None).cast("array<struct<word:string,ids:array<int>>>").alias("found"))
    return common.mapped(rows, run, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """doc_id, text of rows doc_id, ids. Null and empty ids give an empty text; bytes that aren't UTF-8 give U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(v or Vocabulary())

    def make():
        decoder = Decoder(sent.value)
        return lambda x: {"doc_id": x["doc_id"], "text": [decoder.text(np.array(i or [], np.int64)) for i in x["ids"]]}

    return common.by_batch(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), make, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `encode` for every document; null and empty texts have no ids."""
    return encode(docs)
