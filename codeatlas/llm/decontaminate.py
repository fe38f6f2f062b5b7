"""Benchmark decontamination by the q-gram lemma: shared character q-grams counted in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A q-gram is 8 bytes of normalised text, so that it is one machine word.
Q = 8
#: Edits allowed, as a share of the passage's normalised length.
EDIT_RATE = 0.1
#: A benchmark text longer than twice this is searched as windows of that many bytes, each half a window after the last.
WINDOW = 240
#: Excerpts of PASSAGE bytes are found wherever they begin: they hold two disjoint windows of PART bytes that start at
#: multiples of STRIDE, and one of these has half of the excerpt's edits at most.
PART, STRIDE = 110, 11
PASSAGE = 2 * PART + STRIDE - 1
#: Characters of benchmark text that one index may hold; a larger benchmark is searched in blocks.
BLOCK_CHARS = 2_000_000
#: Texts are searched in pieces of so many bytes; each goes on for more bytes than any window has with its edits.
PIECE, OVERLAP = 1 << 14, 600
#: Shared q-grams that are counted at once.
COUNTED = 1 << 18
BITS = 22
MULT = np.uint64(0x9E3779B97F4A7C15)
SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, item_id long, start long, end long, edits long"


def normal(text: str) -> bytes:
    """Lower case; each run of ASCII characters that are neither letters nor digits is one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split())


def grams(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    for kind, step in ((np.uint16, 1), (np.uint32, 2), (np.uint64, 4)):
        x = x[:-step].astype(kind) | (x[step:].astype(kind) << kind(8 * step))
    return x


def expanded(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start, start + 1 ... of each run end to end, and the run of each."""
    size = size.astype(np.int64)
    run = np.repeat(np.arange(len(size)), size)
    return (start.astype(np.int64) - np.cumsum(size) + size)[run] + np.arange(int(size.sum())), run


class Index:
    """The windows of a block of benchmark items, by their q-grams; equal windows of an item are one.

    Beside an item's windows, those of over PASSAGE bytes are counted as segments of nearly two parts, each a part after the
    last, so that every part lies within one; a segment's parts are verified one by one. A q-gram that a window repeats at
    offsets not further apart than a band's width is one run of offsets: such a run meets a range of bands.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.windows = []
        whole, segments = {}, {}
        for item, text in items:
            b = normal(text)
            starts = [0] if len(b) <= 2 * WINDOW else [*range(0, len(b) - WINDOW, WINDOW // 2), len(b) - WINDOW]
            for at in starts:
                whole[item, b if len(starts) == 1 else b[at : at + WINDOW]] = None
            if len(b) > PASSAGE:
                for at in range(0, len(b) - PART + 1, PART):
                    segments[item, b[at : at + 2 * PART - 1]] = None
        self.windows = [w for w in whole if len(w[1]) >= Q]
        self.wholes = len(self.windows)
        self.windows += segments
        size = np.array([len(w) if k < self.wholes else PART for k, (_, w) in enumerate(self.windows)], np.int64)
        # the largest budget for which the lemma still asks for a shared q-gram
        self.edits = np.minimum((size * EDIT_RATE).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - self.edits * Q
        self.width = 2 * self.edits + 1
        parts = [grams(w) for _, w in self.windows]
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values = values[order]
        window = np.repeat(np.arange(len(parts), dtype=np.int32), [len(g) for g in parts])[order] if parts else np.zeros(0, np.int32)
        offset = np.concatenate([np.arange(len(g), dtype=np.int32) for g in parts])[order] if parts else np.zeros(0, np.int32)
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (window[1:] != window[:-1]) | (np.diff(offset) > self.width[window[1:]])
        first = np.flatnonzero(new)
        # of each run: its window, first and last offset, and number of offsets; of each value: where its runs start
        self.window, self.first, self.size = window[first], offset[first], np.diff(np.append(first, len(values))).astype(np.int32)
        self.last = offset[first + self.size - 1]
        self.values, at = np.unique(values[first], return_index=True)
        self.runs = np.append(at, len(first)).astype(np.int64)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[self.slot(self.values)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * MULT) >> np.uint64(64 - BITS)

    def search(self, b: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in normalised text: for each item the verified region of least edits of a window, of a part if there is none."""
        found: dict[int, tuple[int, int, int, int]] = {}
        parts: dict[int, tuple[int, int, int, int]] = {}
        for at in range(0, max(1, len(b) - OVERLAP), PIECE):
            self.search_piece(b[at : at + PIECE + OVERLAP], at, found, parts)
        return sorted((parts | found).values())

    def search_piece(self, b: bytes, begin: int, found: dict, parts: dict) -> None:
        for k, low, high in self.candidates(b):
            item, w = self.windows[k]
            edits, best = int(self.edits[k]), found.get(item)
            if best and (k >= self.wholes or best[3] == 0):
                continue
            if k < self.wholes:
                hit = located(w, b, low - edits, high - low + 1 + 2 * edits, edits)
                if hit and (not best or hit[2] < best[3]):
                    found[item] = (item, hit[0] + begin, hit[1] + begin, hit[2])
            elif item not in parts:
                shared = np.isin(grams(w), grams(b[max(0, low - edits) : max(0, high + len(w) + edits)]))
                n = np.concatenate(([0], np.cumsum(shared)))
                for start in self.starts(k):
                    if n[start + PART - Q + 1] - n[start] >= self.least[k]:
                        if hit := located(w[start : start + PART], b, low + start - edits, high - low + 1 + 2 * edits, edits):
                            parts[item] = (item, hit[0] + begin, hit[1] + begin, hit[2])
                            break

    def candidates(self, b: bytes) -> list[tuple[int, int, int]]:
        """(window, lowest diagonal, highest diagonal) of the neighbouring bands with enough shared q-grams; wholes first, most shared first.

        A diagonal is the place in b where the window starts. An occurrence uses as many different offsets of the window
        as different places of the text, so windows with too few offsets that b shares at all go first, and then bands
        in which too few places share a q-gram.
        """
        if len(b) < Q or not len(self.values):
            return []
        g = grams(b)
        at = np.flatnonzero(self.seen[self.slot(g)])
        row = np.minimum(np.searchsorted(self.values, g[at]), len(self.values) - 1)
        same = self.values[row] == g[at]
        at, row = at[same], row[same]
        if not len(at):
            return []
        present, of = np.unique(row, return_inverse=True)
        run, owner = expanded(self.runs[present], self.runs[present + 1] - self.runs[present])
        windows, own = np.unique(self.window[run], return_inverse=True)
        enough = np.bincount(own, self.size[run]) >= self.least[windows]
        kept = enough[own]
        run, owner = run[kept], owner[kept]
        if not len(run):
            return []
        size = np.bincount(owner, minlength=len(present))
        start, n = (np.cumsum(size) - size)[of], size[of]
        found, done, ends = [], 0, np.cumsum(n)
        while done < len(at):
            # places whose runs make up COUNTED, one at least
            stop = max(done + 1, int(np.searchsorted(ends, ends[done] - n[done] + COUNTED, "right")))
            row, place = expanded(start[done:stop], n[done:stop])
            place, row, done = at[done:stop][place], run[row], stop
            window = self.window[row].astype(np.int64)
            width = self.width[window]
            # bands of two widths, each a width after the last: any 2k + 1 neighbouring diagonals lie within one
            low = (place - self.last[row]) // width - 1
            band, which = expanded(low, (place - self.first[row]) // width - low + 1)
            found.append(np.unique(window[which] << 32 | (band + (1 << 16)), return_counts=True))
        keys, counts = found[0]
        if len(found) > 1:
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)
        good = counts >= self.least[keys >> 32]
        keys, counts = keys[good], counts[good]
        if not len(keys):
            return []
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 2) != 1)
        last = np.append(first[1:], len(keys)) - 1
        window, most = keys[first] >> 32, np.maximum.reduceat(counts, first)
        low = ((keys[first] & 0xFFFFFFFF) - (1 << 16)) * self.width[window]
        high = ((keys[last] & 0xFFFFFFFF) - (1 << 16) + 2) * self.width[window] - 1
        order = np.lexsort((-most, window >= self.wholes))
        return list(zip(window[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True))

    def starts(self, k: int) -> list[int]:
        """Where the parts of a segment start: each STRIDE bytes, and the last at its end."""
        last = len(self.windows[k][1]) - PART
        return [*range(0, last, STRIDE), last]


def located(w: bytes, b: bytes, start: int, width: int, most: int) -> tuple[int, int, int] | None:
    """`aligned`, after a search for w as it stands."""
    exact = b.find(w)
    return (exact, exact + len(w), 0) if exact >= 0 else aligned(w, b, start, width, most)


def aligned(w: bytes, b: bytes, start: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Start, end and edits of the best occurrence of w in b on diagonals start .. start + width, if it has at most `most` edits."""
    got = banded(w, b, start, width, most)
    if got is None:
        return None
    end, edits = got
    # the same backwards from that end gives the start
    back = banded(w[::-1], b[::-1], len(b) - end - most, 2 * most + 1, most, anchor=most)
    return len(b) - (back[0] if back else len(b) - end + len(w)), end, edits


def banded(w: bytes, b: bytes, start: int, width: int, most: int, anchor: int | None = None) -> tuple[int, int] | None:
    """Where w's best alignment with b ends and its edits, if they are at most `most`; it begins on any diagonal of the band, or on `anchor`."""
    far = np.int32(1 << 20)
    d = np.arange(width, dtype=np.int32)
    text = np.full(len(w) + width, -1, np.int16)  # text[i] is b[start + i]
    lo, hi = max(0, start), min(len(b), start + len(text))
    if lo >= hi:
        return None
    text[lo - start : hi - start] = np.frombuffer(b[lo:hi], np.uint8)
    whole = start >= 0 and start + len(text) <= len(b)
    bounded = lambda row, i: row if whole else np.where((start + i + d >= 0) & (start + i + d <= len(b)), row, far)
    row = bounded(np.zeros(width, np.int32) if anchor is None else np.where(d >= anchor, d - anchor, far), 0)
    for i, c in enumerate(w):
        cost = row + (text[i : i + width] != c)
        np.minimum(cost[:-1], row[1:] + 1, out=cost[:-1])
        row = bounded(np.minimum.accumulate(bounded(cost, i + 1) - d) + d, i + 1)
        if i % 8 == 7 and row.min() > most:
            return None
    best = int(row.argmin())
    return (start + len(w) + best, int(row[best])) if row[best] <= most else None


def places(text: str) -> np.ndarray:
    """For each byte of normal(text) the code point that it comes from."""
    of, at = bytearray(), []
    for i, c in enumerate(text):
        for x in c.lower().encode("utf-8", "surrogatepass").translate(SPACED):
            if x != 32 or (of and of[-1] != 32):
                of.append(x)
                at.append(i)
    if len(normal(text)) != len(at) - (bool(of) and of[-1] == 32):  # a letter whose lower case depends on its neighbours
        return np.linspace(0, max(0, len(text) - 1), len(normal(text)) + 1).astype(np.int64)
    return np.array(at, np.int64)


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's rows with a text, in as many hashed blocks as BLOCK_CHARS asks for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    return [rows] if n == 1 else [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


class Searcher:
    """The broadcast indexes of a benchmark's blocks; of several, a worker holds one at a time and takes more texts at once."""

    def __init__(self, benchmark: DataFrame):
        self.sent = []
        for block in blocks(benchmark):
            index = Index(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in block.collect()))
            self.sent.append(block.sparkSession.sparkContext.broadcast(index))
        self.taken = 4 << 20 if len(self.sent) < 2 else 16 << 20

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """What each text holds of all blocks: as `Index.search` gives it."""
        plain, out = [normal(t) if t else b"" for t in texts], [[] for _ in texts]
        for block in self.sent:
            for found, b in zip(out, plain, strict=True):
                found += block.value.search(b)
            if len(self.sent) > 1:
                del block._value  # the worker loads it again for the next texts
        return out


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each document and each benchmark item that it holds within the edit budget.

    start and end are code points of the document's own text. Null, empty and very short texts (under 8 normalised bytes)
    hold nothing and are held by nothing; an empty benchmark gives no rows. An item is held if its whole (up to 480
    normalised bytes) or a window of 240 (above) is, within 10 % edits; and, if it is longer than 230, if any excerpt of it of
    230 normalised bytes or more is, wherever it begins, within 23 edits: start and end are then those of 110 bytes of it. An item's null id becomes -1. Repeated rows
    each give their rows. Other columns are ignored. Texts are searched whole, each in one pass over the documents.
    """
    searcher = Searcher(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = [pa.int64()] * 5
    names = ["doc_id", "item_id", "start", "end", "edits"]

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, searcher.taken):
                found, texts = [], part.column(1).to_pylist()
                for doc, text, got in zip(part.column(0).to_pylist(), texts, searcher.search(texts), strict=True):
                    at = places(text) if got else None
                    found += [(doc, item, int(at[min(start, len(at) - 1)]), int(at[min(end, len(at)) - 1]) + 1, edits) for item, start, end, edits in got]
                columns = zip(*found, strict=True) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return common.mapped(rows, run, HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, as `hits` finds them, with all their columns; null, empty and very short texts stay."""
    at, searcher = docs.columns.index("text"), Searcher(benchmark)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, searcher.taken):
                yield part.filter(pa.array([not x for x in searcher.search(part.column(at).to_pylist())], pa.bool_()))

    return common.mapped(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table `benchmark` stay."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))
