"""Greedy word-piece token counts by a linear longest-match automaton: a trie with failure links and counts of popped tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .sentencepiece_lattice import MODEL, SPACE, Vocabulary

#: Counts of distinct words that a task keeps, at most.
CACHE = 300_000
#: Longer words aren't kept.
LONG = 64


def n_bytes(c: str) -> int:
    return len(c.encode("utf-8", "surrogatepass"))


class Automaton:
    """Counts the pieces that greedy longest match cuts a word into, in one pass and without building them.

    Each trie node has a failure link: where matching stands after the tokens that its string surely begins with have been
    popped; pops holds how many those are. A character that no piece begins with stands alone and counts `lone(c)` tokens.
    """

    def __init__(self, pieces: list[str], lone=n_bytes):
        self.lone = lone
        self.child: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                at = self.child[at][c]
            ends[at] = at > 0
        self.fail, self.pops = [0] * len(self.child), [0] * len(self.child)
        level = [0]
        while level:  # by breadth: a node's link follows from those of shorter strings
            after = []
            for v in level:
                for c, u in self.child[v].items():
                    if ends[u]:
                        self.pops[u] = 1
                    elif v == 0:
                        self.pops[u] = lone(c)
                    else:
                        self.fail[u], n = self.moved(self.fail[v], c)
                        self.pops[u] = self.pops[v] + n
                    after.append(u)
            level = after

    def moved(self, at: int, c: str) -> tuple[int, int]:
        """The node after c, and the tokens popped on the way."""
        n = 0
        while c not in self.child[at]:
            if at == 0:
                return 0, n + self.lone(c)
            n += self.pops[at]
            at = self.fail[at]
        return self.child[at][c], n

    def count(self, word: str) -> int:
        at, total = 0, 0
        for c in word:
            if c in self.child[at]:
                at = self.child[at][c]
            else:
                at, n = self.moved(at, c)
                total += n
        while at:
            total += self.pops[at]
            at = self.fail[at]
        return total


class Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(SPACE + word)
        if len(word) <= LONG:
            if len(self) > CACHE:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, pieces: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """doc_id, n_words, n_tokens, max_word_tokens for every row of docs.

    Words are what white space separates; each is cut greedily into the longest pieces, with the space mark before it, and a
    character without a piece counts its UTF-8 bytes. Null, empty and blank texts have 0 of each. Texts and words of any
    length are counted whole. Repeated rows each get their row; other columns of docs are ignored.
    """
    pieces = pieces or [p for p, _, _ in Vocabulary(model).pieces]
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))  # as large as the vocabulary

    def make():
        counts = Counts(sent.value)

        def run(x):
            out = {"doc_id": x["doc_id"], "n_words": [], "n_tokens": [], "max_word_tokens": []}
            for text in x["text"]:
                n = list(map(counts.__getitem__, text.split() if text else ()))
                for k, v in (("n_words", len(n)), ("n_tokens", sum(n)), ("max_word_tokens", max(n, default=0))):
                    out[k].append(v)
            return out

        return run

    return common.by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_words long, n_tokens long, max_word_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
