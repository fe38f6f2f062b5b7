import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeatlas.llm import common, fingerprints

from .helpers import DOCS, ODD, by_id, documents


def edits(texts):
    """{id: edited text}, by plain ordering."""
    order = sorted(texts, reverse=True)
    out = {}
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        out[i] = own[: len(own) - half] + after[:half]
    return out


def check(df, texts):
    got = by_id(fingerprints.fingerprints(df), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    want = edits(texts)
    assert set(got) == set(texts)
    prints = {}
    for i, (n, sha, own, a, b) in got.items():
        assert n == len(texts[i] or "") and sha == hashlib.sha256(want[i].encode()).hexdigest()
        assert 0 <= a <= 1 and 0 <= b <= 1
        assert prints.setdefault(texts[i] or "", own) == own
    return got


def test_synthetic_table(spark, sf_dir):
    df = common.table(spark, sf_dir, "documents")
    got = check(df, {r["doc_id"]: r["text"] for r in df.collect()})
    mean = lambda k: sum(g[k] for g in got.values()) / len(got)
    assert mean(3) > 0.1 > 0.03 > mean(4)


def test_odd_texts(spark):
    got = check(documents(spark, ODD, extra=True), {i + 1: t for i, t in enumerate(ODD)})
    assert got[8][2] == got[9][2] and got[9][4] == 1.0
    assert len({got[i][2] for i in (1, 4, 5, 6, 7)}) == 5


def test_one_repeated_and_no_rows(spark):
    one = documents(spark, ["only one text"])
    assert by_id(fingerprints.fingerprints(one), "near_next") == {1: 1.0}
    assert fingerprints.fingerprints(one.union(one).union(spark.createDataFrame([(None, "t", "", "", 0)], DOCS))).count() == 3
    assert fingerprints.fingerprints(one.limit(0)).count() == 0


def inside(kept, word):
    return len(kept.kept(fingerprints.terms(word, fingerprints.Hashes()))) == 1


def test_band(spark):
    texts = [f"common rare{i} " + ("mid" if i < 3 else "") for i in range(40)]
    kept = fingerprints.lexicon(documents(spark, texts))
    assert inside(kept, "mid") and not inside(kept, "common") and not inside(kept, "rare7")


@pytest.mark.parametrize("flush", [fingerprints.FLUSH, 50])
def test_lexicon_is_the_band_of_exact_counts(spark, sf_dir, monkeypatch, flush):
    """All terms within the band pass, none above it, and of those below about 1 / SPACE at most."""
    monkeypatch.setattr(fingerprints, "FLUSH", flush)
    df = common.table(spark, sf_dir, "documents")
    counts, n = plain_frequencies(r["text"] for r in df.collect()), df.count()
    kept = fingerprints.lexicon(df)
    band = [w for w, c in counts.items() if 2 <= c <= n // 10]
    assert (1 << kept.bits) >= min(16 * len(band), 1 << fingerprints.MIN_BITS) and all(inside(kept, w) for w in band)
    assert not any(inside(kept, w) for w, c in counts.items() if c > n // 10)
    rare = [w for w, c in counts.items() if c == 1]
    assert sum(inside(kept, w) for w in rare) <= 0.09 * len(rare)


def plain_terms(text):
    return set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()))


def plain_frequencies(texts):
    counts = Counter(w for t in texts for w in plain_terms(t))
    return {w.decode(): c for w, c in counts.items()}


def test_fingerprints_are_those_of_plain_i_match(spark, monkeypatch):
    """Subset by subset: equal hashes for equal sorted lists of terms; likeness is the greatest share of equal subsets on a level that tells texts apart."""
    monkeypatch.setattr(fingerprints, "SPACE", 1 << 12)
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice((5, 40, 120)))) for _ in range(40)]
    texts += [t + " " + r.choice(words) for t in texts[:20]] + texts[:5] + ["the only of its kind"]
    df = documents(spark, texts)
    counts, lexicon = plain_frequencies(texts), fingerprints.lexicon(df)
    hashes = fingerprints.Hashes()
    mix = lambda x: int(fingerprints.mixed(np.array([x], np.uint64))[0])

    def plain(text):
        own = sorted(w for w in plain_terms(text) if 2 <= counts[w.decode()] <= len(texts) // 10)
        drawn = [{w: mix(hashes[w] ^ int(seed)) for w in own} for seed in fingerprints.SEEDS]
        return own, [tuple(w for w in own if d[w] < int(least)) for d, least in zip(drawn, fingerprints.LEAST, strict=True)]

    got, want = [fingerprints.fingerprint(t, lexicon, hashes) for t in texts], [plain(t) for t in texts]
    levels, size = fingerprints.LEVELS, fingerprints.SUBSETS
    for (a, x), (own, lists) in zip(got, want, strict=True):
        assert [bool(v) for v in x] == [bool(p) for p in lists]
        for (b, y), (other, others) in zip(got, want, strict=True):
            if own or other:
                assert (a == b) == (own == other)
                same = [p == q for p, q in zip(lists, others, strict=True)]
                assert [bool(v) for v in x == y] == same
                filled = [bool(p or q) for p, q in zip(lists, others, strict=True)]
                part = lambda f, k: f[k * size : (k + 1) * size]
                n = [sum(part(filled, k)) for k in range(levels)]
                alike = [sum(s and f for s, f in zip(part(same, k), part(filled, k), strict=True)) for k in range(levels)]
                told = [s / m for s, m in zip(alike, n, strict=True) if m >= fingerprints.FILLED]
                best = 1.0 if own == other else max(told) if told else sum(alike) / sum(n) if sum(n) else 0.0
                assert fingerprints.likeness((a, x), (b, y)) == pytest.approx(best)
