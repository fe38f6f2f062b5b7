"""Personal data in texts: exact base patterns, and further spans proposed by loose generators and chosen by boosted trees.

Everything that touches the documents is a DataFrame expression. The trees are fitted on the driver, on candidates of a
bounded sample of the documents that the base patterns and checksums label, and on examples that `examples` writes from
templates (the corpus has no labels for personal data); thresholds are calibrated on templates and documents left out.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: In the order in which equal starts are listed; `secret` comes from the trees alone.
KINDS = ("email", "ip", "card", "phone", "secret")
WORD = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
# Each pattern with a cheap test for texts that can't hold it. Possessive repeats and the look-behinds change no match
# of the base patterns: a match that fails from the first character of a run fails from its later ones as well.
BASE = {
    "email": ("@", rf"(?:(?<!{WORD})|\G){WORD}++@{LABEL}++(?:\.{LABEL}++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[ -]?[0-9]){11}", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Loose generators, by the kind that their spans get; their spans may overlap each other and the base spans.
LOOSE = {
    "email": ("@", r"(?<![^\s@])[^\s@]++@[^\s@]{3,}+"),
    "ip": (r"[0-9][ ()\[\].:]{1,3}[0-9]|[0-9a-fA-F]:[0-9a-fA-F]", r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": (r"[0-9](?:[ ./-]{0,2}[0-9]){11}", r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){11,18}(?![0-9])"),
    "phone": (r"[0-9][0-9 ().-]{5,}[0-9]", r"(?<![0-9])[0-9][0-9 ().-]{5,}[0-9]"),
    "secret": (r"[A-Za-z0-9_+/-]{20}", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}+"),
}
CUES = {
    "cue_secret": r"(?i)(token|secret|passw|api.?key|auth|bearer|credential)[^\n]{0,8}$",
    "cue_phone": r"(?i)(tel|phone|call|fax|mobil|cell|handy|móvil|llame)[^\n]{0,6}$",
    "cue_reference": r"(?i)(order|invoice|ref|isbn|version|http|page|item|\bid|[/#])[^\n]{0,4}$",
    "cue_card": r"(?i)(card|visa|master|amex|credit|karte|carte|tarjeta)[^\n]{0,8}$",
    "cue_host": r"(?i)(\bip|host|server|addr|peer|client|node)[^\n]{0,8}$",
    "assigned": r"[=:]\s?[\"']?$",
}
FEATURES = ("kind", "digits", "letters", "upper", "length", "groups", "longest", "hex", "domain", "dated", "ends", "checksum", *CUES)
LEFT, RIGHT = 24, 8
TREES, RATE, PRECISION = 24, 0.3, 0.99
#: Documents whose candidates are labelled by patterns and checksums, and such candidates, at most; parts left out in turn.
SAMPLE, MAX_WEAK, FOLDS = 2_000, 1_500, 4


def matches(text: Column, test: str, pattern: str) -> Column:
    """array<struct<start, end, hit, left, right>> of the leftmost non-overlapping matches, in code points; one pass, linear in the text."""
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)(?=(.{{0,{RIGHT}}}))")
    parts = F.arrays_zip(*(F.regexp_extract_all(text, whole, F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "hit"), (3, "right"))))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,hit:string,left:string,right:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.substring(x["gap"], -LEFT, LEFT).alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.when(x["hit"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(test), found).otherwise(none)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def worth(i):
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def of(f, kind):
    """f for one kind, as a function of the element alone (Spark counts a lambda's arguments)."""
    return lambda x: f(kind, x)


def valid(kind: str, x: Column) -> Column:
    hit = x["hit"]
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255"))
        return F.forall(F.split(hit, r"\."), small)
    n = F.length(digits(hit))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    return {k: F.filter(matches(text, *BASE[k]), of(valid, k)) for k in BASE}


def features(kind: str, x: Column) -> Column:
    """The struct of a candidate: its place, and FEATURES as doubles from its format and its context."""
    hit, left = x["hit"], x["left"]
    count = lambda p: F.length(F.regexp_replace(hit, p, ""))
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    n = count("[^0-9]")
    if kind == "card":
        checksum = F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)
    elif kind == "ip":  # four parts of at most 255, or groups of hexadecimal digits that aren't all pairs
        colons = hit.contains(":")
        checksum = F.when(colons, ~hit.rlike("^(?:[0-9A-Fa-f]{1,2}:)+[0-9A-Fa-f]{1,2}$")).otherwise(F.forall(groups, lambda g: (F.length(g) < 3) | (g <= "255")))
    else:
        checksum = n.between(9, 15) if kind == "phone" else F.lit(True)
    values = {
        "kind": F.lit(KINDS.index(kind)), "digits": n, "letters": count("[^A-Za-z]"), "upper": count("[^A-Z]"), "length": F.length(hit),
        "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "checksum": checksum.cast("int"), "hex": hit.rlike("^[0-9a-fA-F]+$").cast("int"),
        "domain": hit.rlike(r"@[^@.]+(\.[^@.]+)*\.\p{L}{2,}[.,;:!?]?$").cast("int"), "dated": hit.rlike("^(19|20)[0-9]{2}[-./ ]|[-./ ](19|20)[0-9]{2}$").cast("int"),
        "ends": x["right"].rlike(r"^([\"'\s.,;)]|$)").cast("int"),
    } | {k: left.rlike(p).cast("int") for k, p in CUES.items()}
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(values[f].cast("double").alias(f) for f in FEATURES))


def candidates(text: Column) -> Column:
    return F.concat(*(F.transform(matches(text, *LOOSE[k]), of(features, k)) for k in LOOSE))


def examples(n: int = 1800, seed: int = 6) -> list[tuple[int, int, str, int]]:
    """(number, template, text, kind of its personal data; -1: none), written from templates with a seeded generator."""
    r = random.Random(seed)
    text = lambda a, k: "".join(r.choice(a) for _ in range(k))
    number = lambda k: text("0123456789", k)
    word = lambda k: text("etaoinshrdlu", k)
    octet = lambda: str(r.randint(0, 255))
    mixed = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"
    hexes = "0123456789abcdef"

    def card(good: bool) -> list[str]:
        own = "4" + number(14)
        total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(own))))
        own += str((-total + (0 if good else r.randint(1, 9))) % 10)
        return [own[i : i + 4] for i in (0, 4, 8, 12)]

    yes = [
        lambda: f'{r.choice(("token", "api_key", "secret", "password", "auth"))} {r.choice("=:")} "{text(hexes, r.randint(24, 64))}"',
        lambda: f"{r.choice(('Bearer', 'api key:', 'credential ='))} {text(mixed, r.randint(24, 60))} ",
        lambda: f"{r.choice(('passwd', 'client_secret', 'access_token'))}={text(mixed, r.randint(22, 44))}",
        lambda: f"{r.choice(('tel', 'Tel.', 'phone:', 'call', 'fax', 'Handy'))} 0{number(2)}{r.choice(' -')}{number(4)}{r.choice(' -')}{number(4)} {word(5)}",
        lambda: f"{r.choice(('phone', 'mobile', 'cell:'))} ({number(3)}) {number(3)}-{number(4)}.",
        lambda: f"{r.choice(('mobile', 'call', 'Telefon', 'Fax:'))} 0{number(1)}.{number(2)}.{number(2)}.{number(2)}.{number(2)} {word(3)}",
        lambda: f"{word(4)} {word(3)}ü{word(3)}@{word(6)}ä{word(2)}.{r.choice(('de', 'org', 'com', 'fr'))} ",
        lambda: f"{word(5)} {word(4)}.{word(5)}@{word(4)}ö{word(3)}.{word(3)}.{r.choice(('de', 'net', 'at'))}, {word(3)}",
        lambda: f"{word(3)} <{word(2)}ñ{word(4)}@{word(7)}.{r.choice(('es', 'org', 'info'))} {word(2)}",
        lambda: f"{r.choice(('host', 'server', 'ip', 'peer'))} {octet()}[.]{octet()}[.]{octet()}[.]{octet()} {word(4)}",
        lambda: f"{r.choice(('address', 'client', 'IP:', 'node'))} {octet()}(.){octet()}(.){octet()}(.){octet()}",
        lambda: f"{r.choice(('host', 'addr', 'server'))} {':'.join(text(hexes, r.choice((3, 4, 4, 4))) for _ in range(8))} {word(3)}",
        lambda: f"{r.choice(('card', 'visa', 'credit card:', 'Karte'))} {'.'.join(card(True))} {word(4)}",
        lambda: f"{r.choice(('Mastercard', 'carte', 'card no', 'amex'))} {'/'.join(card(True))},",
        lambda: f"{r.choice(('card', 'tarjeta', 'Visa:'))} {'  '.join(card(True))} {word(2)}",
    ]
    no = [
        lambda: f"{word(5)} {r.choice((1, 2))}{number(3)}-{number(2)}-{number(2)} {number(2)} {word(4)}",
        lambda: f"{r.choice(('order', 'invoice', 'ref', 'ISBN', 'version', 'item', ''))} {number(r.randint(8, 16))} {word(4)}",
        lambda: f"{word(5)} {number(1)}.{number(3)} {number(2)}.{number(4)} {number(3)} {word(3)}",
        lambda: f"{word(3)} {word(r.randint(20, 50))} {word(4)}",
        lambda: f"{word(3)} {'-' * r.randint(20, 40)} {'=' * r.randint(20, 30)} ",
        lambda: f"http://{word(6)}.com/{word(12)}/{word(9)}/{number(4)}/{word(5)} ",
        lambda: f"{word(5)} {word(4)}_{word(9)}_{word(8)}_{word(3)} {word(2)}",
        lambda: f"{word(3)} {word(5)}@{word(6)} {word(2)}",
        lambda: f"{text(hexes, 40)} {word(6)}",
        lambda: f"see {word(4)}@@{word(3)} and {word(3)}@{word(3)}_{word(3)}",
        lambda: f"{r.choice(('version', 'section', 'page', 'ref', ''))} {number(1)} . {number(1)} . {r.randint(256, 999)} . {number(1)} {word(3)}",
        lambda: f"{r.choice(('at', 'mac', 'device', 'time'))} {':'.join(text(hexes, 2) for _ in range(6))} {word(3)}",
        lambda: f"{r.choice(('item', 'order', 'ref', 'card', ''))} {r.choice('./').join(card(False))} {word(3)}",
        lambda: f"{word(4)} {number(1)}.{'.'.join(number(3) for _ in range(4))} {word(5)}",
        lambda: f"{r.choice(('ref', 'id', 'order'))} {'  '.join(number(4) for _ in range(4))} {word(3)}",
    ]
    out = []
    for i in range(n):
        k = r.randrange(len(yes if i % 2 else no))
        kind = KINDS.index(("secret", "phone", "email", "ip", "card")[k // 3]) if i % 2 else -1
        out.append((i, k if i % 2 else len(yes) + k, " ".join((word(4), word(6), (yes if i % 2 else no)[k]())), kind))
    return out


def weak(docs: DataFrame) -> DataFrame:
    """i (a hash), fold, y, c: candidates of at most about SAMPLE hashed documents that patterns or checksums label, MAX_WEAK at most.

    A candidate is personal data if a base span of its kind overlaps it; it is none if it fails its kind's checksum (of a
    card, the parts of an address, the digits of a phone number). All others are left alone.
    """
    mark = F.pmod(F.xxhash64(F.lit(6), "doc_id", "text"), F.lit(1_000_000))
    docs = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    few = docs.filter(mark < F.lit(1e6 * SAMPLE / max(1, docs.count()))).withColumn("i", F.xxhash64("doc_id", "text")).limit(2 * SAMPLE)
    base = F.concat(*(F.transform(v, of(place, KINDS.index(k))) for k, v in base_spans(F.col("text")).items()))
    rows = few.withColumn("base", base).withColumn("c", candidates(F.col("text"))).select("i", "base", F.explode("c").alias("c"))
    held = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    y = F.when(held, 1).when(F.col("c.checksum") == 0, 0)
    rows = rows.select("i", F.pmod("i", F.lit(FOLDS)).cast("int").alias("fold"), y.alias("y"), "c").filter("y is not null")
    return rows.orderBy("i", "c.start", "c.kind").limit(MAX_WEAK)


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Trees of depth two for the logistic loss: the bias, and (feature, cut, left leaf or tree, right ...) for each tree."""
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, trees = np.full(len(y), bias), []
    cuts = [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
    cuts = [c if len(c) <= 32 else np.quantile(c, np.linspace(0, 1, 32)) for c in cuts]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]  # v < c[j] if and only if its bin is j or less

    def split(rows, g, h, depth):
        """The split of the greatest gain (ties: the first feature, the least cut); a leaf if there is none."""
        total = (g[rows].sum(), h[rows].sum())
        worth = lambda a, b: a * a / (b + 1.0)
        best = (1e-6, None)
        for f, c in enumerate(cuts if depth else []):
            if len(c):
                left = [np.bincount(bins[f][rows], v, len(c) + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
                gain = worth(left[0], left[1]) + worth(total[0] - left[0], total[1] - left[1]) - worth(*total)
                gain[(left[2] == 0) | (left[2] == len(rows))] = -np.inf
                if gain.max() > best[0] + 1e-12:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            return float(RATE * total[0] / (total[1] + 1.0))
        f, j = best[1]
        below = bins[f][rows] <= j
        return (f, float(cuts[f][j]), split(rows[below], g, h, depth - 1), split(rows[~below], g, h, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(split(np.arange(len(y)), y - p, p * (1 - p), 2))
        score = score + value(trees[-1], x)
    return bias, trees


def value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, c, left, right = tree
    return np.where(x[:, f] < c, value(left, x), value(right, x))


def expression(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, c, left, right = tree
    return F.when(x[FEATURES[f]] < c, expression(left, x)).otherwise(expression(right, x))


class Model:
    """Boosted trees, and for each kind the least score at which examples left out are right in PRECISION of cases.

    Each template, and each document of the sample, belongs to one of FOLDS parts; the scores that thresholds are read from
    are those of trees fitted without its part.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame | None = None):
        rows = spark.createDataFrame([(i, k % FOLDS, text, kind) for i, k, text, kind in examples()], "i long, fold int, text string, of int")
        rows = rows.select("i", "fold", "of", F.explode(candidates(F.col("text"))).alias("c"))
        # what a template's personal data is to the generators of other kinds isn't said
        rows = rows.filter("of < 0 or c.kind = of").withColumn("y", (F.col("of") >= 0).cast("int")).select("i", "fold", "y", "c")
        if docs is not None:
            rows = rows.unionByName(weak(docs).select("i", "fold", "y", "c"))
        got = rows.select("i", "fold", "y", "c.*").collect()
        got.sort(key=lambda r: (r["i"], r["start"], r["kind"], r["end"]))
        x, y, fold = np.array([[r[f] for f in FEATURES] for r in got]), np.array([r["y"] for r in got], float), np.array([r["fold"] for r in got])
        score = np.zeros(len(y))
        for k in range(FOLDS):
            bias, trees = boosted(x[fold != k], y[fold != k])
            score[fold == k] = bias + sum(value(t, x[fold == k]) for t in trees)
        self.least = {}
        for k in LOOSE:
            own = x[:, 0] == KINDS.index(k)
            fits = [c for c in np.unique(score[own]) if y[own][score[own] >= c].mean() >= PRECISION]
            self.least[k] = max(0.0, float(min(fits))) if fits else float("inf")
        self.bias, self.trees = boosted(x, y)

    def score(self, x: Column) -> Column:
        return reduce(lambda a, t: a + expression(t, x), self.trees, F.lit(self.bias))

    def enough(self, x: Column, score: Column) -> Column:
        return reduce(lambda a, k: a | ((x["kind"] == KINDS.index(k)) & (score >= self.least[k])), self.least, F.lit(False))


def is_kind(kind: int, x: Column) -> Column:
    return x["kind"] == kind


def place(kind: Column | int, x: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(x["start"].alias("start"), kind.cast("int").alias("kind"), x["end"].alias("end"))


def find(docs: DataFrame, model: Model | None = None, names: tuple[str, str] = ("pii_base", "pii_spans")) -> DataFrame:
    """docs with the base spans and all spans, in columns of those names: array<struct<start, kind, end>> in order of start, then kind (its place in KINDS).

    All spans are the base spans and those that the trees add; an added span never overlaps a base span, and of added ones that
    overlap, the longer stays (the better scored if equal, else the earlier). A null or empty text has none. Whole texts of any length are
    searched. Rows aren't compared: repeated ones get equal spans. Columns of docs that have these names are replaced.
    """
    model = model or Model(docs.sparkSession, docs)
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(*(F.transform(v, of(place, KINDS.index(k))) for k, v in base_spans(text).items())))
    scored = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), model.score(x).alias("score"))
    more = F.filter(F.transform(candidates(text), scored), lambda x: model.enough(x, x["score"]))
    out = docs.withColumn(names[0], base).withColumn(names[1], F.array_sort(more))
    apart = F.filter(names[1], lambda x: ~F.exists(names[0], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    none = F.filter(names[1], lambda x: F.lit(False))

    def step(acc, x):
        last = F.element_at(acc, -1)
        size, least = x["end"] - x["start"], last["end"] - last["start"]
        kept = F.when((size > least) | ((size == least) & (x["score"] > last["score"])), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))).otherwise(acc)
        return F.when(F.size(acc) == 0, F.array(x)).when(last["end"] > x["start"], kept).otherwise(F.concat(acc, F.array(x)))

    best = F.transform(F.aggregate(apart, none, step), lambda x: place(x["kind"], x))
    return out.withColumn(names[1], F.array_sort(F.concat(names[0], best)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, as the first one's kind in capitals and brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit("")).alias("out"))

    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(names, x["kind"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = [F.size(F.filter("pii_base", of(is_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its spans are redacted and n_chars follows."""
    base, spans, text = (n + "_" * max(len(c) for c in docs.columns) for n in ("base", "spans", "text"))  # longer than any own name
    found = find(docs, names=(base, spans)).withColumn(text, redacted(F.col("text"), F.col(spans)))
    n = F.when(F.size(spans) > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": n, "text": F.col(text)}).select(docs.columns)
