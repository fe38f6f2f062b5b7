"""Main text of web pages with a site style tree: same-host pages merged by style, low-importance nodes removed from each page."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A style node on at least MIN_PAGES different pages of a host is removed below this importance.
MIN_PAGES, LEAST_IMPORTANCE = 3, 0.3
TOKEN = re.compile(
    r"(?s)<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<box>noscript|template|iframe|svg|math|select|button|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?</(?P=box)\s*>"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<own>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<own2>[^<>]*)>|<[!?/][^>]*>|[^<]+|<",
    re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACES = re.compile(r"[ \t\n\r\f\v\xa0 -     　\x85]+")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the named kind ends, if they are open.
ENDS = {"body": {"head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table ul ol dl article section main body div td th nav aside".split())
#: Presentation that is no part of an article, whatever its content.
NOISE_TAGS = set("nav footer aside form menu dialog head noscript template iframe svg math select button object".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Parts of class names and ids that name such presentation by themselves, and those that do where all other parts are
#: such or name a place or a box; a name with one of GLUE in it is a phrase of the content.
NOISE_WORDS = re.compile(
    r"ads?|advert\w*|adsense|banners?|promo\w*|sponsor\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebar\w*|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|"
    r"popup|modal|overlay|newsletter|subscri\w*|comments?|commentlist|disqus|replies|respond|sharing|social|related|recommend\w*|widgets?|pagination|pager"
)
WEAK_WORDS = set("side form notice search share signup login skip".split())
PLACES = set("site main page top bottom left right center box bar area list item items block wrap wrapper container content inner outer section slot unit column col row header head body link links button buttons primary secondary global text title icon icons input small large fixed sticky js js1 id".split())
GLUE = set("by of for the a an and in to on with without from at hoc".split())
MAIN = {"article", "main"}


def host(url: str | None) -> str:
    """Lower-case host of a URL, without user and port; empty if there is none."""
    found = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def plain(text: str) -> str:
    return SPACES.sub(" ", html.unescape(text) if "&" in text else text).strip()


def noisy(look: str) -> bool:
    """Whether one of these class names and ids names presentation that is no part of an article."""
    for name in look.split():
        words = [w for w in re.split(r"[-_\d]+", name.lower()) if w]
        strong = [w for w in words if NOISE_WORDS.fullmatch(w)]
        if GLUE.isdisjoint(words) and (strong or (any(w in WEAK_WORDS for w in words) and all(w in WEAK_WORDS or w in PLACES for w in words))):
            return True
    return False


def look_of(attributes: str) -> tuple[str, str]:
    """Class names and ids, and the role."""
    look, role = "", ""
    for a in ATTRIBUTE.finditer(attributes):
        value = a[2] or a[3] or a[4] or ""
        if a[1].lower() == "role":
            role = value.lower()
        else:
            look += " " + value
    return look, role


class Page:
    """Blocks of a page in order, without those that are noise by their presentation: (style path hash, text, inside article or main)."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[int, str, bool]] = []
        self.parts: list[str] = []
        # of every element its parent, style, place among the parent's children; of its own children their number, the
        # last one's style, and a hash of their styles, runs of one style as one; of each block its element
        self.elements, self.children, self.at = [(0, "", 0)], [[0, "", 0]], []
        # (tag, path, in main, noise, element) of the open elements; inline ones only if they are noise
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        self.names: dict[str, int] = {}
        for m in TOKEN.finditer(source or ""):
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                if not self.open[-1][3]:
                    self.parts.append(text)
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if name == "br":
                self.parts.append(" ")
                continue
            end, attributes = m["end"] or m["end2"], m["own"] or m["own2"] or ""
            if name in INLINE:
                # noise within a block: its text is left out, the block goes on
                if end:
                    self.close(name)
                elif name not in VOID and not attributes.endswith("/"):
                    look, role = look_of(attributes) if attributes else ("", "")
                    if self.names.get(name) or role in NOISE_ROLES or noisy(look):
                        self.push(name, *self.open[-1][1:3], True, self.open[-1][4])
                continue
            self.flush()
            if end:
                self.close(name)
            elif name not in VOID:
                self.start(name, attributes)
        self.flush()

    def flush(self) -> None:
        if self.parts:
            if text := plain("".join(self.parts)):
                _, path, inside, _, element = self.open[-1]
                self.blocks.append((path, text, inside))
                self.at.append(element)
            self.parts = []

    def push(self, name: str, path: int, inside: bool, noise: bool, element: int) -> None:
        self.names[name] = self.names.get(name, 0) + 1
        self.open.append((name, path, inside, noise, element))

    def cut(self, i: int) -> None:
        """Close the open elements from the i-th."""
        for name, *_ in self.open[i:]:
            self.names[name] -= 1
        del self.open[i:]

    def close(self, name: str) -> None:
        if self.names.get(name):
            self.cut(next(i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == name))

    def start(self, name: str, attributes: str) -> None:
        top = len(self.open) - 1
        while self.open[top][0] in INLINE:
            top -= 1
        if self.open[top][0] == "p":  # a block ends a paragraph
            self.cut(top)
        if any(self.names.get(n) for n in ENDS.get(name, ())):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in ENDS[name]:
                    self.cut(i)
                    break
                if self.open[i][0] in SCOPE:
                    break
        look, role = look_of(attributes) if attributes else ("", "")
        _, path, inside, noise, above = self.open[-1]
        noise = noise or name in NOISE_TAGS or (name == "header" and not inside) or role in NOISE_ROLES
        noise = noise or bool(look and name not in ("body", "html") and name not in MAIN and noisy(look))
        own = f"{name}.{' '.join(sorted(look.split()))}.{role}"
        family = self.children[above]
        if own != family[1]:
            family[1:] = own, xxhash.xxh3_64_intdigest(f"{family[2]} {own}")
        self.elements.append((above, own, family[0]))
        family[0] += 1
        self.children.append([0, "", 0])
        self.push(name, xxhash.xxh3_64_intdigest(f"{path}/{own}"), inside or name in MAIN or role in ("main", "article"), noise, len(self.elements) - 1)

    def nodes(self, site: int) -> list[tuple[int, int, int]]:
        """For each block the style nodes of a host that it belongs to.

        The first is shared by all elements of its style path. The others are those of its branch (the styles of all
        elements above, each with the styles of all its children, runs of one style as one) at its own place among its
        siblings, counted from the first and from the last.
        """
        branch: list[int] = []
        for (parent, style, _), children in zip(self.elements, self.children, strict=True):
            branch.append(xxhash.xxh3_64_intdigest(f"{branch[parent] if branch else 0}/{style}/{children[2]}"))
        out, nth = [], {}
        for (path, _, _), element in zip(self.blocks, self.at, strict=True):
            nth[element] = nth.get(element, 0) + 1
            parent, _, place = self.elements[element]
            ends = (f"{place}", f"-{self.children[parent][0] - place}")
            out.append((ident(site, path), *(ident(site, branch[element], end, nth[element]) for end in ends)))
        return out


def ident(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(map(str, parts))) - (1 << 63)


PARSED = "page_id long, url string, page long, blocks array<struct<path:long,first:long,last:long,inside:boolean,text:string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, page (hash of its host and blocks), blocks with their style nodes: each page is parsed once, what follows reads this table."""

    def make():
        def run(x):
            out = {k: [] for k in ("page_id", "url", "page", "blocks")}
            for page, url, source in zip(x["page_id"], x["url"], x["html"], strict=True):
                found, site = Page(source), ident(host(url))
                own = zip(found.blocks, found.nodes(site), strict=True)
                blocks = [{"path": path, "first": first, "last": last, "inside": b[2], "text": b[1]} for b, (path, first, last) in own]
                for k, v in (("page_id", page), ("url", url), ("page", ident(site, *(b[1] for b in found.blocks))), ("blocks", blocks)):
                    out[k].append(v)
            return out

        return run

    return common.cut(common.by_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), make, PARSED), "blocks")


def importance(rows: DataFrame) -> DataFrame:
    """node, m (different pages of the host that have it), importance: 1 less the mean entropy of the node's contents.

    A content that n of the m pages hold has the entropy log n / log m: its pages are alike in that the base is their
    number. A node whose contents all differ has importance 1, one with the same content on all its pages 0. Copies of a
    page count once. A node's presentation is in its key: pages that lay out a branch differently have different nodes.
    The importance of an inner node (entropy of its child styles, and its children's importance) can't change what is
    removed: a branch is noise if all nodes below it are low, so a text goes if and only if its own node is low.
    """
    block = rows.select("page", F.explode("blocks").alias("b")).select("page", "b.*", F.xxhash64("b.text").alias("content"))
    pair = lambda node, content: F.struct(F.col(node).alias("node"), content.alias("content"))
    own = F.array(*(pair(n, F.col("content")) for n in ("path", "first", "last")), pair("path", F.lit(None).cast("long")))
    seen = block.select("page", F.explode(own).alias("x")).select("x.node", "x.content", "page").distinct()
    n = seen.groupBy("node", "content").agg(F.count("*").alias("n"))
    # a page has one content at a place, but several under a style path, so there a row without a content counts pages
    named = F.col("content").isNotNull()
    m = F.coalesce(F.max(F.when(~named, F.col("n"))), F.sum("n"))
    nodes = n.groupBy("node").agg(m.alias("m"), F.sum(F.when(named, F.log("n"))).alias("logs"), F.count("content").alias("contents"))
    return nodes.select("node", "m", F.when(F.col("m") > 1, 1 - F.col("logs") / F.col("contents") / F.log("m")).otherwise(1.0).alias("importance"))


def chosen(blocks: list[dict], low: list[bool]) -> list[str]:
    """The texts that stay, of a page's blocks and whether the style node of each is low."""
    chars = lambda kept: sum(len(b["text"]) for b in kept)
    inner = [b for b in blocks if b["inside"]]
    alike = 2 * chars(b for b, x in zip(blocks, low, strict=True) if x and b["inside"]) >= chars(inner)
    left = [b for b, x in zip(blocks, low, strict=True) if not x or (b["inside"] and alike)]
    whole = chars(b for b in left if b["inside"]) >= chars(b for b in left if not b["inside"])
    return [b["text"] for b in left if b["inside"] or not whole]


def extract(pages: DataFrame, broadcast_rows: int = common.BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars, removed (blocks left out, but for those of the presentation) for every row of pages.

    Presentation that is never article (menus, adverts, forms ..., within a line too) is left out, and blocks of style
    nodes of low importance, within an article or main element too; where those would be half of an element's text or
    more, the articles are alike and keep them. If the rest of a page lies within article or main elements by half or more,
    the blocks outside are left out; else all stay, so that a teaser or comments marked up as articles never replace a body.
    Null and empty html give an empty text. A null url belongs to the host without a name. Repeated rows each get their row.
    Pages of any length and depth are read whole. Other columns of pages are ignored.
    """
    rows = parsed(pages)
    low = common.cut(importance(rows).filter((F.col("m") >= MIN_PAGES) & (F.col("importance") < LEAST_IMPORTANCE)).select("node"), "low")
    if low.count() <= broadcast_rows:
        nodes = rows.sparkSession.sparkContext.broadcast(np.sort(low.toArrow().column("node").to_numpy()))
        rows = rows.select("page_id", "url", "blocks", F.lit(None).cast("array<int>").alias("lows"))
    else:
        nodes = None
        row = F.xxhash64("page_id", "url", "page")  # equal rows have equal blocks
        at = rows.select(row.alias("row"), F.posexplode("blocks").alias("at", "b"))
        at = at.select("row", "at", F.explode(F.array("b.path", "b.first", "b.last")).alias("node")).join(low, "node", "left_semi")
        lows = at.groupBy("row").agg(F.collect_set("at").alias("lows"))
        rows = rows.withColumn("row", row).join(lows, "row", "left").select("page_id", "url", "blocks", "lows")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                out = []
                for blocks, lows in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if nodes is None:
                        flags = [i in set(lows or ()) for i in range(len(blocks))]
                    else:
                        keys = np.array([[b["path"], b["first"], b["last"]] for b in blocks], np.int64).reshape(-1, 3)
                        at = np.minimum(np.searchsorted(nodes.value, keys), max(0, len(nodes.value) - 1))
                        flags = (nodes.value[at] == keys).any(axis=1).tolist() if len(nodes.value) else [False] * len(blocks)
                    kept = chosen(blocks, flags)
                    text = "\n".join(kept)
                    out.append((text, len(text), len(blocks) - len(kept)))
                columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["page_id", "url", "text", "n_chars", "removed"])

    return common.mapped(rows, run, "page_id long, url string, text string, n_chars long, removed long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
