"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: a node of the tree is a path of elements (tag and classes), with all contents
and all sequences of child elements (its styles) that pages have there. For a node on m pages, a content on c of
them counts 1 - log c / log m, and styles count with their entropy to the base m. A node matters if either varies:
importance = 1 - (1 - content) * (1 - style). Every block of every page is part of the tree; pages with the same
texts are one page. What a node is by its tag, role or class is a weight on its importance. Menus, footers, forms,
adverts and the like always go. What stands in an article counts more; there, a class that may or may not name such a
thing only makes a node doubtful, and one on a paragraph or a word says nothing. Nodes whose weighted importance is below
``LEAST`` are removed from each page with all that is under them.

A host's own tree tells of a node that ``PAGES`` of its pages have; else the tree of all hosts tells, if it is on
``PAGES_OF_ALL`` pages of ``HOSTS`` hosts; else nothing but the weight does. Where articles hold most of what is left of a
page, only they are taken.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .url_filter import split_url
from .workers import frugal

LEAST = 0.6
PAGES, PAGES_OF_ALL, HOSTS = 6, 30, 3
#: One node in so many pages of a host, or of all, is too rare for the tree. So a host has at most so many times the
#: mean number of nodes of a page, and all hosts so many.
RARE, RARE_OF_ALL = 200, 2000
#: Models with at most so many nodes are sent to all executors; larger ones are joined by host.
BROADCAST_ROWS = 200_000
#: Weights: an element that is no main text by what it is; one in an article that may be none; others in an article;
#: one that is never removed as a whole.
NOISE, DOUBT, INSIDE, WHOLE = 0.5, 0.8, 1.5, 10.0
#: Elements by kind, and words of classes, ids and roles.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg object".split())
NEVER = frozenset("head nav footer aside form button select menu dialog".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices sidebar comment comments disqus respond reply replies nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social related newsletter subscribe popup modal widget complementary contentinfo search alert".split()
)
#: Of these words, those that rule out a part of an article, and elements that such words don't rule out.
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent comment comments disqus respond reply replies nav navbar navigation breadcrumb breadcrumbs share sharing newsletter subscribe popup modal".split())
TEXTUAL = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that say nothing beside such a word: ``page-footer`` is a footer, ``share-price`` is not for sharing.
NEUTRAL = frozenset("area bar block bottom box button buttons container content form global group inner item items left link links list main media outer overlay page panel primary right secondary section site slot text top unit wrap wrapper zone".split())
#: Elements that a start tag closes if they are open: by HTML's rules for omitted end tags.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which such closing doesn't look.
SCOPES = frozenset("article aside blockquote body dl div footer form header html main nav ol section table ul".split())

#: Quotes hold a value only behind an equals sign; elsewhere, or unclosed, they are letters like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z0-9]+")
#: In the page itself: a copy in lower case may be longer, which moves all places.
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}


def says_noise(name: str) -> bool:
    """Whether a class, id or role names something that is no main text: all its words do, or are neutral."""
    parts = PART.findall(name.lower())
    return any(p in HINTS for p in parts) and all(p in HINTS or p in NEUTRAL or p.isdigit() for p in parts)


def says_strong(name: str) -> bool:
    """Whether such a name also rules out a part of an article."""
    return any(p in STRONG for p in PART.findall(name.lower()))


class Page:
    """Blocks of a page in order: (text, path, weights of the path's elements), and of each path the children's
    sequence."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, tuple[str, ...], tuple[float, ...]]] = []
        self.children: dict[tuple[str, ...], list[str]] = {}
        self.path: list[str] = []  # names of open elements with classes
        self.tags: list[str] = []
        self.weights: list[float] = []
        self.hidden = 0  # open elements inside a block that are no main text: they have no node, and go at once
        self.text: list[str] = []
        self._read(source)

    def _end_block(self) -> None:
        if self.text:
            text = " ".join(html.unescape("".join(self.text)).split())
            self.text.clear()
            if text and "head" not in self.tags:
                k = max((i for i, t in enumerate(self.tags) if t in BLOCKS), default=-1)
                self.blocks.append((text, tuple(self.path[: k + 1]), tuple(self.weights[: k + 1])))

    def _close(self, k: int) -> None:
        """Closes all open elements from the k-th on."""
        if any(t in BLOCKS for t in self.tags[k:]):
            self._end_block()
        self.hidden -= sum([w == NOISE and t not in BLOCKS for t, w in zip(self.tags[k:], self.weights[k:], strict=True)])
        del self.tags[k:], self.path[k:], self.weights[k:]

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._end_block()
            ends = CLOSES.get(tag, set()) | {"p"}
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] in ends:
                    self._close(k)
                    break
                if self.tags[k] in SCOPES:
                    break
        if tag in VOID or attributes.endswith("/"):
            if tag == "br":
                self.text.append(" ")
            return
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)} if "=" in attributes else {}
        names = " ".join(named.values()).split()
        inside = "article" in self.tags or "main" in self.tags
        noise = tag in NEVER or (not inside and (tag == "header" or (tag not in HEADINGS and any("header" in PART.findall(n.lower()) for n in names))))
        if tag in ("html", "body", "article", "main"):
            weight = WHOLE
        elif noise:
            weight = NOISE
        elif hints := [n for n in names if says_noise(n)]:
            if not inside or (tag in BLOCKS - TEXTUAL and any(map(says_strong, hints))):
                weight = NOISE
            else:
                weight = DOUBT if tag in BLOCKS - TEXTUAL else INSIDE
        else:
            weight = INSIDE if inside else 1.0
        self.hidden += weight == NOISE and tag not in BLOCKS
        name = ".".join([tag, *sorted(named.get("class", "").split())])
        if tag in BLOCKS:
            self.children.setdefault(tuple(self.path), []).append(name)
        self.tags.append(tag)
        self.path.append(name)
        self.weights.append(weight)

    def _read(self, source: str) -> None:
        at = 0
        while (m := TAG.search(source, at)) is not None:
            if m.start() > at and not self.hidden:
                self.text.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                for k in range(len(self.tags) - 1, -1, -1):
                    if self.tags[k] == tag:
                        self._close(k)
                        break
                    if self.tags[k] in ("body", "html") or (self.tags[k] in SCOPES and tag not in SCOPES):
                        break
            elif tag in RAW and not m[3].endswith("/"):
                end = ENDS[tag].search(source, at)
                at = len(source) if end is None else (source.find(">", end.end()) + 1 or len(source))
            else:
                self._open(tag, m[3])
        if not self.hidden:
            self.text.append(source[at:])
        self._end_block()

    def nodes(self) -> dict[tuple[str, ...], tuple[int, int]]:
        """For each path with text: hashes of its whole content and of its sequence of children, repeats left out."""
        contents: dict[tuple[str, ...], list[str]] = {}
        for text, path, _ in self.blocks:
            for k in range(1, len(path) + 1):
                contents.setdefault(path[:k], []).append(text)
        out = {}
        for path, texts in contents.items():
            kids = self.children.get(path, [])
            style = [b for a, b in zip([None, *kids], kids, strict=False) if a != b]
            out[path] = _hash("\n".join(texts)), _hash("\n".join(style))
        return out

    def main(self, importance: Callable[[int], float]) -> str:
        known: dict[tuple[str, ...], float] = {}

        def stays(path: tuple[str, ...], weights: tuple[float, ...]) -> bool:
            for k in range(1, len(path) + 1):
                if path[:k] not in known:
                    known[path[:k]] = importance(_path(path[:k]))
                if weights[k - 1] * known[path[:k]] < LEAST:
                    return False
            return True

        left = [(text, any(x.split(".")[0] in ("article", "main") for x in path)) for text, path, weights in self.blocks if weights.count(WHOLE) == len(weights) or stays(path, weights)]
        size = sum(len(text) if inside else -len(text) for text, inside in left)
        articles = any(inside for _, inside in left) and size >= 0
        return "\n\n".join([text for text, inside in left if inside or not articles])


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def _path(path: tuple[str, ...]) -> int:
    return _hash("\t".join(path))


def _nodes(pages: DataFrame) -> DataFrame:
    """Distinct (host, page, path, content, style) of (host, html); ``page`` is a hash of the page's texts. Each page
    also has a node with path 0."""
    kinds = [pa.string(), *[pa.int64()] * 4]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for host, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(source.as_py() or "")
                key = _hash("\n".join([t for t, _, _ in page.blocks]))
                rows.append((host, key, 0, 0, 0))
                rows += [(host, key, _path(p), content, style) for p, (content, style) in page.nodes().items()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "path", "content", "style"])

    return pages.mapInArrow(run, "host string, page bigint, path bigint, content bigint, style bigint").distinct()


def _importance(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, importance) of counted (keys, content, style, c)."""
    part = lambda kind, m, s: counted.groupBy(*keys, kind).agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum("c").alias(m), F.sum(F.col("c") * F.ln("c")).alias(s))
    # The mean of 1 - log c / log m over pages, and the entropy to the base m, are the same expression.
    share = lambda m, s: F.when(F.col(m) > 1, 1 - F.col(s) / (F.col(m) * F.ln(m))).otherwise(1.0)
    both = part("content", "m", "s").join(part("style", "m2", "s2"), list(keys))
    return both.select(*keys, "m", (1 - (1 - share("m", "s")) * (1 - share("m2", "s2"))).alias("importance"))


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, path, m, importance) of nodes in the merged DOMs of (host, html) that ``PAGES`` pages have, and (path, m,
    importance) of nodes that count for all hosts."""
    counted = cut(_nodes(pages).groupBy("host", "path", "content", "style").agg(F.count(F.lit(1)).alias("c")), "nodes")
    sizes = counted.where("path = 0").groupBy("host").agg(F.sum("c").alias("size"))
    nodes = counted.where("path <> 0")
    own = _importance(nodes, "host", "path").where(F.col("m") >= PAGES).join(sizes, "host").where(F.col("m") * RARE >= F.col("size")).drop("size")
    size = counted.where("path = 0").agg(F.sum("c")).first()[0] or 0
    hosts = nodes.select("path", "host").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("hosts"))
    every = _importance(nodes.groupBy("path", "content", "style").agg(F.sum("c").alias("c")), "path")
    every = every.where((F.col("m") >= PAGES_OF_ALL) & (F.col("m") * RARE_OF_ALL >= size)).join(hosts.where(F.col("hosts") >= HOSTS), "path").drop("hosts")
    return own, every


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id, url, text, n_chars.

    Null and empty html give the empty text, as do pages that have no main text. A null url or one without ``://``
    belongs to the host with the empty name. Repeated rows are pages like others. Unclosed and stray tags are read
    as browsers do in the main; a page cut off at any place gives what it has. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), split_url(F.col(url_col))[0].alias("host"))
    own, every = style_tree(rows.select("host", "html"))
    # Without noise, which always goes, no weight is below DOUBT: of more important nodes only those that overrule count.
    every = cut(every.where(F.col("importance") < LEAST / DOUBT), "nodes-of-all")
    general = {r.path: r.importance for r in every.collect()}  # a bounded number
    overruled = F.broadcast(every.select("path", F.lit(True).alias("general")))
    own = own.join(overruled, "path", "left").where((F.col("importance") < LEAST / DOUBT) | F.col("general"))
    model = cut(own.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("known"), F.count(F.lit(1)).alias("k")), "style-tree")
    size = model.agg(F.sum("k")).first()[0] or 0
    chosen = model.select("host", "known")
    joined = rows.join(F.broadcast(chosen) if size <= BROADCAST_ROWS else chosen, "host", "left").select("id", "url", "html", "known")
    shared = pages.sparkSession.sparkContext.broadcast(general)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        general = shared.value
        for b in batches:
            texts = []
            for source, known in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                mine = {x["path"]: x["importance"] for x in known or ()}
                texts.append(Page(source.as_py() or "").main(lambda path, mine=mine: mine[path] if path in mine else general.get(path, 1.0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
