"""Main text of web pages by a site style tree.

The pages of a host are merged: pages' elements meet in a style node if they have the same path of tags with
their class and id names. For each style node the tree keeps its presentations (which child tags appear) and,
as content, the features of its own text (hashes). A node's importance is the larger of two:

* presentation: the entropy of its presentations over the host's pages, base the number of those pages;
* content: one less the mean entropy of its features, a feature's entropy being that of its spread over the
  host's pages. A text that stands on all pages has entropy 1, one that stands on a single page 0.

A branch is worth what the best node in it is worth, less by ``DAMPING`` for each level between. Hosts of few
pages say little about their nodes: each node counts as important on ``PRIOR_PAGES`` further pages, so that a
host of a single page has no unimportant branch and no number of pages is a threshold. Pages of equal source are
one page of the tree.

From each page go the branches of low importance, inside an article too, and the branches that are noise by their
own tag, role or names, whose text may differ from page to page. A page's article or main element, if it has one,
bounds the text. Statistics are counted on all pages; a host's are summed up before and after the shuffle, so large
hosts need no large task.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, cut, slices, small

IMPORTANT = 0.35
DAMPING = 0.9
PRIOR_PAGES = 4

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NOISE_TAGS = frozenset(
    "nav header footer aside form script style noscript template head iframe object embed button select option input textarea label fieldset menu dialog svg math canvas audio video map figure".split()
) - {"figure"}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
MAIN_TAGS = frozenset(("article", "main"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions popup modal overlay
    cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription signup login
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager toc toolbar topbar
    header masthead footer foot colophon copyright sidebar aside rail widget widgets related recommended recommendations popular trending
    share sharing social comment comments commentlist respond disqus replies reply discussion form search searchbox skip""".split()
)
NOISE_STARTS = ("comment", "sidebar", "cookie", "advert", "sponsor", "newsletter", "breadcrumb", "footer", "navbar", "social", "related")

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
_NAME_PARTS = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")


def _is_noise(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in NOISE_TAGS and not (tag == "header" and in_main):
        return True
    if attributes:
        if attributes.get("role", "").lower() in NOISE_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
            return True
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        parts = [p for p in _NAME_PARTS.split(names) if p]
        if tag not in MAIN_TAGS and tag not in ("body", "html") and any(p in NOISE_NAMES or p.startswith(NOISE_STARTS) for p in parts):
            return True
    return False


class Page:
    """A page as a list of blocks: (path of style nodes, is noise, in main, text)."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[tuple[str, ...], bool, bool, str]] = []
        self.children: dict[tuple[str, ...], set[str]] = {}
        self._path: tuple[str, ...] = ()
        self._open: list[tuple[str, tuple[str, ...], bool, bool, bool]] = []  # tag, path before, noise, main, pre
        self._text: list[str] = []
        self._noise = self._main = False
        self._read(source or "")
        self._end_block()

    def _end_block(self) -> None:
        if self._text:
            text = _WHITE.sub(" ", html.unescape("".join(self._text))).strip()
            if text:
                self.blocks.append((self._path, self._noise, self._main, text))
            self._text = []

    def _enter(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK or tag in NOISE_TAGS:
            self._end_block()
        names = " ".join(sorted(f"{attributes.get('class', '')} {attributes.get('id', '')}".split()))
        name = f"{tag}.{names}" if names else tag
        self.children.setdefault(self._path, set()).add(name)
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            return
        self._open.append((tag, self._path, self._noise, self._main, False))
        self._noise = self._noise or _is_noise(tag, attributes, self._main)
        self._main = self._main or tag in MAIN_TAGS or attributes.get("role", "").lower() == "main"
        if tag in BLOCK or tag in NOISE_TAGS:
            self._path = (*self._path, name)

    def _leave(self, k: int) -> None:
        """Close the open elements from index k on."""
        while len(self._open) > k:
            tag, path, noise, main, _ = self._open.pop()
            if tag in BLOCK or tag in NOISE_TAGS:
                self._end_block()
            self._path, self._noise, self._main = path, noise, main

    def _last(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str] | tuple[str, ...]) -> int | None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in tags:
                return k
            if self._open[k][0] in stop:
                return None
        return None

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            if not found:
                self._text.append(source[at:])
                break
            if found.start() > at:
                self._text.append(source[at : found.start()])
            if found[1]:
                end = source.find("-->", found.end())
                at = size if end < 0 else end + 3
                continue
            if found[2]:
                end = source.find(">", found.end())
                at = size if end < 0 else end + 1
                continue
            tag = found[4].lower()
            closed = _TAG_END.match(source, found.end())
            inside_end = closed.end() if closed else (source.find(">", found.end()) + 1 or size)
            at = inside_end
            if found[3]:
                if tag == "p" and self._last(("p",), ()) is None:
                    continue
                stop = ("table",) if tag in ("td", "tr", "tbody", "thead") else ()
                k = self._last((tag,), stop)
                if k is not None:
                    self._leave(k)
                continue
            inside = source[found.end() : inside_end - 1]
            attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inside)} if inside.strip(" /") else {}
            if tag in CLOSES_P and (k := self._last(("p",), ("button", "td", "th"))) is not None:
                self._leave(k)
            elif tag == "li" and (k := self._last(("li",), ("ul", "ol", "menu"))) is not None:
                self._leave(k)
            elif tag in ("dd", "dt") and (k := self._last(("dd", "dt"), ("dl",))) is not None:
                self._leave(k)
            elif tag in ("td", "th") and (k := self._last(("td", "th"), ("table", "tr"))) is not None:
                self._leave(k)
            elif tag == "tr" and (k := self._last(("tr",), ("table",))) is not None:
                self._leave(k)
            elif tag == "option" and (k := self._last(("option",), ("select",))) is not None:
                self._leave(k)
            self._enter(tag, attributes)
            if tag in RAW and not inside.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
                if tag not in NOISE_TAGS and tag != "title" and end:
                    self._text.append("")

    def merged(self) -> list[tuple[tuple[str, ...], bool, bool, str]]:
        return [b for b in self.blocks if not any(step == "head" or step.startswith("title") for step in b[0])]


def _hash(*parts: str) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest("\x00".join(parts))], np.uint64).view(np.int64)[0])


def host_of(url: str | None) -> str:
    rest = (url or "").split("//", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


_FEATURES = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("node", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("feature", T.LongType()),
        T.StructField("pages", T.DoubleType()),
        T.StructField("chain", T.ArrayType(T.LongType())),
    ]
)
PAGE, PRESENTATION, CONTENT = 0, 1, 2


def features(pages: DataFrame) -> DataFrame:
    """host, node, kind, feature, pages, chain: on how many pages of the host the feature stands at the node.
    ``chain`` of a presentation: the node and those above it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=512, size=8 << 20):
            counts: dict[tuple[str, int, int, int], float] = {}
            chains: dict[int, list[int]] = {}
            for host, source, weight in zip(*(c.to_pylist() for c in part.columns), strict=True):
                page = Page(source)
                own = {(host, 0, PAGE, 0)}
                names: dict[tuple[str, ...], int] = {}
                for path in {b[0] for b in page.merged() if not b[1]}:
                    for k in range(1, len(path) + 1):
                        if path[:k] not in names:
                            names[path[:k]] = _hash(*path[:k])
                for path, node in names.items():
                    own.add((host, node, PRESENTATION, _hash(*sorted(page.children.get(path, ())))))
                    chains[node] = [names[path[:k]] for k in range(len(path), 0, -1)]
                for path, noise, _, text in page.merged():
                    if not noise:
                        own.add((host, names.get(path, 0), CONTENT, _hash(text)))
                for key in own:
                    counts[key] = counts.get(key, 0.0) + weight
            a, b, c, d = zip(*counts, strict=True)
            above = [chains[n] if k == PRESENTATION else None for n, k in zip(b, c, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64()), pa.array(list(counts.values()), pa.float64()), pa.array(above, pa.list_(pa.int64()))], names=_FEATURES.names
            )

    rows = columns(pages, url=T.StringType(), html=T.StringType()).select(host_column(F.col("url")).alias("host"), "html")
    # pages of equal source, told by hash before any is parsed, share the weight of one page
    marked = rows.withColumn("copy", F.xxhash64("html"))
    times = cut(marked.groupBy("host", "copy").agg(F.count("*").alias("times")).where("times > 1"), "page-copies")
    weighed = marked.join(small(times), ["host", "copy"], "left").select("host", "html", (1 / F.coalesce("times", F.lit(1))).alias("weight"))
    summed = weighed.mapInArrow(work, _FEATURES).groupBy("host", "node", "kind", "feature")
    return summed.agg(F.round(F.sum("pages"), 6).alias("pages"), F.first("chain").alias("chain"))


def importance(pages: DataFrame) -> DataFrame:
    """host, node, importance: what the branch below each style node is worth."""
    found = cut(features(pages), "features")
    totals = found.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("m"))
    seen = found.where(F.col("kind") != PAGE).join(cut(totals, "hosts"), "host")
    log_m = F.log("m")
    # a presentation's share p adds -p log p; a feature on k of m pages is spread evenly over them: log k / log m
    part = F.when(F.col("kind") == PRESENTATION, F.col("pages") * F.log("pages")).when(F.col("m") > 1, F.log("pages") / log_m).otherwise(0.0)
    sums = seen.groupBy("host", "node", "kind").agg(F.sum("pages").alias("n"), F.count("*").alias("features"), F.sum(part).alias("s"), F.first("m").alias("m"), F.first("chain", ignorenulls=True).alias("chain"))
    entropy = F.when(F.col("m") > 1, (F.log("n") - F.col("s") / F.col("n")) / log_m).otherwise(1.0)
    value = F.when(F.col("kind") == PRESENTATION, entropy).otherwise(1 - F.col("s") / F.col("features"))
    nodes = sums.withColumn("value", value).groupBy("host", "node").agg(F.max("value").alias("value"), F.first("m").alias("m"), F.first("chain", ignorenulls=True).alias("chain"))
    own = nodes.withColumn("value", (F.col("m") * F.col("value") + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES))
    above = own.select("host", "value", F.posexplode("chain").alias("levels", "node"))
    return above.groupBy("host", "node").agg(F.max(F.col("value") * F.pow(F.lit(DAMPING), F.col("levels"))).alias("importance"))


def low_nodes(pages: DataFrame, important: float = IMPORTANT) -> DataFrame:
    """host, nodes: the style nodes whose branches are of low importance."""
    return importance(pages).where(F.col("importance") < important).groupBy("host").agg(F.collect_list("node").alias("nodes"))


def main_text(page: Page, low: frozenset[int]) -> str:
    """Blocks in page order that are neither noise nor in a low branch, of the article if there is one. A page of
    low branches only keeps what is not noise."""
    blocks = [b for b in page.merged() if not b[1]]
    if any(b[2] for b in blocks):
        blocks = [b for b in blocks if b[2]]
    names: dict[tuple[str, ...], int] = {}

    def is_low(path: tuple[str, ...]) -> bool:
        for k in range(1, len(path) + 1):
            head = path[:k]
            if head not in names:
                names[head] = _hash(*head)
            if names[head] in low:
                return True
        return False

    kept = [b for b in blocks if not is_low(b[0])] if low else blocks
    return "\n\n".join(b[3] for b in kept or blocks)


def host_column(url: Column) -> Column:
    """The same rule as ``host_of``."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"^.*?//", ""), r"^([^/?#]*)", 1), "^.*@", ""))


_OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars. Null html counts as empty, and gives an empty text.

    A null url is the host "". Repeated rows each get a row and count once in the tree. Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = columns(pages, page_id=T.LongType(), url=T.StringType(), html=T.StringType())
    low = cut(low_nodes(pages), "low-nodes").withColumnRenamed("host", "low_host")
    joined = rows.withColumn("host", host_column(F.col("url"))).join(low, F.col("host") == F.col("low_host"), "left").select("page_id", "url", "html", "nodes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=512, size=8 << 20):
            texts = [main_text(Page(h), frozenset(n or ())) for h, n in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=_OUT.names)

    return joined.mapInArrow(work, _OUT)
