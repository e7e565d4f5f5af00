"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: its nodes are the paths of block elements
(tag and class from the root down), and each knows how many pages have it, which contents
it had there and which sequences of child elements. The importance of a node is the
normalised entropy of both: near 0 where every page repeats the same thing in the same
form (menus, boxes, boilerplate), near 1 where pages differ. Branches of low importance are
removed from each page, but where a block holds most of the text that the vote leaves and is not what
the node mostly holds, only the parts of it that repeat go. Pages of a host with the same contents count
once, so a page that is copied many times is no boilerplate. Elements whose tag, role or class says that they are no part of an
article (menus, headers, footers, sidebars, notices, adverts, forms, reader comments,
scripts, styles, hidden parts) are removed whatever their importance. Blocks inside articles and
main parts are judged like all others; the article or main element itself and the elements around
it are not removed, and where the vote would take half of the text of an article or main part or
more, that part is left as it is. What is left decides where the main text is: in the articles, if
the longest of them has no less text than lies outside all articles; else in the main parts, by the
same comparison; else it is the text of the body, articles included.

Defined results: a null or empty page gives an empty text. Pages without host, and nodes
that fewer than ``least_pages`` pages of the host have, are not judged by the tree. Where
the tree would remove all of a page's text it does not vote on that page. Broken markup is
read as browsers do in simple cases: unclosed elements end with their parent, stray end tags
are ignored. Pages are read whole; rows that repeat and other columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwater.llm.tables import col, small_batches, written

# Element names and the words by which pages mark what is no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr script style template".split())
NO_TEXT_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select "
                         "textarea dialog menu head title map audio video math datalist".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NO_TEXT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion sidebar "
                          "sidenav menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup "
                          "modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
                          "comment comments commentlist replies disqus toolbar pagination pager widget widgets banner masthead".split())
OUTSIDE_WORDS = frozenset(["header", "topbar"])  # no article text unless inside an article
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
LIST_ROOTS = frozenset("ul ol dl table tbody select body article main section div".split())
MARKS = LIST_ROOTS.union(*CLOSES.values())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
                 r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z0-9]+")
DEEPEST = 64  # elements below belong to their ancestor at this depth, in the tree only


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _says_no_text(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    if tag in NO_TEXT_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in NO_TEXT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    named = set(WORDS.findall((attributes.get("class", "") + " " + attributes.get("id", "")).lower()))
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return not named.isdisjoint(("comment", "comments", "related", "recommended", "ad", "ads", "sponsored", "promo"))
    return not named.isdisjoint(NO_TEXT_WORDS) or (not inside and not named.isdisjoint(OUTSIDE_WORDS))


class _Element:
    __slots__ = ("tag", "silent", "scope", "opens", "path", "start", "end", "children", "block", "holds", "inner")

    def __init__(self, tag, silent, scope, opens, path, start, block):
        self.tag, self.silent, self.scope, self.opens, self.path, self.start, self.block = tag, silent, scope, opens, path, start, block
        self.end = start
        self.holds = False  # an article or a main part
        self.children: list[str] = []
        self.inner: list[_Element] = []  # blocks


def _squeezed(parts: Iterable[str]) -> str:
    return " ".join("".join(parts).split())


class Page:
    """One page read from front to back: its text in parts, and its blocks for the style tree."""

    def __init__(self, html: str):
        self.parts: list[str] = []
        self.scopes: list[tuple[int, int]] = []  # number of the article and of the main part around each part, 0 for none
        self.opened = 0
        self.around = [(0, 0)]
        self.stack: list[_Element] = [_Element("", False, "", False, "", 0, True)]
        self.root = self.stack[0]
        # Of the open elements: how many of each name, the blocks, and those that implied ends look at.
        self.open_names: Counter[str] = Counter()
        self.blocks, self.marks = [self.root], []
        self._read(html)
        self.root.end = len(self.parts)

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.silent or not raw:
            return
        self.parts.append(unescape(raw) if "&" in raw else raw)
        self.scopes.append(self.around[-1])

    def _break(self) -> None:
        if self.parts and self.parts[-1] != " ":
            self.parts.append(" ")
            self.scopes.append(self.around[-1])

    def _pop(self) -> None:
        e = self.stack.pop()
        self.open_names[e.tag] -= 1
        if e.block:
            self.blocks.pop()
            self._break()
        if e.tag in MARKS:
            self.marks.pop()
        if e.opens:
            self.around.pop()
        e.end = len(self.parts)
        if e.opens or e.holds:
            self.stack[-1].holds = True

    def _close(self, tag: str) -> None:
        if self.open_names[tag] > 0:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def _implied_ends(self, tag: str, block: bool) -> None:
        if tag in CLOSES:
            for e in reversed(self.marks):
                if e.tag in CLOSES[tag]:
                    self._close(e.tag)
                    return
                if e.tag in LIST_ROOTS:
                    return
        elif block and self.blocks[-1].tag == "p":
            self._close("p")

    def _open(self, tag: str, attributes: dict[str, str]) -> None:
        block = tag not in INLINE
        self._implied_ends(tag, block)
        parent = self.stack[-1]
        if block:
            self._break()
        scope = parent.scope
        silent, opens = parent.silent or _says_no_text(tag, attributes, bool(scope)), False
        if not silent and (tag == "article" or attributes.get("itemprop", "").lower() == "articlebody"):
            scope, opens = "article", True
        elif not silent and not scope and (tag == "main" or attributes.get("role", "").lower() == "main"):
            scope, opens = "main", True
        path = parent.path
        if block and len(self.stack) <= DEEPEST:
            path += "/" + tag + "".join("." + w for w in sorted(WORDS.findall(attributes.get("class", "").lower())))
            parent.children.append(tag)
        if tag in VOID:
            return
        if opens:
            self.opened += 1
            article, main = self.around[-1]
            # An article inside an article is a part of it.
            self.around.append((article or self.opened, main) if scope == "article" else (article, self.opened))
        e = _Element(tag, silent, scope, opens, path, len(self.parts), block)
        if block and not silent and path != parent.path:
            self.blocks[-1].inner.append(e)
        self.stack.append(e)
        self.open_names[tag] += 1
        if block:
            self.blocks.append(e)
        if tag in MARKS:
            self.marks.append(e)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            self._text(html[at:m.start()])
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if closing:
                if tag not in INLINE:
                    self._break()
                self._close(tag)
                continue
            self._open(tag, _attributes(rest))
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                self._close(tag)
        while len(self.stack) > 1:
            self._pop()

    def nodes(self) -> dict[str, list[tuple[str, str]]]:
        """Content and child sequence of the blocks that the tree judges, by path."""
        found: dict[str, list[tuple[str, str]]] = {}

        def walk(e: _Element) -> None:
            for x in e.inner:
                walk(x)
                if not x.opens:
                    found.setdefault(x.path, []).append((_squeezed(self.parts[x.start:x.end]), ",".join(x.children)))

        walk(self.root)
        return found

    def _length(self, e: _Element) -> int:
        return len(_squeezed(self.parts[e.start:e.end]))

    def _voted_out(self, e: _Element, low: dict[int, int], repeated: dict[str, int] | None = None) -> list[_Element]:
        """Elements inside ``e`` that the tree removes; with ``repeated``, the contents of this page by path, only
        those that hold what their node mostly holds."""
        out: list[_Element] = []
        for x in e.inner:
            node = node_id(x.path)
            if x.tag not in ("html", "body") and not x.opens and not x.holds and node in low and (
                    repeated is None or repeated[x.path] == low[node]):
                out.append(x)
            else:
                out += self._voted_out(x, low, repeated)
        return [] if e.opens and out and 2 * sum(map(self._length, out)) >= self._length(e) else out

    def _removed(self, low: dict[int, int]) -> list[_Element]:
        out = self._voted_out(self.root, low)
        rest = self._length(self.root) - sum(map(self._length, out))
        large = [x for x in out if self._length(x) > max(rest, 0)]
        if not large:
            return out
        contents = {path: value_of(found, 0) for path, found in self.nodes().items()}
        unlike = [x for x in large if contents[x.path] != low[node_id(x.path)]]
        kept = [x for x in out if x not in unlike]
        return kept + [y for x in unlike for y in self._voted_out(x, low, contents)]

    def text(self, low: dict[int, int] | None = None) -> str:
        gone = np.zeros(len(self.parts), bool)
        for e in self._removed(low) if low else ():
            gone[e.start:e.end] = True
        # A removed block still parts what is before and behind it.
        left = [(" " if g else p, s) for g, p, s in zip(gone, self.parts, self.scopes)]
        for kind in (0, 1):
            inside: dict[int, list[str]] = {}
            for p, s in left:
                inside.setdefault(s[kind], []).append(p)
            outside = len(_squeezed(inside.pop(0, ())))
            longest = max((len(_squeezed(x)) for x in inside.values()), default=0)
            if longest and longest >= outside:
                return _squeezed(p if s[kind] else " " for p, s in left)
        return _squeezed(p for p, _ in left)


def node_id(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path) - (1 << 63)


def value_of(found: list[tuple[str, str]], kind: int) -> int:
    """Hash of the contents (0) or child sequences (1) that a page has at a path."""
    return node_id("\n".join(x[kind] for x in found))


def extract(html: str, low: dict[int, int] | None = None) -> str:
    """Main text; ``low`` has the nodes of low importance of the host, and the content that each mostly holds."""
    page = Page(html)
    return page.text(low) or (page.text() if low else "")


def host_of(url: Column) -> Column:
    """Host in lower case; null where the address has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", content_weight: float = 0.9) -> DataFrame:
    """Nodes of the style trees of all hosts: host, node, pages (of unlike contents), importance, common (content that most of them have).

    Every page sends its nodes as hashes; equal pages of a host are made one, and contents and child
    sequences are counted, before and after a shuffle, so a host with a large part of the pages is no hot spot.
    """
    given = pages.select(host_of(col(url_col)).alias("host"), col(html_col).alias("html")).where("host is not null and html is not null")
    names = ["host", "page", "node", "content", "children"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html in batch.column(1):
                paths = sorted(Page(html.as_py()).nodes().items())
                lists = [[node_id(p) for p, _ in paths], *([value_of(x, kind) for _, x in paths] for kind in (0, 1))]
                found.append((node_id(repr(lists)), *lists))
            columns = [pa.array([f[k] for f in found], pa.int64() if k == 0 else pa.list_(pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    read = small_batches(given).mapInArrow(run, "host string, page bigint, node array<bigint>, content array<bigint>, children array<bigint>")
    unlike = read.groupBy("host", "page").agg(F.first(F.struct(*names[2:])).alias("p"))
    nodes = unlike.select("host", F.explode(F.arrays_zip("p.node", "p.content", "p.children")).alias("n"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n.{c}").alias("value")) for k, c in enumerate(names[3:])])
    seen = nodes.select("host", "n.node", F.inline(kinds))
    counts = seen.groupBy("host", "node", "kind", "value").agg(F.count("*").cast("double").alias("n"))
    entropies = counts.groupBy("host", "node", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"),
                                                           F.max(F.struct("n", "value"))["value"].alias("common"))
    share = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, content_weight).otherwise(1 - content_weight)
    return entropies.groupBy("host", "node").agg(F.max("pages").cast("long").alias("pages"), F.sum(share * weight).alias("importance"),
                                                 F.max(F.when(F.col("kind") == 0, F.col("common"))).alias("common"))


def main_text(pages: DataFrame, keep: list[Column], url_col: str = "url", html_col: str = "html",
              lowest: float = 0.2, least_pages: int = 5) -> DataFrame:
    """``keep`` columns and the main text of every page."""
    tree = style_tree(pages, url_col, html_col).where((F.col("importance") < lowest) & (F.col("pages") >= least_pages))
    # Nodes that are common on a host are few, however many pages it has.
    low = written(tree.groupBy("host").agg(F.sort_array(F.collect_list(F.array("node", "common"))).alias("low")), "low-nodes")
    given = pages.select(*keep, col(html_col).alias("_html_"), host_of(col(url_col)).alias("_host_"))
    given = given.join(low.withColumnRenamed("host", "_host_").withColumnRenamed("low", "_low_"), "_host_", "left").drop("_host_")
    kept = given.drop("_html_", "_low_")
    names = [*kept.columns, "text"]
    schema = kept.withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, low = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            texts = [extract(h.as_py() or "", dict(x.as_py() or ())) for h, x in zip(html, low)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=names)

    return small_batches(given).mapInArrow(run, schema)
