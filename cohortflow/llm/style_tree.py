"""Main text of web pages through a site style tree.

Pages of one host are merged into a tree of element paths. A node's presentation importance is the entropy of its child
layouts over the host's pages, its content importance falls with the entropy of its text blocks over the pages: what every page
repeats says nothing. Branches of low importance are removed from each page of the host. What an element's name, role or
class declares to be a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment has
importance 0 in any case, so hosts of a single page work, too. A class or id only names a layout where its branch holds the page's
main element, its article or, on a page without these, most of the text: such a branch is a node like others. The main element with its articles (else the articles, else the body) is read.

The tree is counted, never collected: pages emit (host, path, feature) rows, which combine before each shuffle.

Defined cases: a null or empty html gives the empty text; a null url or one without a host shares the empty host; rows
that repeat a page are counted and returned each; unclosed and stray tags follow the usual implied ends; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .common import slices

LOW = 0.5  # a branch is removed below this importance ...
CONTRAST = 0.6  # ... if it also is below this share of its parent's
MIN_PAGES = 5  # nothing is learnt from fewer pages
CONTENT_SHARE = 0.9

# Element names by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "select", "datalist"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "input", "textarea", "label"}
BLOCKS = {
    "html", "body", "article", "main", "section", "div", "header", "footer", "nav", "aside", "form", "fieldset", "menu", "dialog", "details", "summary",
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "address", "center",
    "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "hr", "hgroup",
}
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
MARKED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "comment", "comments", "disqus", "replies", "respond",
    "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "search", "form", "skip",
}
WORD_PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
SHARED_ANCHORS = ("article", "main")
LAYOUT_NAME = re.compile(r"(?:has|no|not|with|without)[-_].*|(?:long|short)[-_]?form|.*(?:content|main|page|site|layout|article|post|entry).*[-_](?:wrap|wrapper|container)")
# These never name a page's layout, however much text they hold.
NO_LAYOUT = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr",
    "newsletter", "comment", "comments", "disqus", "replies", "respond", "share", "sharing", "related", "recommended", "breadcrumb", "breadcrumbs",
}
OPTIONAL_END = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot"}


def low_by_name(tag: str, attrs: dict, inside: bool) -> set[str] | None:
    """The marked words of the element's class and id, the empty set where it declares otherwise that it is no content, else None."""
    if tag in ("html", "body", "article", "main"):
        return None
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return set()
    if (attrs.get("role") or "").lower() in ROLES:
        return set()
    if tag == "form":
        return {"form"}
    if tag in SILENT or tag in FURNITURE or (tag == "header" and not inside):
        return set()
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
    return {w for n in names if not LAYOUT_NAME.fullmatch(n) for w in WORD_PARTS.findall(n)} & MARKED or None


class Marked:
    """A branch that its element's name declares to be no content; whether that holds is known at the end of the page."""

    def __init__(self, words: set[str]) -> None:
        self.words = words
        self.closed = False  # by its own end tag, so all inside belongs to it
        self.anchors: set[str] = set()
        self.silent = True


class Page(HTMLParser):
    """One pass over a page: text blocks with the hashed path of their elements, and each element's child layout."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # tag, path, child tags with their own mark, marks of the branch (and whether an article or main stands between), own mark
        self.open: list[tuple[str, int, list, tuple, Marked | None]] = []
        self.silent: list[str] = []  # open elements inside one that cannot hold content
        self.marks: list[Marked] = []
        self.words: list[str] = []
        self.anchor: list[str] = []
        self._texts: list[tuple[tuple[int, ...], str, str | None, tuple]] = []
        self._nodes: list[tuple[int, int, list, tuple]] = []
        self.feed(html)
        self.close()
        self._flush()
        while self.open:
            self._pop()
        self._decide()
        nodes = [n for n in self._nodes if not self._dropped(n[3])]
        self.parents = {path: above for path, above, _, _ in nodes}
        self.layouts: list[tuple[int, int]] = []
        for path, _, children, _ in nodes:
            names = sorted({tag for tag, own in children if own is None or not own.silent})
            self.layouts.append((path, xxhash.xxh3_64_intdigest(" ".join(names))))
        # path and its ancestors, text, anchor
        self.blocks = [(tuple(p for p in paths if p in self.parents), text, anchor) for paths, text, anchor, marks in self._texts if not self._dropped(marks)]

    @staticmethod
    def _dropped(marks: tuple) -> bool:
        return any(m.silent and (m.closed or not under) for m, under in marks)

    def _decide(self) -> None:
        """Outer branches first: a marked branch that holds what the page is about only has a layout's name."""
        size = lambda rows: sum(len(t[1]) for t in rows)
        for mark in self.marks:
            if not mark.words:
                continue
            own = [t for t in self._texts if any(m is mark for m, _ in t[3])]
            if not own:
                continue
            anchored = {t[2] for t in self._texts if not self._dropped(t[3])} - {None}
            sure = [t for t in self._texts if not any(m.silent and not m.words and (m.closed or not under) for m, under in t[3])]
            most = 2 * size(own) > size(sure)
            if "main" in mark.anchors or ("article" in mark.anchors and (most or not anchored)):
                mark.silent = False
            elif most and not anchored and not any(m.anchors for m in self.marks) and NO_LAYOUT.isdisjoint(mark.words):
                mark.silent = False

    def _flush(self) -> None:
        if self.words:
            text = SPACE.sub(" ", "".join(self.words)).strip()
            self.words = []
            if text:
                self._texts.append((tuple(o[1] for o in self.open), text, self.anchor[0] if self.anchor else None, self.open[-1][3] if self.open else ()))

    def _pop(self, closed: bool = False) -> None:
        tag, path, children, marks, own = self.open.pop()
        self._nodes.append((path, self.open[-1][1] if self.open else 0, children, marks))
        if own is not None:
            own.closed = closed or tag in OPTIONAL_END
        if tag in SHARED_ANCHORS and self.anchor:
            self.anchor.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent == ["head"] and tag in BLOCKS:  # the head was not closed
            self.silent.clear()
        if self.silent and tag in SHARED_ANCHORS and self.silent[0] not in ("noscript", "template", "iframe"):  # nor was this
            self.silent.clear()
        if self.silent:
            if tag not in VOID:
                self.silent.append(tag)
            return
        if tag in VOID:
            if tag == "br":
                self.words.append(" ")
            elif tag == "hr":
                self._flush()
            return
        own = dict(attrs)
        words = low_by_name(tag, own, bool(self.anchor))
        if tag not in BLOCKS:
            if words is not None:
                self.silent.append(tag)
            return
        self._flush()
        if tag in ENDS_PARAGRAPH:
            self._end_implied({"p"})
        if tag in SAME_LEVEL:
            self._end_implied(SAME_LEVEL[tag])
        if tag in ("html", "body") and any(o[0] == tag for o in self.open):
            return
        mark = None if words is None else Marked(words)
        if self.open:
            self.open[-1][2].append((tag, mark))
        above, marks = (self.open[-1][1], self.open[-1][3]) if self.open else (0, ())
        if tag in SHARED_ANCHORS:
            for outer, _ in marks:
                outer.anchors.add(tag)
            marks = tuple((outer, True) for outer, _ in marks)
        if mark is not None:
            self.marks.append(mark)
            marks = (*marks, (mark, False))
        names = " ".join(sorted(WORD_PARTS.findall(f"{own.get('class') or ''} {own.get('id') or ''}".lower())))
        path = xxhash.xxh3_64_intdigest(f"{above}/{tag}.{names}")
        self.open.append((tag, path, [], marks, mark))
        if tag in SHARED_ANCHORS:
            self.anchor.append(tag)

    def _end_implied(self, tags: set) -> None:
        """Ends an open element of these names, unless a container stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if name in BLOCKS - {"p"}:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            elif tag in ("body", "html", "article", "main") or (tag in BLOCKS and any(o[0] == tag for o in self.open) and self.silent[0] not in SILENT):
                self.silent.clear()
                self.handle_endtag(tag)
            return
        if tag not in BLOCKS:
            return
        if any(o[0] == tag for o in self.open):
            self._flush()
            while self.open:
                done = self.open[-1][0] == tag
                self._pop(closed=done)
                if done:
                    break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.words.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parsed(html: str | None) -> Page:
    return Page(html or "")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def page_features(page: Page) -> list[tuple[int, int, int, int]]:
    """(path, parent, kind, feature), each once: kind 0 is the page itself, 1 a child layout, 2 a text block below the path."""
    out = {(path, above, 0, 0) for path, above in page.parents.items()}
    out |= {(path, page.parents[path], 1, layout) for path, layout in page.layouts}
    for paths, text, _ in page.blocks:
        digest = xxhash.xxh3_64_intdigest(text)
        out |= {(path, page.parents[path], 2, digest) for path in paths}
    return [(_signed(path), _signed(above), kind, _signed(feature)) for path, above, kind, feature in out]


def main_text(html: str | None, removed: set[int]) -> str:
    """Blocks of main and of an article around one (else the articles, else the page) outside the removed branches, one per line."""
    blocks = parsed(html).blocks
    found = {anchor for _, _, anchor in blocks}
    kept = [(text, anchor) for paths, text, anchor in blocks if removed.isdisjoint(paths)]
    anchors = [a for a in ("main", "article") if a in found] or [None]
    wanted = next((a for a in anchors if any(anchor == a for _, anchor in kept)), anchors[0])
    return "\n".join(text for text, anchor in kept if anchor == wanted)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """The other columns of each page, its tree features as four parallel arrays and its blocks as three, from one parse of column html."""
    kept = [f for f in pages.schema if f.name != "html"]
    arrays = {
        "path": ArrayType(LongType()), "parent": ArrayType(LongType()), "kind": ArrayType(IntegerType()), "feature": ArrayType(LongType()),
        "chains": ArrayType(ArrayType(LongType())), "texts": ArrayType(StringType()), "anchors": ArrayType(StringType()),
    }
    schema = StructType([*kept, *[StructField(name, kind) for name, kind in arrays.items()]])
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html"):
                columns: dict[str, list] = {name: [] for name in arrays}
                for html in piece.column("html").to_pylist():
                    page = parsed(html)
                    for name, values in zip(("path", "parent", "kind", "feature"), zip(*page_features(page)) if page.parents else ((), (), (), ())):
                        columns[name].append(values)
                    columns["chains"].append([[_signed(p) for p in paths] for paths, _, _ in page.blocks])
                    columns["texts"].append([text for _, text, _ in page.blocks])
                    columns["anchors"].append([anchor for _, _, anchor in page.blocks])
                found = [pa.array(columns[name], arrow.field(name).type) for name in arrays]
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name).cast(arrow.field(f.name).type) for f in kept], *found], schema=arrow)

    return pages.mapInArrow(parse, schema)


def style_tree(pages: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(host, path, parent, pages, importance): one row per node of each host's tree. Needs columns host and html."""
    return tree_of(parsed_pages(pages.select("host", "html")), content_share)


def tree_of(parsed_rows: DataFrame, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The tree of pages parsed before."""
    features = parsed_rows.select("host", F.inline(F.arrays_zip("path", "parent", "kind", "feature")))
    counted = features.groupBy("host", "path", "parent", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    c, kind = F.col("c").cast("double"), F.col("kind")
    node = counted.groupBy("host", "path", "parent").agg(
        F.max(F.when(kind == 0, F.col("c"))).alias("pages"),
        F.sum(F.when(kind == 1, c)).alias("layouts"),
        F.sum(F.when(kind == 1, c * F.ln(c))).alias("layout_log"),
        F.sum(F.when(kind == 2, c)).alias("blocks"),
        F.sum(F.when(kind == 2, c * F.ln(c))).alias("block_log"),
    )
    m = F.ln(F.col("pages").cast("double"))
    layout = (F.ln("layouts") - F.col("layout_log") / F.col("layouts")) / m  # entropy of the layouts, to base pages
    content = F.lit(1.0) - F.col("block_log") / F.col("blocks") / m  # a block on c pages has entropy log c
    mixed = F.when(F.col("blocks").isNull(), layout).otherwise(F.lit(1 - content_share) * layout + F.lit(content_share) * content)
    return node.select("host", "path", "parent", "pages", F.when(F.col("pages") > 1, mixed).otherwise(1.0).alias("importance"))


def low_branches(tree: DataFrame, low: float = LOW, contrast: float = CONTRAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path): the branches whose importance is low, in itself and next to its parent's."""
    above = tree.select("host", F.col("path").alias("parent"), F.col("importance").alias("above"))
    poor = tree.filter((F.col("pages") >= min_pages) & (F.col("importance") < low)).join(above, ["host", "parent"])
    return poor.filter(F.col("importance") < contrast * F.col("above")).select("host", "path")


def kept_text(removed: Column) -> Column:
    """What `main_text` returns, of the arrays of `parsed_pages`."""
    blocks = F.arrays_zip("chains", "texts", "anchors")
    kept = F.filter(blocks, lambda b: ~F.arrays_overlap(b["chains"], removed))
    of = lambda name: F.filter(kept, lambda b: b["anchors"].eqNullSafe(F.lit(name)))
    anchored = F.exists("anchors", lambda a: a.isNotNull())
    wanted = F.when(F.size(of("main")) > 0, of("main")).when((F.size(of("article")) > 0) | anchored, of("article")).otherwise(kept)
    return F.array_join(F.transform(wanted, lambda b: b["texts"]), "\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A page is parsed once. The branches to remove come to it by (host, path), a page's own at most. They are written before the
    texts are joined, so that their size is known and the texts only move where it is large.
    """
    rows = cut_lineage(parsed_pages(with_host(pages)).withColumn("row", F.monotonically_increasing_id()))
    low = cut_lineage(low_branches(cut_lineage(tree_of(rows))))
    own = rows.select("row", "host", F.explode(F.array_distinct(F.flatten("chains"))).alias("path"))
    removed = cut_lineage(own.join(low, ["host", "path"]).groupBy("row").agg(F.collect_list("path").alias("removed")))
    none = F.array().cast("array<bigint>")
    texts = rows.join(removed, "row", "left").select("page_id", "url", kept_text(F.coalesce("removed", none)).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
