"""Main text of pages: site templates are found by counting element subtrees per host, and removed with other furniture.

A first pass gives every element two hashes: of its subtree, and of the shape of its subtree (elements and classes without
text, runs of like children as one) with the path to it. Spark counts on how many pages of a host each occurs, menus and
footers included. A subtree found on many pages of its host is template and is deleted; so is a list of links whose shape is
found on many, outside of marked articles, whatever its links say. What the counts leave open (adverts and notices that
change) is told by its element or by the names in its class, id and role; inside an article a class only counts by its last
part and an id as a whole, and no id makes a heading furniture. If a page marks its article (``article``, ``main``), only what
stands inside is taken; inside, paragraphs, headings, items and cells are the article's own however often a host repeats
them, but blocks that hold others (``GROUPS``) are deleted like template elsewhere, unless no text of the page's articles would
be left. On pages without marks the largest deleted block comes back if what is left has less than a tenth of its words.

A hash counts as template by a number of pages, however large the host, and some of them must be pages of their own:
copies of a page, and crawls repeated, make no template of what it says. Pages get theirs by joining on host and hash.

Defined results: a null or empty html, and a page without main text, give the empty text; broken markup is read as far as it
goes (an unclosed element ends with its parent, an unclosed comment or script with the page); pages without a url belong
to one host of their own; repeated rows are read each; an empty table gives an empty result; other columns pass through,
and columns of theirs called like a result are replaced.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import stored, text_of, unused

#: A subtree is template if it is on so many pages of its host, so many of them different.
MIN_PAGES, MIN_BODIES = 5, 4
#: A subtree is a list of links if it has so many, with half of its words or more.
MIN_LINKS = 3

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^<>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME_GAP = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe svg annotation".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr math mrow mi mn mo mtext ms msup msub msubsup mfrac msqrt mroot semantics".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new one of the same group ends, and where the search for an open one stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article main section div body html aside nav header footer form blockquote".split())

#: Elements that may be template inside a marked article.
GROUPS = frozenset("div section table ul ol dl figure center details fieldset address hgroup".split())

ROOTS = frozenset(("article", "main"))
FURNITURE = frozenset("head nav footer aside form dialog menu button select object canvas audio video".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice"
    " alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus"
    " respond share sharing social related newsletter subscribe subscription signup login popup modal overlay widget"
    " contentinfo complementary search toolbar pagination skip".split()
)
#: Elements that only a whole class, id or role makes furniture; in theirs, words like "no-sidebar" speak of the layout.
WHOLE_NAMES = frozenset("html body main article".split())


def named_parts(tag: str, names: dict[str, set[str]], inside_root: bool) -> set[str]:
    """The parts of an element's names that may say that it is furniture."""
    whole = set().union(*names.values())
    if tag in WHOLE_NAMES:
        return whole
    if not inside_root:
        known = set().union(*(found for kind, found in names.items() if kind != "id" or tag not in HEADINGS))
        return {part for name in known for part in NAME_GAP.split(name)}
    # Ids inside an article are made from its headings; of a class the last part is what the element is.
    ids = set() if tag in HEADINGS else names.get("id", set())
    rest = set().union(*(found for kind, found in names.items() if kind != "id"))
    # The header of an article holds its title.
    return (ids | {NAME_GAP.split(name)[-1] for name in rest}) - {"header"}


class Element:
    __slots__ = (
        "tag", "parent", "start", "end", "furniture", "root", "says", "parts", "digest", "shapes", "path", "shape", "words",
        "linked", "links",
    )

    def __init__(self, tag: str, parent: Element | None, start: int, names: dict[str, set[str]], inside_root: bool):
        self.tag, self.parent, self.start, self.end = tag, parent, start, start
        whole = set().union(*names.values())
        named = tag not in ("html", "body") and bool(named_parts(tag, names, inside_root) & FURNITURE_NAMES)
        self.furniture = tag in FURNITURE or named or (tag == "header" and not inside_root)
        self.root = not named and (tag in ROOTS or "main" in whole and tag not in INLINE)
        self.says = False
        self.parts: list[bytes] = [tag.encode()]
        self.digest = self.shape = 0
        name = " ".join((tag, *sorted(names.get("class", ())))).encode("utf-8", "surrogatepass")
        self.shapes: list[bytes] = [name]
        self.path = (parent.path if parent else b"")[-200:] + b"/" + name
        self.words = self.linked = 0
        self.links = int(tag == "a")


def parsed(page: str) -> tuple[list[Element], list[str]]:
    """Elements in page order and the pieces of text between tags; an element spans pieces start to end."""
    import xxhash

    elements: list[Element] = []
    pieces: list[str] = []
    stack: list[Element] = []
    place, roots = 0, 0

    def close(down_to: int) -> None:
        nonlocal roots
        while len(stack) > down_to:
            element = stack.pop()
            element.end = len(pieces)
            roots -= element.root
            own = xxhash.xxh64_digest(b"\x00".join(element.parts))
            element.digest = int.from_bytes(own, "big", signed=True)
            shape = xxhash.xxh64_digest(b"\x00".join(element.shapes))
            element.shape = xxhash.xxh64_intdigest(b"\x01".join((shape, element.path))) - (1 << 63)
            element.parts, element.shapes = [], []
            if element.tag == "a":
                element.linked = element.words
            if stack:
                above = stack[-1]
                above.parts.append(own)
                if above.shapes[-1] != shape:
                    above.shapes.append(shape)
                above.words += element.words
                above.linked += element.linked
                above.links += element.links

    def say(piece: str) -> None:
        if piece:
            pieces.append(piece)
            if stack:
                stack[-1].says |= not piece.isspace()
                stack[-1].words += len(piece.split())
                stack[-1].parts.append(piece.encode("utf-8", "surrogatepass"))

    while match := TOKEN.search(page, place):
        say(page[place : match.start()])
        place = match.end()
        tag = (match[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            pieces.append(" ")
        if match[1]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at].tag == tag:
                    close(at)
                    break
                if tag in INLINE and stack[at].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, place)
            place = end.end() if end else len(page)
            continue
        if tag in VOID or match[3].endswith("/") and tag not in ("p", "div", "article", "section"):
            continue
        ended = ENDS.get(tag) or (() if tag in INLINE else {"p"})
        for at in range(len(stack) - 1, -1, -1):
            if stack[at].tag in ended:
                close(at)
                break
            if stack[at].tag in SCOPES:
                break
        names: dict[str, set[str]] = {}
        for found in ATTRIBUTE.finditer(match[3]):
            names.setdefault(found[1].lower(), set((found[2] or found[3] or found[4] or "").lower().split()))
        element = Element(tag, stack[-1] if stack else None, len(pieces), names, roots > 0)
        roots += element.root
        elements.append(element)
        stack.append(element)
    say(page[place:])
    close(0)
    return elements, pieces


def inside_roots(elements: list[Element]) -> list[tuple[int, int]]:
    """Spans of marked articles that are no part of furniture."""
    spans: list[tuple[int, int]] = []
    bad_end = 0
    for element in elements:
        if element.furniture:
            bad_end = max(bad_end, element.end)
        elif element.root and element.start >= bad_end and element.end > element.start:
            if not spans or element.start >= spans[-1][1]:
                spans.append((element.start, element.end))
    return spans


def in_running_text(element: Element) -> bool:
    """Whether an inline element stands among words of the block around it."""
    while element.tag in INLINE and (element := element.parent):
        if element.says:
            return True
    return False


def lists_links(element: Element) -> bool:
    return element.links >= MIN_LINKS and 2 * element.linked >= element.words and element.tag not in INLINE


def deletable(elements: list[Element], roots: list[tuple[int, int]]) -> list[tuple[Element, tuple[int, ...]]]:
    """Elements with text and the hashes by which they go if these are template.

    Outside of marked articles all elements go by their subtrees, and lists of links by their shapes too; inside, groups
    go by their subtrees.
    """
    found = []
    at = 0
    for element in elements:
        if element.end == element.start or element.tag in ("html", "body", "head"):
            continue
        if in_running_text(element):
            continue
        while at < len(roots) and roots[at][1] <= element.start:
            at += 1
        inside = at < len(roots) and roots[at][0] <= element.start and element.end <= roots[at][1]
        if inside:
            if element.tag in GROUPS and not element.root:
                found.append((element, (element.digest,)))
        elif at == len(roots) or element.end <= roots[at][0]:
            found.append((element, (element.digest, element.shape) if lists_links(element) else (element.digest,)))
    return found


def candidates(page: str) -> list[int]:
    """Distinct hashes of the subtrees, and of the shapes, that may be template."""
    elements, _ = parsed(page)
    return sorted({digest for _, hashes in deletable(elements, inside_roots(elements)) for digest in hashes})


def main_text(page: str, template: set[int]) -> str:
    """The main text of a page, given the template hashes of its host."""
    elements, pieces = parsed(page)
    roots = inside_roots(elements)
    own = np.zeros(len(pieces), bool)
    for start, end in roots or [(0, len(pieces))]:
        own[start:end] = True
    gone = [element for element, hashes in deletable(elements, roots) if not template.isdisjoint(hashes)]
    keep, named = own.copy(), np.zeros(len(pieces), bool)
    for element in gone:
        keep[element.start : element.end] = False
    # Names speak on what the counts have left.
    for element in elements:
        if element.furniture:
            named[element.start : element.end] = True
    keep &= ~named
    sizes = np.array([len(piece.split()) for piece in pieces], np.int64)
    left = int(sizes[keep].sum())
    if roots and not left:
        keep = own & ~named
    elif gone and not roots:
        # A story on several pages is not template for what little stands around it.
        total = np.concatenate(([0], np.cumsum(np.where(named, 0, sizes))))
        largest = max(gone, key=lambda element: (total[element.end] - total[element.start], -element.start))
        if not lists_links(largest) and 10 * left < total[largest.end] - total[largest.start]:
            keep[largest.start : largest.end] = ~named[largest.start : largest.end]
    # Where something was cut out, a block ends.
    out, gap = [], False
    for piece, wanted in zip(pieces, keep.tolist()):
        if wanted:
            out.append(" " + piece if gap else piece)
        gap = not wanted
    return " ".join(markup.unescape("".join(out)).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_of(host: str, html: str) -> Column:
    """A number for what a page of this host says."""
    return F.xxhash64(F.col(host), text_of(html))


def with_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_bodies: int = MIN_BODIES) -> DataFrame:
    """Pages with their main ``text`` and its length ``n_chars`` in code points."""

    @F.pandas_udf("array<bigint>")
    def hashes(pages: pd.Series) -> pd.Series:
        return pages.map(candidates)

    @F.pandas_udf("string")
    def extracted(pages: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series(
            [main_text(page, set() if hashes is None else set(hashes)) for page, hashes in zip(pages, found)], dtype=object
        )

    names = [column for column in pages.columns if column not in ("text", "n_chars")]
    host, page, template = (unused(pages, name) for name in ("__host", "__page", "__template"))
    hosted = pages.select(*names).withColumn(host, host_of(F.col("url"))).withColumn(page, page_of(host, "html"))
    # A hash mixed with its host's stands for both.
    mixed = F.transform("hashes", lambda item: item.bitwiseXOR(F.xxhash64("host")))
    read = hosted.select(F.col(page).alias("page"), F.col(host).alias("host"), hashes(text_of("html")).alias("hashes"))
    bodies = stored(
        read.select("page", mixed.alias("hashes")).groupBy("page").agg(F.first("hashes").alias("hashes"), F.count("*").alias("n")),
        "bodies",
    )
    listed = bodies.select("page", "n", F.explode("hashes").alias("hash"))
    counts = listed.groupBy("hash").agg(F.sum("n").alias("pages"), F.count("*").alias("bodies"))
    # Stored, the sizes are known: small, a list is sent to the other side; large, both are dealt and busy keys split.
    frequent = stored(
        counts.where((F.col("pages") >= min_pages) & (F.col("bodies") >= min_bodies)).select("hash"), "templates"
    )
    found = listed.join(frequent, "hash").groupBy(F.col("page").alias(page)).agg(F.collect_list("hash").alias(template))
    joined = hosted.join(stored(found, "found"), page, "left")
    plain = F.transform(template, lambda item: item.bitwiseXOR(F.xxhash64(F.col(host))))
    out = joined.select(*names, extracted(text_of("html"), plain).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
