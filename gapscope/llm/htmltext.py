"""Main text of web pages by site style trees.

The pages of a host are laid over each other: elements with the same path of tags and classes
are one node of the host's style tree. A node that looks the same on every page is layout; one
that differs is content. Its presentation (the sequence of children) and its own text each have
an entropy over the pages, as a share of the largest possible, and a branch counts by the mean
of its nodes, deeper ones less. Branches below a bound, on enough pages, are cut from each page.

What the elements say of themselves is used as well, since a host may have a page or two only:
menus, forms, scripts and the like, and elements classed as adverts, notices, side bars or
reader comments, never hold main text; where a page has an article (or main) element, its main
text is inside one. Plain text elements of an article are never cut for being alike. Classes
that tell a state ("has-sidebar", "comments-open") name nothing, and where the words of classes and
ids would take the page's only article, longer than what they leave, they do not apply to it and to
what it lies in.

Counts are summed per task, then per value, then per node, so a host with a third of all pages
is no task's burden; the tables of cut branches are small beside the pages. A null or empty page
has the empty text; a page that the cuts would leave empty is read without them. Pages without a host have no style tree. Repeated rows are pages like others.
Entropy shares need ``least_pages`` pages with the node; below that only its own words count.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import cut

#: Fixed values of HTML: what elements are by their names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSED_BY = {
    "p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody thead tr td th dl dt dd b i em strong a span br hr code figure figcaption img section div".split())
#: Never main text: by tag, by role, and by a word of the class or id.
OUT_TAGS = frozenset("head script style noscript template nav footer aside form button select option optgroup textarea input label iframe svg canvas object embed applet audio video dialog menu title xmp".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations sidebar side aside rail widget widgets nav "
    "navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar comment comments disqus reply replies respond "
    "discussion search copyright legal disclaimer".split()
)
IN_TAGS = frozenset(["article", "main"])
#: A class with one of these tells a state of its element ("has-sidebar", "comments-open"), not what it is.
STATES = frozenset("has have with without no not is are in open opened closed enabled disabled on off allowed".split())
#: Elements below this depth share the node of the one at it; texts are kept at any depth.
DEEPEST = 64

TOKEN = re.compile(
    r"<!--.*?-->|<!--.*\Z|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S
)
ATTRIBUTE = re.compile(r"(?i)(?<![^\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("tag", "path", "out", "inside", "plain", "children", "text", "worded")

    def __init__(self, tag: str, path: str, out: bool, inside: bool, plain: bool, worded: int = 0):
        self.tag, self.path, self.out, self.inside, self.plain, self.worded = tag, path, out, inside, plain, worded
        self.children: list[str] = []
        self.text: list[str] = []


def names_out(mark: str) -> bool:
    """Whether a class or id names its element as one that never holds main text."""
    words = {w.lower() for w in WORDS.findall(mark)}
    return not words.isdisjoint(OUT_WORDS) and words.isdisjoint(STATES)


def scan(
    html: str, low: frozenset[str] = frozenset(), seen: Counter | None = None, held: list[set[int]] | None = None, spare: frozenset[int] = frozenset()
) -> list[tuple[bool, str]]:
    """The kept blocks of a page in order, each with whether it is inside an article.

    ``low`` holds the paths to cut. ``seen`` gets (path, kind, value) of every element: kind 0
    for its children's names, 1 for its own text; 2 more where it is plain text of an article.
    ``held`` gets, for every article or main element, the numbers of the elements around it and
    itself that a class or id names as not main text; those in ``spare`` are not judged so.
    """
    order = 0
    blocks: list[tuple[bool, str]] = []
    stack = [Element("", "", False, False, False)]
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            if words := "".join(buffer).split():
                blocks.append((stack[-1].inside, " ".join(words)))
            buffer.clear()

    def leave() -> None:
        e = stack[-1]
        if e.tag in BLOCK:
            flush()
        stack.pop()
        if seen is not None:
            names = [c for k, c in enumerate(e.children) if not k or e.children[k - 1] != c]
            own = " ".join("".join(e.text).split())
            if names or not own:
                seen[e.path, 2 * e.plain, zlib.crc32(" ".join(names).encode())] += 1
            if own:
                seen[e.path, 2 * e.plain + 1, zlib.crc32(own.encode())] += 1

    def text(raw: str) -> None:
        if not raw:
            return
        own = stack[-1]
        found = entities.unescape(raw) if "&" in raw else raw
        if not own.out:
            buffer.append(found)
        if seen is not None:
            own.text.append(found)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing, rest = (m[1], m[3]) if m[2] else (m[4], m[6])
        if closing:
            if tag in BLOCK or tag in VOID:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            leave()
                        break
            else:  # an inline end tag never closes the block around it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        while len(stack) > k:
                            leave()
                        break
                    if stack[k].tag in BLOCK:
                        break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                while len(stack) > k:
                    leave()
                break
            if stack[k].tag in SCOPE:
                break
        classes, role, hidden, marks = [], "", False, []
        if rest:
            for name, value in ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'")
                if name == "class":
                    classes = sorted(set(value.split()))
                    marks += classes
                elif name == "id":
                    marks += value.split()
                elif name == "role":
                    role = value.lower()
                else:
                    hidden |= name == "hidden" or value.lower() == "true"
        up = stack[-1]
        inside = up.inside or tag in IN_TAGS or role == "main"
        plain = not classes and inside and tag in TEXT_ELEMENTS | IN_TAGS
        order += 1
        named = order not in spare and tag not in ("html", "body") and any(map(names_out, marks))
        if held is not None and (tag in IN_TAGS or role == "main"):
            held.append({e.worded for e in stack if e.worded} | ({order} if named else set()))
        path = f"{up.path}/{'.'.join([tag, *classes])}" if len(stack) <= DEEPEST else up.path
        out = up.out or hidden or tag in OUT_TAGS or role in OUT_ROLES or named or (tag == "header" and not up.inside) or path in low
        up.children.append(tag)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            if tag in ("br", "hr") and not out:
                buffer.append("\n")
            continue
        if rest.rstrip().endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        stack.append(Element(tag, path, out, inside, plain, order if named else 0))
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = close.start() if close else end
    while len(stack) > 1:
        leave()
    flush()
    return blocks


def main_text(html: str | None, low: frozenset[str] = frozenset()) -> str:
    blocks, spare = spared(html or "", low)
    blocks = blocks or (scan(html, spare=spare) if html and low else [])
    inside = [t for within, t in blocks if within]
    return "\n\n".join(inside or [t for _, t in blocks])


def spared(html: str, low: frozenset[str]) -> tuple[list[tuple[bool, str]], frozenset[int]]:
    """The blocks of a page, and the elements not judged by class and id.

    Where those words leave nothing of the page's one article, and it holds more text than the
    rest of the page, they do not apply to it and to what it lies in.
    """
    held: list[set[int]] = []
    blocks = scan(html, low, held=held)
    if any(within for within, _ in blocks) or len(held) != 1 or not held[0]:
        return blocks, frozenset()
    spare = frozenset(held[0])
    again = scan(html, low, spare=spare)
    if sum(len(t) for within, t in again if within) > sum(len(t) for _, t in blocks):
        return again, spare
    return blocks, frozenset()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, kind, n, share): elements of each node of the hosts' style trees and their entropy share."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, Counter] = {}
            for site, page in zip(batch["host"], batch["html"]):
                scan(page, seen=sums.setdefault(site, Counter()))
            rows = [(site, *key, n) for site, c in sums.items() for key, n in c.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "kind", "value", "n"])

    sited = pages.select(host(F.col("url")).alias("host"), "html").where((F.col("host") != "") & F.col("html").isNotNull())
    values = sited.mapInPandas(count, "host string, path string, kind int, value long, n long").groupBy("host", "path", "kind", "value").agg(F.sum("n").alias("n"))
    spread = F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")
    nodes = values.groupBy("host", "path", "kind").agg(F.sum("n").alias("n"), spread.alias("entropy"))
    return nodes.select("host", "path", "kind", "n", F.when(F.col("n") > 1, F.col("entropy") / F.log(F.col("n").cast("double"))).otherwise(1.0).alias("share"))


def low_branches(nodes: DataFrame, bound: float = 0.1, least_pages: int = 8, fade: float = 0.9) -> DataFrame:
    """(host, low): the paths of unimportant branches, topmost or not; none that holds plain text of an article.

    A branch's importance is the mean share of its nodes, weighted by elements and by
    ``fade`` to the power of the levels between.
    """
    parts = F.split(F.substring("path", 2, 1 << 30), "/")
    levels = F.sequence(F.lit(1), F.size(parts))
    branch = nodes.select("host", "path", "kind", "n", "share", F.size(parts).alias("depth"), F.explode(levels).alias("level"), parts.alias("parts"))
    above = branch.withColumn("branch", F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.col("level")), "/")))
    weight = F.col("n") * F.pow(F.lit(fade), F.col("depth") - F.col("level"))
    own = F.max(F.when(F.col("path") == F.col("branch"), F.col("n")))
    summed = above.groupBy("host", "branch").agg(
        (F.sum(weight * F.col("share")) / F.sum(weight)).alias("importance"), own.alias("pages"), F.max("kind").alias("kind")
    )
    low = summed.where((F.col("importance") < bound) & (F.col("pages") >= least_pages) & (F.col("kind") < 2) & ~F.col("branch").isin("/html", "/html/body"))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("branch")).alias("low"))


def extract(pages: DataFrame, bound: float = 0.1, least_pages: int = 8) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    low = cut(low_branches(style_nodes(pages), bound, least_pages)).select(F.col("host").alias("__host"), "low")

    @F.pandas_udf("string")
    def text(htmls: pd.Series, lows: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset(()) if p is None else frozenset(p)) for h, p in zip(htmls, lows)], dtype=object)

    joined = pages.select("page_id", "url", "html").join(low, host(F.col("url")) == F.col("__host"), "left")
    return joined.select("page_id", "url", text("html", "low").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
