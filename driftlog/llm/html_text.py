"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events; block tags cut it into lines, each with the text, its tags and its
links counted. Lines' text-to-tag ratios are smoothed along the page, and lines at or over the threshold that are not mostly links are seeds. Where the article
and main elements hold half of the page's running text or more, those with a seed are the content; elsewhere it is the deepest
container that holds ``MOST`` of the seeds' text, or one around it that adds no more linked than plain text, and of the body itself the stretch from the first seed to the last. All blocks
of the content stay, short ones and mostly linked ones too.

Elements of menus, headers, footers, sidebars, adverts, forms, scripts, styles and the like never are content, unless they are left
unclosed, when what follows them is judged by its ratios. Ids, classes and roles of which a word names such parts or reader comments
(``NAMED``) speak against elements that group others and against paragraphs, unless the element holds half of the page's running text and no article or main element has any outside such
elements. Words that articles use for parts of their own too (``DOUBTFUL``) count only where the ratios agree: an element most of whose text stands in seeds stays.

A comment or tag that the page's end cuts off is no text.

Defined cases: null and empty pages give an empty text; broken nesting is closed at the next matching end; an article's own
header, and its headings, stay; repeated rows are extracted each; other columns are left alone; nesting may be of any depth.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

SIGMA, SHARE, MOST = 1.0, 0.5, 0.8
# Elements and names of what is not main text.
UNSEEN = {"head", "script", "style", "noscript", "template", "svg", "iframe", "button", "select", "textarea", "object", "canvas", "title"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
NAMED = set(
    "ad ads adslot advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar masthead "
    "cookie cookies consent popup modal newsletter subscribe signup comment comments disqus replies share sharing social related toolbar pagination pager".split()
)
ADVERTS = set("ad ads adslot advert adverts advertisement advertising sponsor sponsored promo promoted".split())  # these name paragraphs too
LAST = {"notice"}  # names such a part at the end of a name only: a notice-board is none
DOUBTFUL = set("header footer side search alert widget contentinfo complementary".split())
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | ASIDE
CONTAINERS = {"html", "body", "article", "main", "section", "div", "td"}
GROUPS = {"section", "div", "ul", "ol", "dl", "table", "details", "fieldset", "center"}
HEADING = re.compile(r"h[1-6]")
CUT_OFF = re.compile("<[a-zA-Z/!?]")
NOT_WORD = re.compile(r"[^a-z0-9]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    """What an open element hands down to its lines."""

    __slots__ = ("tag", "unseen", "aside", "hint", "container", "region", "up")

    def __init__(self, tag: str, up: "Node | None"):
        self.tag, self.up = tag, up
        self.unseen = bool(up and up.unseen)
        self.aside = self.hint = None
        self.container = up.container if up else 0
        self.region = up.region if up else 0


class Lines(HTMLParser):
    """Cuts a page into lines: text, tags, characters in links, and the node it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Node("html", None)]
        self.open: dict[str, int] = {}
        self.lines: list[tuple[str, int, int, Node]] = []
        self.parts: list[str] = []
        self.parent, self.rooted = [0], {0}  # of each container; the ids of html and body
        self.unclosed: set[int] = set()
        self.doubted: set[int] = set()
        self.tags = self.linked = self.ids = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self.stack[-1]))
        self.parts, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.cut()
        if tag == "p" and self.open.get("p"):
            self.close_to("p", within=CONTAINERS)
        elif tag == "li" and self.open.get("li"):
            self.close_to("li", within=CONTAINERS | {"ul", "ol"})
        up = self.stack[-1]
        if tag in ("main", "article"):  # no menu or page header holds one: it was left open
            near = up
            while near and not (near.aside and (tag == "main" or near.tag != "aside")):
                near = near.up
            if near:
                self.unclosed.add(near.aside)
        self.tags += not up.unseen
        if tag == "br":
            self.parts.append("" if up.unseen else " ")
        if tag in VOID:
            return
        node = Node(tag, up)
        self.ids += 1
        node.unseen |= tag in UNSEEN
        if tag in ASIDE or (tag == "header" and not up.region):
            node.aside = self.ids
        if tag in GROUPS or tag == "p":
            names = [NOT_WORD.split(name.strip("-_")) for k, v in attrs if k in ("class", "id", "role") for name in (v or "").lower().split()]
            named = {w for parts in names for w in parts}
            if named & (ADVERTS if tag == "p" else NAMED) or tag != "p" and any(parts[-1] in LAST for parts in names):
                node.hint = self.ids
            elif named & DOUBTFUL and tag != "p":
                node.hint = self.ids
                self.doubted.add(self.ids)
        if tag in CONTAINERS:
            node.container = len(self.parent)
            self.parent.append(up.container)
            if tag in ("html", "body"):
                self.rooted.add(node.container)
        if tag in ("article", "main") and not up.region:
            node.region = self.ids
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def close_to(self, tag: str, within: set[str] = frozenset()) -> None:
        at = len(self.stack) - 1
        while at > 0 and self.stack[at].tag != tag:
            if self.stack[at].tag in within:
                return
            at -= 1
        for node in self.stack[max(1, at) :]:
            self.open[node.tag] -= 1
            if node.aside and node is not self.stack[at]:
                self.unclosed.add(node.aside)
        del self.stack[max(1, at) :]

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.cut()
        if self.open.get(tag):
            self.close_to(tag)

    def handle_data(self, data):
        if not self.stack[-1].unseen:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data.strip())

    def finish(self) -> None:
        if CUT_OFF.match(self.rawdata):  # what the parser could not end
            self.rawdata = ""
        self.close()
        self.cut()
        self.unclosed |= {node.aside for node in self.stack if node.aside}


def marks(node: Node, found: dict[Node, tuple[tuple, tuple]]) -> tuple[tuple, tuple]:
    """The outermost first: ids of the aside elements and of the hinted ones around a node."""
    path = []
    while node is not None and node not in found:
        path.append(node)
        node = node.up
    asides, hints = found[node] if node is not None else ((), ())
    for n in reversed(path):
        if n.aside:
            asides += (n.aside,)
        if n.hint:
            hints += (n.hint,)
        found[n] = (asides, hints)
    return asides, hints


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    within = slice(reach, reach + len(ratio))
    return np.convolve(ratio, bell)[within] / np.convolve(np.ones(len(ratio)), bell)[within]


def measured(lines: list[tuple]) -> tuple[np.ndarray, ...]:
    """Plain and linked characters, ratio, smoothed ratio of each line, and whether it is a seed."""
    linked = np.array([x for _, _, x, *_ in lines], float)
    plain = np.array([len(text) for text, *_ in lines]) - linked
    ratio = plain / np.maximum(1, [tags for _, tags, *_ in lines])
    smooth = smoothed(ratio)
    return plain, linked, ratio, smooth, (smooth >= SHARE * smooth.mean()) & (plain > linked)


def main_text(html: str | None) -> str:
    """The page's content blocks joined by line feeds."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.finish()
    known: dict[Node, tuple[tuple, tuple]] = {}
    lines = [(*line, marks(line[3], known)[1]) for line in page.lines if all(a in page.unclosed for a in marks(line[3], known)[0])]
    if not lines:
        return ""
    plain, linked, ratio, smooth, seed = measured(lines)
    held: dict[int, float] = {}
    rich: dict[int, float] = {}
    for (*_, hints), n, s in zip(lines, plain.tolist(), (seed & (ratio >= SHARE * smooth.mean())).tolist()):
        for h in hints:
            held[h] = held.get(h, 0) + n
            rich[h] = rich.get(h, 0) + n * s
    elsewhere = any(node.region and not hints for *_, node, hints in lines)
    against = {h for h, n in held.items() if (elsewhere or 2 * n < plain.sum()) and not (h in page.doubted and 2 * rich[h] >= n > 0)}
    lines = [line for line in lines if not against.intersection(line[4])]
    if not lines:
        return ""
    plain, linked, ratio, smooth, seed = measured(lines)
    region = np.array([node.region for *_, node, _ in lines])
    if 2 * plain[region > 0].sum() >= plain.sum() and (region > 0).any():
        keep = np.isin(region, region[seed & (region > 0)]) & (region > 0)
    else:
        keep = deepest(page, [node for *_, node, _ in lines], plain, linked, seed, seed & (ratio >= SHARE * smooth.mean()))
    return "\n".join(line[0] for line, k in zip(lines, keep) if k)


def deepest(page: Lines, nodes: list[Node], plain: np.ndarray, linked: np.ndarray, seed: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Which lines stand in the deepest container that holds ``MOST`` of the seeds' text, or in one around it below the body that adds no
    more linked than plain text; of the body the stretch between the first and last lines that are seeds by their own ratio, headings before it included."""
    container = np.array([node.container for node in nodes])

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.bincount(container, values, minlength=len(page.parent))
        for c in range(len(page.parent) - 1, 0, -1):  # children come after their parents
            total[page.parent[c]] += total[c]
        return total

    mass, text, links = summed(plain * seed), summed(plain), summed(linked)
    chosen, inside = 0, np.zeros(len(page.parent), bool)
    for c in range(1, len(page.parent)):
        if page.parent[c] == chosen and mass[c] >= MOST * mass[0]:
            chosen = c
    up = page.parent[chosen]
    while chosen not in page.rooted and up not in page.rooted and links[up] - links[chosen] <= text[up] - text[chosen]:
        chosen, up = up, page.parent[up]
    inside[chosen] = True
    for c in range(chosen + 1, len(page.parent)):
        inside[c] = inside[page.parent[c]]
    keep = inside[container]
    if chosen in page.rooted:
        at = np.flatnonzero(outer & keep) if (outer & keep).any() else np.flatnonzero(seed & keep)
        if not len(at):
            return np.zeros(len(keep), bool)
        first = at[0]
        while first > 0 and HEADING.fullmatch(nodes[first - 1].tag):
            first -= 1
        keep &= (np.arange(len(keep)) >= first) & (np.arange(len(keep)) <= at[-1])
    return keep


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            release()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
