"""Main text of web pages by tag-path ratios.

A page becomes blocks: runs of text between block-level tags. A block's tag path runs from the root to its innermost
block element; a step is the tag with its class names (digits taken off). Over all its blocks a path has characters of
text per block, punctuation marks per block, and characters outside links per character of the page. The first two are
smoothed with those of the neighbouring paths in order of first appearance (Gaussian weights over `NEAR` places each way),
and all are fused: the root of the first two's product, times the third.

What the page's own names say is a prior, a factor on the fused ratio: `FOR` on paths through an article or main element,
`AGAINST` on those through an element whose class or id names an advert, menu, sidebar, notice, share bar or comment; it
drops nothing by itself. Paths of at least `SHARE` of the largest fused ratio are content. Their container is the deepest
element that holds nearly all of the content's text (of a paragraph, what stands around it); within it a path needs only
`WITHIN` of the largest, so that headings, items and cells of an article stay with its paragraphs. Elements that are no
content whatever they hold are left out by their tag (nav, header, footer, aside, form, script, style ...), by their role,
or because they are hidden.

Parsing is one pass of a regular expression over the page, linear in its length whatever the nesting: it handles missing
end tags, void elements, comments, raw text of script and style, and stray end tags. A page is worked on alone.

Edge cases: null or empty html gives an empty text; a page of text without tags gives that text. Character references are
decoded, also without their semicolon where HTML allows it. White space within a block becomes one space. Repeated rows
give repeated results; an empty table an empty one. Only the named columns are read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math select textarea button title noframes canvas video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul br".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog fieldset label legend noscript template iframe head".split())
KINDS = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|breadcrumbs?|side-?bar\w*|foot\w*|masthead|topbar|comments?|commentlist|respond|replies|disqus\w*|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|sign-?up|cookies?\w*|consent|gdpr|notices?|alerts?|popups?|modals?|widgets?|tags?|pagination|pager|toolbar|skip|hidden|login|search)", re.I
)
#: Words that may stand beside those in a name; any other, as in "with-sidebar", makes it another name.
BESIDE = frozenset("left right top bottom upper lower primary secondary global site page list box block area section wrapper wrap container inner outer content slot unit bar links link items item form main header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog status note".split())
#: End tags that may be missing: a start tag of the key closes an open element of the value, up to the nearest container.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option", "tbody": "thead tbody tfoot tr td th p", "tfoot": "thead tbody tfoot tr td th p"}.items()}
ENDS_P = BLOCK - frozenset("body html head br option legend caption title td th tr tbody thead tfoot".split())
HOLDERS = frozenset("ul ol dl table menu body html article section div nav aside main header footer form blockquote".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f\v]+")
MARKS = re.compile(r"[.,;:!?。，！？…]")
NEAR, SHARE, WITHIN, NEARLY = 1, 0.2, 0.001, 0.9
FOR, AGAINST = 2.0, 0.4  #: their quotient is SHARE, so the prior alone drops no path


class Block:
    """A block's text, how much of it is in links, its path (a number) and its element (a number)."""

    __slots__ = ("text", "linked", "path", "element")

    def __init__(self, text: str, linked: int, path: int, element: int):
        self.text, self.linked, self.path, self.element = text, linked, path, element


def named(value: str) -> bool:
    """Whether one of the names says that this is no content: all its parts must be such words, or go with them."""
    for name in value.lower().split():
        if KINDS.fullmatch(name):
            return True
        parts = [x for x in re.split("[_-]+", name) if x]
        if any(KINDS.fullmatch(x) for x in parts) and all(x in BESIDE or KINDS.fullmatch(x) for x in parts):
            return True
    return False


@lru_cache(4096)
def told(tag: str, attributes: str) -> tuple[bool, str, float]:
    """What a start tag says: whether to leave the element out, its class names, and its prior."""
    prior = FOR if tag in ("article", "main") else 1.0
    if tag in DROPPED:
        return True, "", prior
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, "", prior
    out, names = False, ""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "class":
            names = re.sub(r"\d+", "", " ".join(value.lower().split()))
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and named(value):
            prior = AGAINST
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out = True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out = True
    return out, names, prior


class Page:
    """Blocks of visible text in page order; paths and elements by number, each with its parent's number."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.priors: list[float] = [1.0]  # of each path
        self.parents: list[int] = [0]  # of each block element; element 0 is the page
        self.tags: list[str] = []  # open elements, outermost first
        self.state: list[tuple[int, int, bool]] = []  # of each: its block element, its path, whether it leaves its text out
        self.places: dict[str, list[int]] = {}  # of each open tag
        self.in_block: list[int] = []  # places of open block elements
        self.holders: list[int] = []  # and of those that hold others
        self.steps: dict[tuple, int] = {}
        self.pieces: list[str] = []
        self.linked = self.links = self.left_out = 0
        self.parse(page)

    def end_block(self) -> None:
        if self.pieces:
            text = SPACES.sub(" ", references.unescape("".join(self.pieces))).strip(" ")
            self.pieces.clear()
            if text and not self.left_out:
                element, path, _ = self.state[-1] if self.state else (0, 0, False)
                self.blocks.append(Block(text, min(self.linked, len(text)), path, element))
        self.linked = 0

    def close(self, upto: int) -> None:
        """Close open elements down to place upto."""
        if self.in_block and self.in_block[-1] >= upto:
            self.end_block()
        while len(self.tags) > upto:
            tag, (_, _, out) = self.tags.pop(), self.state.pop()
            self.places[tag].pop()
            self.left_out -= out
            self.links -= tag == "a"
            for stack in (self.in_block, self.holders):
                if stack and stack[-1] == len(self.tags):
                    stack.pop()

    def open(self, tag: str, attributes: str) -> None:
        out, names, prior = told(tag, attributes)
        above, path, _ = self.state[-1] if self.state else (0, 0, False)
        is_block = tag in BLOCK
        if is_block or prior < 1:
            # an inline element is a step only if its name says what it is
            step = (path, tag, names, prior)
            if step not in self.steps:
                self.steps[step] = len(self.priors)
                self.priors.append(min(self.priors[path], prior) if prior < 1 else max(self.priors[path], prior) if self.priors[path] >= 1 else self.priors[path])
            path = self.steps[step]
        if is_block:
            self.parents.append(above)
            above = len(self.parents) - 1
        place = len(self.tags)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if is_block:
            self.in_block.append(place)
        if tag in HOLDERS:
            self.holders.append(place)
        self.state.append((above, path, out))
        self.left_out += out
        self.links += tag == "a"

    def end_tag(self, tag: str) -> None:
        if self.places.get(tag):
            place = self.places[tag][-1]
            if tag in BLOCK or not self.in_block or self.in_block[-1] <= place:
                self.close(place)
        elif tag in BLOCK:
            self.end_block()

    def implied_ends(self, tag: str) -> None:
        """End tags that a start tag stands for."""
        holder = self.holders[-1] if self.holders else -1
        if tag in ENDS_P and self.places.get("p") and self.places["p"][-1] > holder:
            self.close(self.places["p"][-1])
        if tag in CLOSES:
            lowest = None
            for place in reversed(self.in_block):
                if place <= holder or self.tags[place] not in CLOSES[tag]:
                    break
                lowest = place
            if lowest is not None:
                self.close(lowest)

    def parse(self, page: str) -> None:
        at, n, last = 0, len(page), page.rfind(">")
        while at < n:
            if page[at] == "<" and at > last:  # no tag ends any more
                if re.match(r"</?[a-zA-Z!?]", page[at : at + 3]):
                    break
                m = re.compile(r"<[^<]*").match(page, at)
                piece, tag, at = m[0], None, m.end()
            else:
                m = TOKEN.match(page, at)
                piece, tag, at = m[0], m[2], m.end()
            if tag is None:
                if piece.startswith("<![CDATA["):
                    piece = piece[9:].removesuffix("]]>")
                elif piece[0] == "<" and len(piece) > 1 and piece[1] in "!?":
                    continue  # comment, doctype, instruction
                if not self.left_out:
                    self.pieces.append(piece)
                    if self.links:
                        self.linked += len(piece)
                continue
            tag = tag.lower()
            if m[1]:
                self.end_tag(tag)
                continue
            if tag in BLOCK:
                self.end_block()
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            self.implied_ends(tag)
            if m[3].rstrip().endswith("/") and tag not in BLOCK:
                continue
            self.open(tag, m[3])
        self.close(0)
        self.end_block()


def ratios(blocks: list[Block]) -> dict[int, float]:
    """The fused ratio of each tag path."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), b.linked, len(MARKS.findall(b.text)))):
            s[i] += v
    whole = sum(chars for _, chars, _, _ in sums.values())
    rows = [(chars / n, (marks + 0.1) / n) for n, chars, _, marks in sums.values()]
    weights = {d: math.exp(-2 * d * d) for d in range(-NEAR, NEAR + 1)}
    fused = {}
    for i, (path, (_, chars, linked, _)) in enumerate(sums.items()):
        length, marks = (sum(w * rows[i + d][k] for d, w in weights.items() if 0 <= i + d < len(rows)) for k in range(2))
        fused[path] = math.sqrt(length * marks) * (chars - linked) / whole
    return fused


def selected(page: Page) -> list[Block]:
    """The blocks of content paths."""
    fused = {p: x * page.priors[p] for p, x in ratios(page.blocks).items()}
    most = max(fused.values())
    held, whole = [0] * len(page.parents), 0
    for b in page.blocks:
        if fused[b.path] >= SHARE * most:
            held[b.element] += len(b.text)
            whole += len(b.text)
    for e in range(len(held) - 1, 0, -1):  # children have larger numbers
        held[page.parents[e]] += held[e]
    texts = {b.element for b in page.blocks}
    container = max(e for e, n in enumerate(held) if n >= NEARLY * whole)
    if container in texts:  # a paragraph alone: what stands around it counts
        container = page.parents[container]
    inside = [e == container for e in range(len(held))]
    for e in range(1, len(held)):
        inside[e] = inside[e] or inside[page.parents[e]]
    return [b for b in page.blocks if fused[b.path] >= (WITHIN if inside[b.element] else SHARE) * most]


def main_text(page: str | None) -> str:
    parsed = Page(page or "")
    return "\n".join(b.text for b in selected(parsed)) if parsed.blocks else ""


def extracted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = [main_text(x) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(html).alias("_html"), *keep)
    schema = rows.select(*keep, F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(extracted, schema)


def op9_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
