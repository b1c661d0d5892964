"""Main text of web pages by tag-path ratios.

Every text block belongs to a root-to-leaf tag path. Per path the mean text length and the mean number of
punctuation marks of its blocks are taken, smoothed over the blocks in page order, and fused with the share of
text outside links and a weight of the path's element and class names. A path above the threshold is content;
the elements its blocks lie in are the content nodes, and short blocks inside them stay unless their names or
links speak against them. Menus, adverts and footers are scored like all other blocks and lose by their score.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Elements of HTML by their role.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul head".split()
)
#: Elements whose text is not shown or is a form's control.
UNSEEN = frozenset("head script style noscript template button select textarea label legend object svg canvas audio video datalist".split())
#: Elements for the surroundings of an article; a header inside an article is the article's own.
AROUND = frozenset("nav header footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that group others; whatever else holds text belongs to the text around it.
CONTAINERS = frozenset("div section article aside main form fieldset center body html nav header footer menu dialog".split())
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body", "head", "option", "legend", "caption"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"},
}
#: Elements such an implied end does not reach out of.
FENCES = frozenset("table td th ul ol dl select article section main div blockquote body html".split())
#: Names, as whole words of a class, id or role, of what is around an article, and of what may be either.
_PLACE = r"(?:(?:site|page|main|global|top|bottom|left|right|post|article|user|reader)[_-])?"
_PART = r"(?:[_-]?(?:bar|box|list|wrap|wrapper|container|section|block|area|links|items|inner|widget|slot|unit|form|posts|articles|[0-9]+))*"
STRONG = re.compile(
    _PLACE + r"(?:ads?|advert|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|menubar|"
    r"breadcrumbs?|sidebar|footer|masthead|header|cookies?|consent|gdpr|newsletter|subscribe|signup|login|popup|modal|overlay|"
    r"toolbar|pagination|pager|comments?|commentlist|disqus|replies|respond|copyright|contentinfo|complementary|dialog)" + _PART
)
WEAK = re.compile(
    _PLACE + r"(?:side|foot|notice|share|sharing|social|related|recommended|recommendations|discussion|reply|widget|search|legal|alert|toc)" + _PART
)
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PUNCTUATION = re.compile(r"[.,;:!?。，、！？؟،]")
_WHITE = re.compile(r"\s+")
#: Share of the page's mean score, weighted by text and names, above which a path is content.
THRESHOLD = 0.4
#: Weights of names that speak against a path strongly or weakly, and of a place inside an article or main element.
AGAINST, DOUBT, FAVOUR = 1 / 1000, 1 / 4, 2
#: Paths with this share of their text in links are lists of links.
LINKED = 0.6
#: A form with less than one part in so many of the page's text is a form and no wrapper.
FORM_PARTS = 4


class Element:
    """One element, with what its ancestors say about it; paths are numbers of (parent's path, own label)."""

    __slots__ = ("bare", "chosen", "form", "holder", "inside", "linked", "name", "parent", "path", "unseen", "weight")

    def __init__(self, name: str, attributes: str, parent: Element | None, paths: dict[tuple, int]):
        self.name, self.parent, self.chosen, self.bare = name, parent, 0, None
        mark, unseen, weight = "", name in UNSEEN, 1.0
        if name in AROUND and not (name == "header" and parent and parent.inside):
            weight = AGAINST
        for key, a, b, c in _NAMED.findall(attributes) if attributes else ():
            value = html.unescape(a or b or c).lower()
            key = key.lower()
            if key in ("class", "id", "role"):
                if name not in ("html", "body", "main"):
                    for word in value.split():
                        if STRONG.fullmatch(word) and not (name == "header" and weight == 1):
                            weight = AGAINST
                        elif WEAK.fullmatch(word):
                            weight = min(weight, DOUBT)
                mark += "." + value if key == "class" else ""
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                unseen = True
            elif key == "style":
                unseen |= bool(_HIDDEN.search(value))
        self.unseen = (unseen and name not in ("html", "body")) or bool(parent and parent.unseen)
        self.weight = min(weight, parent.weight) if parent else weight
        self.inside = name in ("article", "main") or bool(parent and parent.inside)
        self.linked = name == "a" or bool(parent and parent.linked)
        self.form = parent and parent.form or (self if name == "form" else None)
        self.holder = self if name in BLOCKS or parent is None else parent.holder
        self.path = paths.setdefault((parent and parent.path, name + mark), len(paths))


class Block:
    """A run of text in one block element: its text, and how many of its characters are in links."""

    __slots__ = ("element", "links", "parts", "text", "weight")

    def __init__(self, element: Element):
        self.element, self.parts, self.links, self.text, self.weight = element, [], 0, "", 1.0


def parsed(page: str) -> tuple[list[Element], list[Block]]:
    """All elements, parents first, and the non-empty blocks that are shown, in page order; linear in the page."""
    paths: dict[tuple, int] = {}
    root = Element("html", "", None, paths)
    stack, elements, blocks, at, end = [root], [root], [], 0, len(page)
    is_open: Counter = Counter()
    current: Block | None = None

    def say(text: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.unseen:
            return
        if current is None:
            current = Block(top.holder)
            blocks.append(current)
        text = html.unescape(text) if "&" in text else text
        current.parts.append(text)
        if top.linked:
            current.links += len(text.strip())

    def cut(length: int) -> None:
        for e in stack[length:]:
            is_open[e.name] -= 1
        del stack[length:]

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if is_open[name]:
                length = len(stack) - 1
                while stack[length].name != name:
                    if stack[length].name in BLOCKS:
                        current = None
                    length -= 1
                cut(length)
            if name in BLOCKS:
                current = None
            continue
        if name in BLOCKS:
            current = None
            if any(is_open[before] and name in after for before, after in CLOSED_BY.items()):
                for i in range(len(stack) - 1, 0, -1):
                    if name in CLOSED_BY.get(stack[i].name, ()):
                        cut(i)
                        break
                    if stack[i].name in FENCES:
                        break
        if name == "html":
            continue
        if name == "br":
            say(" ")
            continue
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        element = Element(name, m[3], stack[-1], paths)
        elements.append(element)
        stack.append(element)
        is_open[name] += 1
    for block in blocks:
        block.text = _WHITE.sub(" ", "".join(block.parts)).strip()
    blocks = [b for b in blocks if b.text]
    held: Counter = Counter()
    for block in blocks:
        held[block.element.form] += len(block.text)
    whole = sum(held.values())
    for block in blocks:
        e = block.element
        small = e.form is not None and held[e.form] * FORM_PARTS < whole
        block.weight = min(e.weight, AGAINST) if small else e.weight
    return elements, blocks


def _smooth(values: list[float], spread: float = 0.5) -> list[float]:
    reach = range(-2, 3)
    weights = [math.exp(-(i * i) / (2 * spread * spread)) for i in reach]
    out = []
    for at in range(len(values)):
        near = [(w, values[at + i]) for w, i in zip(weights, reach) if 0 <= at + i < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused score of every tag path: text and punctuation ratios, text outside links, names."""
    length, marks, links, count = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        path = b.element.path
        length[path] += len(b.text)
        marks[path] += len(_PUNCTUATION.findall(b.text))
        links[path] += b.links
        count[path] += 1
    by_text = _smooth([length[b.element.path] / count[b.element.path] for b in blocks])
    by_marks = _smooth([1 + marks[b.element.path] / count[b.element.path] for b in blocks])
    score = defaultdict(float)
    for b, text, mark in zip(blocks, by_text, by_marks):
        names = b.weight * (FAVOUR if b.element.inside else 1)
        path = b.element.path
        score[path] += text * mark * names * max(0.0, 1 - links[path] / length[path]) ** 2
    return {p: s / count[p] for p, s in score.items()}


def content_paths(blocks: list[Block], threshold: float) -> set[int]:
    """Paths whose score reaches ``threshold`` times the page's mean, weighted by text and names."""
    scores = path_scores(blocks)
    whole = sum(len(b.text) * b.weight for b in blocks)
    mean = sum(scores[b.element.path] * len(b.text) * b.weight for b in blocks) / whole
    return {p for p, s in scores.items() if s >= threshold * mean}


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks joined by line breaks; empty if the page has none."""
    elements, blocks = parsed(page or "")
    if not blocks:
        return ""
    chosen = content_paths(blocks, threshold)
    links, length = Counter(), Counter()
    for b in blocks:
        links[b.element.path] += b.links
        length[b.element.path] += len(b.text)
        if b.element.path in chosen:
            b.element.chosen += len(b.text)
    # Elements come after their parents: sums go up the tree in one pass, the outermost elements without chosen text down in another.
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chosen += e.chosen
    for e in elements:
        e.bare = e.parent.bare if e.parent and e.parent.bare else (None if e.chosen else e)
    first = next(i for i, b in enumerate(blocks) if b.element.path in chosen)
    last = max(i for i, b in enumerate(blocks) if b.element.path in chosen)

    def belongs(at: int, b: Block) -> bool:
        e = b.element
        if e.path in chosen:
            return True
        if b.weight < 1 or links[e.path] >= LINKED * length[e.path]:
            return False
        bare = e.bare or e
        around = bare.parent
        if around is None:
            return first < at < last
        if e.inside and (around.inside or bare.name not in CONTAINERS):
            return True
        # A heading leads its text; a container without chosen text stays only between chosen blocks.
        if e.name in HEADINGS:
            return around.name not in ("html", "body") or at < last
        if bare.name in CONTAINERS or around.name in ("html", "body"):
            return first < at < last
        return True

    return "\n".join(b.text for at, b in enumerate(blocks) if belongs(at, b))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    A null or empty page has an empty text. Text inside a block becomes one line, its white space single
    spaces; repeated rows give repeated results, an empty table no rows. Other columns are not looked at.
    """

    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    rows = pages.select("page_id", "url", F.pandas_udf(extract, "string")(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
