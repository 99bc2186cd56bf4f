"""Main text of web pages from flat text blocks.

A page's tags are read in order, without building a tree of nodes; text between block tags becomes a flat list of
blocks. A block's features are its word count and link density, those of its neighbours, and which kind of element
encloses it. A small decision tree, trained here on the labelled table below, keeps the blocks of the main text.

Narrow: each page is judged by itself, whole, and nothing is shuffled. A null or empty page has no text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import small_batches, table, without

# Fixed names of elements and of class, id and role words.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "select", "title")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form button menu dialog".split())
FURNITURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial alert banner banners breadcrumb breadcrumbs comment commentlist comments consent
    cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices
    notification pager pagination paywall popup privacy promo promoted promotion related replies reply respond search share sharing sidebar signin signup
    skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words that make an article that lies in no other one a comment, a notice or an advertisement, if a class starts with one.
ASIDES = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial comment commentlist comments discussion disqus promo promoted promotion related
    replies reply respond sponsor sponsored widget widgets""".split()
)
ARTICLE = frozenset(("article", "main"))
SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "furniture", "has_article")
# The labelled table: features of a block and whether it is main text.
LABELLED = (
    (40, 0.00, 35, 0.0, 60, 0.0, 1, 0, 1, True),
    (3, 0.00, 80, 0.0, 60, 0.0, 1, 0, 1, True),
    (1, 0.00, 0, 0.0, 90, 0.0, 1, 0, 1, True),
    (9, 0.00, 0, 0.0, 35, 0.0, 1, 0, 1, True),
    (2, 0.00, 12, 0.0, 0, 0.0, 1, 0, 1, True),
    (150, 0.05, 60, 0.0, 20, 0.0, 1, 0, 1, True),
    (25, 1.00, 40, 0.0, 40, 0.0, 1, 0, 1, True),
    (4, 1.00, 30, 0.0, 20, 0.2, 1, 0, 1, True),
    (8, 0.50, 5, 1.0, 70, 0.0, 1, 0, 1, True),
    (300, 0.00, 9, 0.0, 0, 0.0, 1, 0, 1, True),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 1, 1, False),
    (1, 1.00, 0, 0.0, 1, 1.0, 0, 1, 0, False),
    (12, 0.00, 1, 1.0, 9, 0.0, 0, 1, 1, False),
    (60, 0.00, 40, 0.0, 30, 0.0, 1, 1, 1, False),
    (2, 0.00, 90, 0.0, 45, 0.0, 1, 1, 1, False),
    (35, 0.10, 200, 0.0, 0, 0.0, 0, 1, 1, False),
    (150, 0.00, 60, 0.0, 80, 0.0, 0, 1, 0, False),
    (9, 0.20, 300, 0.0, 0, 0.0, 0, 1, 0, False),
    (40, 0.00, 30, 0.0, 50, 0.0, 1, 1, 0, False),
    (25, 0.50, 20, 0.0, 10, 0.0, 0, 1, 0, False),
    (30, 0.00, 12, 0.0, 40, 0.0, 0, 0, 1, False),
    (120, 0.00, 80, 0.0, 0, 0.0, 0, 0, 1, False),
    (2, 0.00, 1, 1.0, 9, 0.0, 0, 0, 1, False),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 0, 1, False),
    (15, 0.40, 3, 0.0, 60, 0.0, 0, 0, 1, False),
    (45, 0.00, 30, 0.0, 50, 0.0, 0, 0, 0, True),
    (3, 0.00, 60, 0.0, 40, 0.0, 0, 0, 0, True),
    (200, 0.10, 4, 1.0, 60, 0.0, 0, 0, 0, True),
    (7, 0.00, 0, 0.0, 80, 0.0, 0, 0, 0, True),
    (2, 0.00, 70, 0.0, 0, 0.0, 0, 0, 0, True),
    (18, 0.30, 50, 0.0, 35, 0.1, 0, 0, 0, True),
    (1, 1.00, 1, 1.0, 1, 1.0, 0, 0, 0, False),
    (2, 1.00, 0, 0.0, 2, 1.0, 0, 0, 0, False),
    (12, 0.90, 40, 0.0, 3, 1.0, 0, 0, 0, False),
    (30, 0.80, 1, 1.0, 60, 0.0, 0, 0, 0, False),
    (5, 0.60, 90, 0.0, 30, 0.0, 0, 0, 0, False),
    # Pages without article or main: short text beside links, and linked paragraphs between long ones.
    (6, 0.00, 2, 1.0, 0, 0.0, 0, 0, 0, False),
    (3, 0.00, 1, 1.0, 1, 1.0, 0, 0, 0, False),
    (4, 0.00, 0, 0.0, 2, 1.0, 0, 0, 0, False),
    (9, 0.00, 4, 0.9, 3, 1.0, 0, 0, 0, False),
    (12, 0.60, 90, 0.0, 30, 0.0, 0, 0, 0, False),
    (9, 0.50, 40, 0.0, 0, 0.0, 0, 0, 0, False),
    (15, 0.70, 70, 0.0, 60, 0.0, 0, 0, 0, False),
    (7, 0.75, 0, 0.0, 40, 0.0, 0, 0, 0, False),
    (10, 0.45, 6, 0.0, 8, 0.0, 0, 0, 0, False),
    (10, 0.80, 100, 0.0, 120, 0.0, 0, 0, 0, False),
    (14, 0.90, 55, 0.0, 52, 0.0, 0, 0, 0, False),
    (6, 1.00, 80, 0.0, 75, 0.0, 0, 0, 0, False),
    (12, 0.65, 45, 0.0, 56, 0.0, 0, 0, 0, False),
    (20, 0.60, 1, 1.0, 4, 1.0, 0, 0, 0, False),
    (18, 0.55, 3, 1.0, 2, 0.9, 0, 0, 0, False),
    (30, 0.50, 2, 1.0, 3, 1.0, 0, 0, 0, False),
    (10, 0.10, 60, 0.0, 45, 0.0, 0, 0, 0, True),
    (14, 0.20, 30, 0.0, 80, 0.0, 0, 0, 0, True),
    (12, 0.25, 40, 0.0, 70, 0.0, 0, 0, 0, True),
    (8, 0.15, 90, 0.0, 0, 0.0, 0, 0, 0, True),
    (15, 0.30, 9, 0.0, 12, 0.0, 0, 0, 0, True),
    (36, 0.67, 60, 0.0, 60, 0.0, 0, 0, 0, True),
    (50, 0.60, 80, 0.0, 40, 0.0, 0, 0, 0, True),
    (33, 0.70, 110, 0.0, 120, 0.0, 0, 0, 0, True),
    (80, 0.65, 48, 0.0, 90, 0.0, 0, 0, 0, True),
    (8, 0.00, 9, 0.8, 2, 1.0, 0, 0, 0, False),
    (2, 0.00, 5, 1.0, 4, 0.7, 0, 0, 0, False),
    (10, 0.10, 1, 1.0, 2, 1.0, 0, 0, 0, False),
    (7, 0.00, 6, 0.0, 1, 1.0, 0, 0, 0, False),
    (26, 0.70, 2, 1.0, 30, 0.8, 0, 0, 0, False),
    (40, 0.90, 6, 1.0, 8, 0.0, 0, 0, 0, False),
    (24, 0.80, 60, 0.0, 2, 1.0, 0, 0, 0, False),
    (40, 0.50, 90, 0.0, 80, 0.0, 0, 0, 0, True),
    (60, 0.45, 120, 0.0, 45, 0.05, 0, 0, 0, True),
    (35, 0.60, 50, 0.0, 70, 0.0, 0, 0, 0, True),
    (22, 0.40, 64, 0.0, 38, 0.0, 0, 0, 0, True),
    (28, 0.75, 45, 0.1, 55, 0.0, 0, 0, 0, True),
    (6, 0.00, 2, 1.0, 75, 0.0, 0, 0, 0, True),
    (45, 0.00, 3, 1.0, 2, 1.0, 0, 0, 0, True),
    (90, 0.05, 2, 1.0, 0, 0.0, 0, 0, 0, True),
    (60, 0.00, 2, 1.0, 0, 0.0, 0, 0, 0, True),
    (20, 0.00, 2, 1.0, 0, 0.0, 0, 0, 0, True),
    (60, 1.00, 2, 1.0, 40, 1.0, 0, 0, 0, False),
    (60, 0.10, 50, 0.0, 2, 1.0, 0, 0, 0, True),
    (45, 0.20, 80, 0.0, 3, 1.0, 0, 0, 0, True),
    (50, 0.30, 2, 1.0, 3, 1.0, 0, 0, 0, True),
    (120, 0.95, 60, 0.0, 30, 1.0, 0, 0, 0, False),
    (25, 0.00, 3, 1.0, 5, 0.0, 0, 0, 0, True),
    (40, 0.00, 4, 1.0, 12, 0.0, 0, 0, 0, True),
    (8, 0.00, 0, 0.0, 2, 0.0, 0, 0, 0, True),
    (5, 0.00, 4, 0.0, 3, 0.0, 0, 0, 0, True),
    (25, 0.00, 60, 0.0, 2, 1.0, 0, 0, 0, True),
    (30, 0.00, 1, 1.0, 25, 0.0, 0, 0, 0, True),
    (8, 0.00, 30, 0.0, 2, 1.0, 0, 0, 0, True),
    (4, 0.00, 30, 0.0, 25, 0.0, 0, 0, 0, True),
    (5, 0.00, 6, 0.0, 7, 0.0, 0, 0, 0, True),
    (8, 0.00, 5, 0.0, 0, 0.0, 0, 0, 0, True),
    (4, 0.00, 0, 0.0, 0, 0.0, 0, 0, 0, True),
)

RAW_OPEN = re.compile(r"<(%s)(?=[\s/>])" % "|".join(RAW), re.IGNORECASE)
RAW_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
RAW_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"</?[a-zA-Z][^<>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)")
LONGEST_TAG = 1 << 16  # quotes in a tag longer than this don't count: it ends at the next >
DEEPEST_LINE = 512  # inline elements open within each other; further ones are not told apart
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LEADING = ("has", "with", "no", "is", "without")


FIRM, LOOSE, LAYOUT = 1, 2, 3


def furniture_of(name: str, attributes: str, outer_article: bool = False) -> int:
    """How an element is marked as page furniture, or 0: FIRM by its name, its role or the first word of a class or id;
    LOOSE by another of its words, LAYOUT where that is none of ASIDES. An article in no other one (outer_article) is
    furniture only by its role or where a class starts with one of ASIDES."""
    if name in FURNITURE:
        return FIRM
    if not attributes or name in ("html", "body", "main"):
        return 0
    found = 0
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if kind.lower() == "role":
            if value.strip().lower() in FURNITURE_ROLES:
                return FIRM
            continue
        for one in value.split():
            words = [w.lower() for w in WORD.findall(one)]
            if not words or any(w in LEADING for w in words) or not any(w in FURNITURE_WORDS for w in words):
                continue
            if words[0] in (ASIDES if outer_article else FURNITURE_WORDS):
                return FIRM
            if not outer_article:
                found = LOOSE if found == LOOSE or any(w in ASIDES for w in words) else LAYOUT
    return found


def article_of(name: str, attributes: str) -> str:
    """article or main, by an element's name or role, or empty."""
    if name in ARTICLE:
        return name
    roles = [(v or w or x).strip().lower() for k, v, w, x in ATTRIBUTE.findall(attributes) if k.lower() == "role"] if attributes else []
    return next((x for x in roles if x in ARTICLE), "")


def tokens(page: str):
    """(start, end, raw name, "" or "/", tag name, attributes) of each piece of markup, in one pass that never goes back:
    comments, raw elements with what they hold (raw name), tags, and what looks like one (no name at all)."""
    at, size, last = 0, len(page), page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, None, "", None, ""
            continue
        m = RAW_OPEN.match(page, start) if start < last else None
        if m:
            end = RAW_END.match(page, m.end(), min(size, m.end() + LONGEST_TAG))
            inside = end.end() if end else page.find(">", m.end()) + 1
            close = RAW_CLOSE[m[1].lower()].search(page, inside)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or size
            yield start, at, m[1], "", None, ""
            continue
        m = TAG.match(page, start, min(size, start + LONGEST_TAG))
        if m:
            at = m.end()
            yield start, at, None, m[1], m[2], m[3]
            continue
        m = LOOSE_TAG.match(page, start)
        if m:
            at = m.end()
            yield start, at, None, "", None, ""
        else:
            at = start + 1


class _Blocks:
    """The open elements of a page and its blocks so far. Counters stand for searches through what is open, so that the
    work is linear in the page."""

    def __init__(self):
        self.blocks: list[list] = []
        self.within: list[int] = []  # the innermost loose element around each block, -1 for none
        self.stack: list[tuple[str, bool, str, bool]] = []  # name, firm furniture, article, loose furniture of each open element
        self.named: Counter = Counter()  # open elements by name
        self.loose: list[list] = []  # enclosing loose element, whether it may hold the article, and words, of each
        self.opened: list[tuple[int, int, int]] = []  # the open ones, with marks and words when they opened
        self.parts: list[str] = []
        self.linked = self.links = self.furniture = self.articles = self.outer = self.hidden = self.lines = 0
        self.marks = self.words = 0  # main headings and articles, and words outside firm furniture, so far

    def close_block(self) -> None:
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                self.blocks.append([" ".join(words), len(words), min(self.linked, len(words)), int(self.articles > 0), int(self.furniture > 0)])
                self.within.append(self.opened[-1][0] if self.opened else -1)
                if not self.furniture:
                    self.words += len(words)
            self.parts.clear()
        self.linked = 0

    def _count(self, entry: tuple, by: int) -> None:
        name, furniture, article, _ = entry
        inline = name in INLINE
        self.named[name] += by
        self.links += by * (name == "a")
        self.furniture += by * furniture
        self.articles += by * (article != "")
        self.outer += by * (article == "article")
        self.hidden += by * (furniture and inline)
        self.lines += by * inline

    def push(self, entry: tuple) -> None:
        if entry[0] in INLINE and self.lines >= DEEPEST_LINE:
            return
        self.stack.append(entry)
        self._count(entry, 1)

    def open_loose(self, holds: bool) -> None:
        self.opened.append((len(self.loose), self.marks, self.words))
        self.loose.append([self.opened[-2][0] if len(self.opened) > 1 else -1, holds, 0])

    def pop(self) -> None:
        entry = self.stack.pop()
        self._count(entry, -1)
        if entry[3]:
            self._settle(*self.opened.pop())

    def _settle(self, k: int, marks: int, words: int) -> None:
        self.loose[k][1] = self.loose[k][1] or self.marks > marks
        self.loose[k][2] = self.words - words

    def pop_through(self, k: int) -> None:
        while len(self.stack) > k:
            self.pop()

    def nearest_line(self, name: str) -> int:
        """Where the innermost open element of this name is, if only inline ones lie within it; else -1."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                return k
            if self.stack[k][0] not in INLINE:
                break
        return -1

    def add(self, text: str) -> None:
        if text and not self.hidden:  # furniture within a line goes without breaking the line
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def close(self, name: str) -> None:
        """An end tag."""
        inline = name in INLINE
        if not inline:
            self.close_block()
        if not self.named[name]:
            return
        if not inline:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()
            return
        k = self.nearest_line(name)  # never past a block's edge
        if k >= 0:
            rest = self.stack[k + 1 :]
            self.pop_through(k)
            for x in rest:
                self.push(x)

    def open(self, name: str, attributes: str) -> None:
        """A start tag."""
        inline = name in INLINE
        if name == "br":
            self.parts.append(" ")
            return
        if not inline:
            self.close_block()
        if name in VOID or name == "head":  # what a head may hold gives no text; anything else ends it
            return
        if name in CLOSES_P and self.named["p"] and (k := self.nearest_line("p")) >= 0:
            self.pop_through(k)
        if name in SELF_CLOSING and name != "p" and any(self.named[x] for x in SELF_CLOSING[name]):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in SELF_CLOSING[name]:
                    self.pop_through(k)
                    break
                if self.stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu") or name != "tr" and self.stack[k][0] == "tr":
                    break
        if attributes.rstrip().endswith("/") and name not in ("a", "p", "div"):
            return
        if name == "a" and self.named["a"]:  # links don't nest
            while self.named["a"]:
                self.pop()
        article = article_of(name, attributes)
        marked = furniture_of(name, attributes, article == "article" and not self.outer)
        furniture = marked == FIRM or marked > 0 and (inline or article != "")
        self.has_article = self.has_article or article != ""
        if not self.furniture and not furniture and (name == "h1" or article == "article" and not self.met):
            self.met = self.met or article == "article"
            self.marks += 1
        loose = marked > 0 and not furniture
        if loose:
            self.open_loose(marked == LAYOUT)
        self.push((name, furniture, article, loose))

    has_article = met = False


def blocks_of(page: str) -> tuple[list[list], bool]:
    """Flat blocks [text, words, linked words, in_article, furniture] of a page, and whether it has an article.

    An element marked LOOSE or LAYOUT is no furniture when it holds more than half of the words outside firm furniture,
    and, if LOOSE, the first article or a main heading too.
    """
    state, at = _Blocks(), 0
    for start, end, raw, slash, name, attributes in tokens(page):
        state.add(page[at:start])
        at = end
        if name is None:
            if raw and raw.lower() not in INLINE:
                state.close_block()
        elif slash:
            state.close(name.lower())
        else:
            state.open(name.lower(), attributes)
    state.add(page[at:])
    state.close_block()
    while state.opened:
        state._settle(*state.opened.pop())
    total = sum(b[1] for b in state.blocks if not b[4])
    dropped: list[bool] = []
    for around, holds, words in state.loose:
        dropped.append(not holds or 2 * words <= total or around >= 0 and dropped[around])
    for b, around in zip(state.blocks, state.within):
        if around >= 0 and dropped[around]:
            b[4] = 1
    return state.blocks, state.has_article


def train(rows=LABELLED):
    """A decision tree by Gini impurity: nested (feature, limit, at most, above), leaves are booleans."""
    labels = [r[-1] for r in rows]
    if all(labels) or not any(labels):
        return labels[0]

    def impurity(part) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            left, right = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            score = (round(impurity(left) + impurity(right), 9), f)
            if best is None or score < best[0]:
                best = (score, f, limit, left, right)
    if best is None:
        return 2 * sum(labels) >= len(labels)
    return best[1], best[2], train(best[3]), train(best[4])


TREE = train()


def decide(tree, features) -> bool:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if features[f] <= limit else high
    return tree


def main_text(page: str | None) -> str:
    """The main text's blocks, joined by empty lines."""
    if not page:
        return ""
    blocks, has_article = blocks_of(page)
    sizes = [(0, 0.0)] + [(b[1], b[2] / b[1]) for b in blocks] + [(0, 0.0)]
    kept = []
    for k, b in enumerate(blocks):
        features = (*sizes[k + 1], *sizes[k], *sizes[k + 2], b[3], b[4], int(has_article))
        if decide(TREE, features):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points of the text). Columns named like these are replaced."""

    @F.arrow_udf(T.StringType())
    def text_of(column):
        import pyarrow as pa

        return pa.array([main_text(page.as_py()) for page in column], pa.string())

    small_batches(pages.sparkSession)
    pages = without(pages, *(n for n in ("text", "n_chars") if n != html_col))
    names = pages.columns
    made = pages.withColumn("__text", text_of(F.col(html_col)))
    return made.select(*[F.col(f"`{c}`") for c in names], F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
