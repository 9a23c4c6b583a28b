"""The main text of web pages from flat blocks (operator 1).

A page is read once, from left to right, into flat blocks: runs of text between tags that begin or end a
block. Each block carries its number of words and its share of linked words, the same of the blocks before
and after it, and where it stands (inside the marked article, inside a part that is none, a heading). A decision
tree tells article blocks from the others. It is trained on a small labelled table of pages
(``labelled_pages``) and walked for all blocks of a slice at once.

A name or a form says that a part is no article, but a page may be wrapped in one. So each block also has the
place it has in two more readings: without such parts outside of articles, and without them anywhere. They are taken
in turn if a page has no text otherwise; and the second if it alone finds a marked article, of more than twice the words.
A class name or id names such a part as a whole (``masthead``), or by one of its pieces (``reader-comments``), unless another
piece denies it or makes it a topic (``no-ads``, ``comments-enabled``, ``category-social``). An article or main tag with such a
name is none only behind an article without.

Scripts, styles, comments of the markup and the head are no blocks. Inside a block character references are
decoded, white space (as Python's ``str.split`` sees it, the no-break space included) becomes one space, and ends
are trimmed. A line break tag is white space. Article blocks are joined by one line end in page order; none is cut.

Every page is read where its row is; nothing is shuffled. A null or empty page has an empty text. Text
without any markup is one block. Unclosed tags, quotes and comments reach to where the next tag or the page ends.
Repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ranlens.llm.common import mapped, slices
from ranlens.llm.labelled_pages import PAGES

# Names of HTML.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre
    search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio button canvas""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OTHER_TAGS = frozenset(
    "nav aside footer head menu noscript template select option optgroup button svg canvas object video audio dialog search fieldset".split()
)
#: What a start tag ends that was left open.
ENDED_BY = {tag: {"p"} for tag in BLOCK_TAGS - {"option", "optgroup", "button"}}
ENDED_BY |= {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"}}
ENDED_BY |= {"td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}, "tbody": {"p", "td", "th", "tr", "thead"}}
#: Elements that no unclosed element inside them ends.
HOLDERS = frozenset("ul ol dl table div section article main aside nav body td th form blockquote header footer".split())
MAIN_WORDS = frozenset("article articlebody post entry story content main maincontent text body".split())
OTHER_WORDS = frozenset(
    """ad ads adbox adslot advert advertisement adverts advertising sponsor sponsored promo promotion breadcrumb breadcrumbs footer
    masthead topbar toolbar comment comments commentlist commentsection commentform respond reply replies disqus discussion cookie cookies
    cookiebar cookiebanner consent gdpr notice notices sitenotice announcement alert popup modal overlay newsletter subscribe signup
    login share sharing social related recommended recommendations teaser teasers pagination pager tagcloud copyright disclaimer
    hidden skip search topnav mainnav subnav sidenav commentsarea commentarea cookienotice cookieconsent relatedposts sitefooter pagefooter
    sharebuttons socialshare sociallinks socialicons newsletterform newslettersignup searchform searchbox loginform adcontainer
    adwrapper adbanner""".split()
)
#: Pieces of a longer name that say the same, and pieces beside them that annul it.
OTHER_PIECES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion comment comments disqus
    replies cookie cookies consent gdpr newsletter subscribe subscription related recommended recommendations share sharing social
    notice notices disclaimer teaser teasers breadcrumb breadcrumbs pagination copyright footer popup login signup""".split()
)
ANNULLING_PIECES = frozenset(
    """no non not without free has have with enabled disabled open closed off on hide show category cat tag topic term author type
    format status print""".split()
)
#: Names that a frame around the whole page may bear as well, so an article inside it is one.
FRAME_WORDS = frozenset("nav navbar navigation menu banner sidebar widget widgets".split())
HEADER_WORDS = frozenset(["header"])
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

FEATURES = (
    "words", "linked", "words_before", "linked_before", "words_after", "linked_after",
    "in_main", "elsewhere", "heading", "ends_sentence", "page_marked",
)

TOKEN = re.compile(
    r"""<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+>?|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>?"""
)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""[\s"'/](class|id|role|style|hidden|href|data-main)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>"'])""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")
SENTENCE_END = (".", "!", "?", ":", '"', "”", "…", "。")

# What a tag opens, and where a block stands.
NOTHING, MAIN_TAG, MAIN_HINT, OTHER, OTHER_HINT, HEADER, NAMED_OTHER, NAMED_MAIN, FORM = range(9)
NEUTRAL, MAIN, HINTED, FRAMED, OUTSIDE, MAIN_HEADER = range(6)
STANDS = {
    NEUTRAL: (NEUTRAL, MAIN, HINTED, OUTSIDE, FRAMED, OUTSIDE),
    MAIN: (MAIN, MAIN, MAIN, OUTSIDE, OUTSIDE, MAIN_HEADER),
    HINTED: (HINTED, MAIN, HINTED, OUTSIDE, FRAMED, MAIN_HEADER),
    FRAMED: (FRAMED, MAIN, FRAMED, OUTSIDE, FRAMED, FRAMED),
    OUTSIDE: (OUTSIDE,) * 6,
    MAIN_HEADER: (MAIN_HEADER, MAIN_HEADER, MAIN_HEADER, OUTSIDE, OUTSIDE, MAIN_HEADER),
}
#: What the kinds that only a name or form tells mean in the first reading.
AT_FIRST = {NAMED_OTHER: OTHER, FORM: OTHER_HINT}
READINGS = 3


def stands_in(reading: int, parent: int, kind: int) -> int:
    """Where the content of an element stands in a reading."""
    if kind in AT_FIRST:
        passed = reading == 2 or (reading == 1 and parent in (NEUTRAL, FRAMED))
        kind = NOTHING if passed else AT_FIRST[kind]
    return STANDS[parent][kind]


def is_other_name(name: str) -> bool:
    """Whether a class name or id says that what bears it is no article."""
    pieces = set(SPLIT.split(name))
    return SPLIT.sub("", name) in OTHER_WORDS or bool(pieces & OTHER_PIECES) and not pieces & ANNULLING_PIECES


@lru_cache(maxsize=10_000)
def opened(tag: str) -> tuple[str, bool, bool, int, bool, bool]:
    """Of a tag as written: its name, whether it ends one, ends itself, what it opens, is a link, is labelled."""
    name, ends = TAG.match(tag).group(1).lower(), tag[1] == "/"
    if ends or (name not in BLOCK_TAGS and name not in ("a", "script", "style")):
        return name, ends, name in VOID_TAGS, NOTHING, False, False
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(tag)}
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    words = set(SPLIT.split(" ".join(names)))
    is_other = any(map(is_other_name, names))
    kind = NOTHING
    unseen = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")
    if name in OTHER_TAGS or found.get("role") in OTHER_ROLES or unseen:
        kind = OTHER
    elif name in ("body", "html"):
        kind = NOTHING
    elif name in ("article", "main") or found.get("role") in ("main", "article"):
        kind = NAMED_MAIN if is_other else MAIN_TAG
    elif is_other:
        kind = NAMED_OTHER
    elif name == "form":
        kind = FORM
    elif words & FRAME_WORDS:
        kind = OTHER_HINT
    elif name == "header" or (words & HEADER_WORDS and not words & MAIN_WORDS):
        kind = HEADER
    elif words & MAIN_WORDS:
        kind = MAIN_HINT
    return name, ends, name in VOID_TAGS or tag.endswith("/>") and name == "svg", kind, "href" in found, "data-main" in found


@dataclass
class Block:
    text: str
    words: int
    linked: float
    stands: tuple[int, ...]  # in each reading
    heading: bool
    labelled: bool


@dataclass
class Page:
    """The blocks of a page, collected while its tags are read."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, tuple[int, ...], bool]] = field(default_factory=list)  # name, where its content stands, labelled
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    has_article: bool = False

    def add(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.in_link:
            self.linked.append(text)

    def flush(self) -> None:
        """End the block at hand."""
        if not self.parts:
            return
        words = "".join(self.parts).split()
        if words:
            stands, labelled = (self.open[-1][1], self.open[-1][2]) if self.open else ((NEUTRAL,) * READINGS, False)
            linked = len(" ".join(self.linked).split()) / len(words)
            heading = bool(self.open) and self.open[-1][0] in HEADINGS
            self.blocks.append(Block(" ".join(words), len(words), min(linked, 1.0), stands, heading, labelled))
        self.parts, self.linked = [], []

    def end(self, name: str) -> None:
        """Close the named element and what was left open inside it; a stray end closes nothing."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return

    def begin(self, name: str, kind: int, labelled: bool) -> None:
        ended = ENDED_BY.get(name, ())
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ended:
                del self.open[i:]
            elif self.open[i][0] in HOLDERS:
                break
        if kind == NAMED_MAIN:
            kind = OTHER if self.has_article else MAIN_TAG
        elif kind == MAIN_TAG and name == "article":
            self.has_article = True
        parents = self.open[-1][1] if self.open else (NEUTRAL,) * READINGS
        self.open.append((name, tuple(stands_in(i, parent, kind) for i, parent in enumerate(parents)), labelled))


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page in order."""
    read, at, size = Page(), 0, len(page)
    while at < size:
        token = TOKEN.search(page, at)
        if token is None:
            read.add(page[at:])
            break
        if token.start() > at:
            read.add(page[at : token.start()])
        at, tag = token.end(), token.group()
        if tag[1] in "!?":
            continue
        name, ends, void, kind, link, labelled = opened(tag)
        if name == "br":
            read.add(" ")
        elif name == "a":
            read.in_link = link and not ends
        elif name in RAW_TAGS and not ends:
            close = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else size
            if name not in ("script", "style"):
                read.flush()
        elif name in BLOCK_TAGS:
            read.flush()
            if ends:
                read.end(name)
            elif not void:
                read.begin(name, kind, labelled)
    read.flush()
    return read.blocks


def features(blocks: list[Block], reading: int = 0) -> np.ndarray:
    """A row a block, in the order of FEATURES."""
    words = np.array([0, *(b.words for b in blocks), 0], dtype=float)
    linked = np.array([0, *(b.linked for b in blocks), 0])
    stands = [b.stands[reading] for b in blocks]
    tagged = MAIN in stands
    marked = tagged or HINTED in stands or MAIN_HEADER in stands
    own = np.array(
        [
            (
                at == MAIN or (at == HINTED and not tagged) or (at == MAIN_HEADER and b.heading),
                at in (FRAMED, OUTSIDE) or (at == MAIN_HEADER and not b.heading),
                b.heading,
                b.text.endswith(SENTENCE_END),
                marked,
            )
            for b, at in zip(blocks, stands)
        ],
        dtype=float,
    ).reshape(len(blocks), 5)
    around = [words[1:-1], linked[1:-1], words[:-2], linked[:-2], words[2:], linked[2:]]
    return np.column_stack([*around, own])


@dataclass(frozen=True)
class Tree:
    """A decision tree as arrays over its nodes; a leaf's branches lead to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray
    depth: int

    def is_main(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.main[at]


def grown(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Tree:
    """A tree whose splits lower the Gini impurity most; the first of equal splits is taken."""
    feature, threshold, left, right, main = [], [], [], [], []

    def impurity(labels: np.ndarray) -> float:
        share = labels.mean() if len(labels) else 0
        return 2 * share * (1 - share) * len(labels)

    def grow(rows: np.ndarray, level: int) -> int:
        node = len(feature)
        for array, initial in ((feature, 0), (threshold, np.inf), (left, node), (right, node), (main, y[rows].mean() >= 0.5)):
            array.append(initial)
        best, least = None, impurity(y[rows]) - 1e-9
        for j in range(x.shape[1]) if level < depth else ():
            values = np.unique(x[rows, j])
            for cut in (values[1:] + values[:-1]) / 2:
                under = x[rows, j] <= cut
                rest = impurity(y[rows[under]]) + impurity(y[rows[~under]])
                if rest < least:
                    best, least = (j, cut), rest
        if best:
            under = x[rows, best[0]] <= best[1]
            feature[node], threshold[node] = best
            left[node], right[node] = grow(rows[under], level + 1), grow(rows[~under], level + 1)
        return node

    grow(np.arange(len(y)), 0)
    return Tree(*map(np.array, (feature, threshold, left, right, main)), depth=depth)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages.

    Every block counts four times: as it stands, as if it stood in a marked article, outside the one of its
    page, and in a part of the page that is no article.
    """
    pages = [blocks_of(page) for page in PAGES]
    x, y = np.concatenate([features(p) for p in pages]), np.array([b.labelled for p in pages for b in p], dtype=float)
    stands = [FEATURES.index(name) for name in ("in_main", "elsewhere", "page_marked")]
    moved = []
    for where in ((1, 0, 1), (0, 0, 1), (0, 1, 0)):
        moved.append(x.copy())
        moved[-1][:, stands] = where
    return np.concatenate([x, *moved]), np.concatenate([y, np.ones(len(y)), np.zeros(2 * len(y))])


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    return grown(*labelled_table())


def read_again(blocks: list[Block], kept: np.ndarray, tree: Tree) -> np.ndarray:
    """Which blocks are of the article, given those of the first reading."""
    marks = [{b.stands[i] for b in blocks} & {MAIN, HINTED, MAIN_HEADER} for i in range(READINGS)]
    if kept.any():
        if marks[0] or not marks[1]:
            return kept
        again, words = tree.is_main(features(blocks, 1)).astype(bool), np.array([b.words for b in blocks])
        return again if words[again].sum() > 2 * words[kept].sum() else kept
    for reading in range(1, READINGS):
        if any(b.stands[reading] != b.stands[0] for b in blocks):
            again = tree.is_main(features(blocks, reading)).astype(bool)
            if again.any():
                return again
    return kept


def main_texts(pages: list[str], tree: Tree) -> list[str]:
    """The main text of each page."""
    blocks = [blocks_of(page) for page in pages]
    is_main = tree.is_main(np.concatenate([np.zeros((0, len(FEATURES))), *(features(b) for b in blocks)])).astype(bool)
    texts, at = [], 0
    for own in blocks:
        kept = read_again(own, is_main[at : at + len(own)], tree)
        texts.append("\n".join(b.text for b, keep in zip(own, kept) if keep))
        at += len(own)
    return texts


def extracted(pages: DataFrame, html_column: str = "html", carried: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, ``text`` (the main text of the whole page) and ``n_chars`` (its code points)."""
    tree = trained_tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_column):
            texts = main_texts([h or "" for h in batch.column(html_column).to_pylist()], tree)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in carried),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                [*carried, "text", "n_chars"],
            )

    kinds = ", ".join(f"`{name}` {pages.schema[name].dataType.simpleString()}" for name in carried)
    return mapped(pages.select(*carried, html_column), extract, f"{kinds}, text string, n_chars long")
