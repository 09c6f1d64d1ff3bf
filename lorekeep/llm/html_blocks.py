"""Main text of web pages from flat text blocks and a decision tree.

A page is read once into a flat list of blocks.  Each block has its number of words and its link
density, those of its two neighbours, and where it stands: inside navigation-like elements, inside
the article, a heading, in an element whose own class or id names something beside the text, in a wrapper of such a name (with the
share of the page's words in that wrapper, and whether it holds the headline), behind the marked article (with the article's share of
words).  A decision tree, trained on the small labelled table below, says which blocks are article text; no name decides alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import map_arrow, type_of

#: Elements whose content is never text of the page.
SKIPPED = frozenset("script style noscript template svg iframe object select textarea button head title math canvas audio video".split())
#: Of these, the ones whose content is no markup, and where it ends: at their own closing tag (a title at the body, too).
RAW = {name: re.compile(f"</{name}(?=[ \t\r\n\f/>])" + ("|<body(?=[ \t\r\n\f/>])" if name == "title" else ""), re.I) for name in ("script", "style", "textarea", "title")}
#: Elements that part blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Of these, the ones that end an open one of their own kind.
ENDS_ITSELF = frozenset("li td th tr dd dt".split())
#: Elements that are a block themselves: their class or id says something of them, not of what is around.
OWN_BLOCKS = frozenset("p blockquote pre li dd dt h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else that opens ends it.
IN_HEAD = frozenset("html head title base basefont bgsound link meta script style noscript template".split())
#: Skipped elements that may hold others of their kind.
NESTING = frozenset("object svg template math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of class and id names that stand for anything but the article.
ASIDE = frozenset("nav aside footer form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer\w*|foot|masthead|header|topbar|toolbar|"
    r"comments?|commentlist|respond|reply|replies|disqus|discussion|related|recommend\w*|share\w*|sharing|social\w*|subscribe|newsletter|signup|login|search\w*|pagination|pager|skip|hidden|copyright|legal|disclaimer|tags|meta)(?=$|[\s_-])",
    re.I,
)
#: What says of a wrapper how its page is laid out, what a page is filed under, or what state a script has put it in, and the header of
#: an article: none stands for what it names.
LAYOUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:has|with|without|no)[_-]\S*|(?:^|\s)(?:layout|category|tag|tax|term|topic|type|status|format|is|js|lang)[_-]\S*|"
    r"(?:^|(?<=\s))\S*[_-](?:enabled|disabled|open|opened|closed|active|inactive|visible|on|off|loaded|ready|fixed|sticky|collapsed|expanded)(?=\s|$)",
    re.I,
)
ARTICLE_HEADER = re.compile(r"(?:^|(?<=\s))(?:article|story|post|entry)[_-]+header(?=$|\s)", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|story|post|entry|main|content|body)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"[\x20\x09-\x0D\xa0]+")


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    aside: bool
    main: bool
    heading: bool
    own: bool
    wrappers: tuple[int, ...] = ()  # those around it that are named for something beside the text, the innermost last
    level: int = 0  # 2 in an article element, 1 in what else holds the article
    headline: bool = False


def _standing(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, bool]:
    """Whether an element with these attributes stands aside, whether only its class or id says so,
    whether it holds the article, and whether it is the page's main element.  ``inside`` an article
    a header is the article's."""
    aside, named, main, whole = name in ASIDE, False, name in ("article", "main"), name == "main"
    own_header = False
    if attributes.strip(" /"):
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        role = found.get("role", "").lower()
        aside = aside or role in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
        main, whole = main or role in ("main", "article"), whole or role == "main"
        if name not in ("html", "body") and not main:
            own_header = bool(ARTICLE_HEADER.search(names))
            named = not aside and bool(ASIDE_NAMES.search(LAYOUT_NAMES.sub(" ", ARTICLE_HEADER.sub(" ", names))))
            main = not aside and not named and bool(MAIN_NAMES.search(names))
    aside = aside or (name == "header" and not inside and not own_header)
    return aside, named and not aside, main, whole


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order.  Anything is accepted; empty gives none."""
    blocks: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool, bool, bool, tuple[int, ...]]] = []  # element, stands aside, holds the article, is one, named itself, wrappers around it
    aside = main = articles = links = own = wrappers = 0
    inside: tuple[int, ...] = ()  # wrappers named for something beside the text
    heading, skipping, loose, at = "", "", False, 0
    ahead: dict[str, int] = {}  # where the next tag of a kind is

    def next_tag(opening: str, begin: int) -> int:
        """Where the next ``<name`` or ``</name`` from ``begin`` on is; behind the page's end if nowhere."""
        if ahead.get(opening, -1) < begin:
            found = re.compile(opening + r"(?=[\s/>])", re.I).search(page, begin)
            ahead[opening] = found.start() if found else len(page) + 1
        return ahead[opening]

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                words = text.count(" ") + 1
                in_links = len(html.unescape("".join(linked)).split())
                blocks.append(Block(text, words, min(1.0, in_links / words), aside > 0, main > 0, bool(heading), own > 0, inside, 2 if articles else int(main > 0), heading == "h1"))
            parts, linked = [], []

    def pop(count: int) -> None:
        nonlocal aside, main, articles, own, inside
        for _ in range(count):
            _, was_aside, was_main, was_article, was_own, inside = stack.pop()
            aside -= was_aside
            main -= was_main
            articles -= was_article
            own -= was_own

    position = 0
    while token := TOKEN.search(page, position):
        position = token.end()
        if not skipping and token.start() > at:
            parts.append(page[at : token.start()])
            if links:
                linked.append(page[at : token.start()] + " ")
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(token[1] or token[4]), token[3] or token[6] or ""
        if name in RAW and not closing and not attributes.rstrip().endswith("/"):
            end = RAW[name].search(page, position)
            position = end.start() if end else len(page)
        if skipping:
            if closing and name == skipping:
                skipping = ""
                continue
            if skipping in ("head", "title"):
                if closing or name in IN_HEAD:
                    continue
            elif not (loose and name in BLOCKS):
                continue
            skipping = ""
        if name in SKIPPED and not closing:
            if not attributes.rstrip().endswith("/"):
                skipping = name
                end = next_tag(f"</{name}", position)
                # One that nobody closes ends at the next block.
                loose = name not in RAW and name != "head" and (end > len(page) or (name not in NESTING and next_tag(f"<{name}", position) < end))
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            close()
            links = 0
            if name in HEADINGS:
                heading = "" if closing else name
            elif not closing:
                heading = ""
            if name == "hr":
                continue
            if closing:
                if (depth := next((i for i, x in enumerate(reversed(stack)) if x[0] == name), None)) is not None:
                    pop(depth + 1)
            else:
                if stack and stack[-1][0] == "p":  # a paragraph holds no block: one that is left open ends here
                    pop(1)
                if name in ENDS_ITSELF and stack and stack[-1][0] == name:
                    pop(1)
                is_aside, is_named, is_main, whole = _standing(name, attributes, main > 0)
                is_own = is_named and name in OWN_BLOCKS
                is_article = is_main and name == "article"
                stack.append((name, is_aside, is_main, is_article, is_own, inside))
                if whole:  # the page's main element isn't what a wrapper's name says
                    inside = ()
                elif is_named and not is_own:
                    wrappers += 1
                    inside = (*inside, wrappers)
                aside += is_aside
                main += is_main
                articles += is_article
                own += is_own
    if not skipping and at < len(page):
        parts.append(page[at:])
    close()
    return blocks


#: Labelled situations: stands aside, in the article, heading, named itself; (words, link density) of blocks; of the
#: neighbours they were seen between; article text or not.
SITUATIONS = [
    # menus, breadcrumbs, adverts, notices, side columns, site headers and footers, forms, comments of readers
    (1, 0, 0, 0, [(1, 1.0), (4, 0.0), (12, 0.1), (80, 0.0), (30, 0.4)], [((0, 0.0), (1, 1.0)), ((60, 0.0), (9, 0.0)), ((1, 1.0), (40, 0.0)), ((6, 0.0), (0, 0.0))], 0),
    (1, 1, 0, 0, [(2, 1.0), (5, 0.0), (18, 0.2), (120, 0.0)], [((90, 0.0), (15, 0.0)), ((30, 0.0), (2, 1.0)), ((4, 0.0), (0, 0.0))], 0),
    (1, 0, 1, 0, [(2, 0.0), (6, 0.5)], [((0, 0.0), (2, 1.0)), ((70, 0.0), (25, 0.0))], 0),
    (1, 1, 1, 0, [(2, 0.0), (9, 0.0)], [((70, 0.0), (8, 1.0)), ((3, 0.0), (60, 0.0))], 0),
    (1, 1, 0, 1, [(3, 0.0), (40, 0.0)], [((70, 0.0), (8, 1.0)), ((3, 0.0), (60, 0.0))], 0),
    # bylines, share lines, tags and the like inside an article; the same names on paragraphs that say something
    (0, 1, 0, 1, [(1, 0.0), (3, 0.5), (6, 0.0), (9, 0.2), (20, 0.8)], [((9, 0.0), (60, 0.0)), ((60, 0.0), (70, 0.0)), ((40, 0.0), (0, 0.0)), ((1, 1.0), (1, 1.0))], 0),
    (0, 1, 1, 1, [(2, 0.0), (6, 0.0)], [((60, 0.0), (9, 1.0)), ((9, 0.0), (60, 0.0))], 0),
    (0, 1, 0, 1, [(16, 0.0), (30, 0.1), (120, 0.0)], [((9, 0.0), (60, 0.0)), ((60, 0.0), (70, 0.0)), ((40, 0.0), (0, 0.0)), ((12, 0.0), (14, 0.0))], 1),
    (0, 0, 0, 1, [(3, 0.0), (12, 0.1), (25, 0.0), (70, 0.0)], [((60, 0.0), (70, 0.0)), ((1, 1.0), (40, 0.0)), ((5, 0.0), (0, 0.0))], 0),
    # lists of links that no name gives away, inside an article and elsewhere
    (0, 1, 0, 0, [(1, 1.0), (6, 0.9), (9, 0.7), (25, 0.8)], [((60, 0.0), (9, 1.0)), ((5, 1.0), (7, 0.8)), ((3, 0.0), (0, 0.0)), ((20, 0.0), (50, 0.0))], 0),
    (0, 0, 0, 0, [(1, 1.0), (3, 1.0), (14, 0.9), (25, 0.7)], [((2, 1.0), (3, 1.0)), ((60, 0.0), (40, 0.1)), ((0, 0.0), (12, 0.0))], 0),
    # scraps that stand nowhere in particular
    (0, 0, 0, 0, [(1, 0.0), (3, 0.0), (6, 0.2), (8, 0.0)], [((1, 1.0), (1, 1.0)), ((0, 0.0), (2, 1.0)), ((4, 0.0), (0, 0.0)), ((3, 0.0), (3, 0.0)), ((60, 0.0), (2, 1.0)), ((0, 0.0), (40, 0.0))], 0),
    # headlines and paragraphs of an article that is marked as such, short ones too
    (0, 1, 0, 0, [(1, 0.0), (4, 0.0), (12, 0.25), (30, 0.45), (90, 0.0), (400, 0.02)], [((1, 1.0), (60, 0.0)), ((8, 0.0), (0, 0.0)), ((40, 0.0), (50, 0.0)), ((1, 0.0), (2, 0.0)), ((30, 0.3), (9, 1.0)), ((120, 0.0), (7, 0.0))], 1),
    (0, 1, 1, 0, [(2, 0.0), (9, 0.0), (15, 0.3)], [((7, 0.0), (60, 0.0)), ((3, 1.0), (1, 0.0)), ((50, 0.0), (2, 1.0)), ((12, 0.0), (12, 0.0))], 1),
    # running text on pages that mark nothing, with the short paragraphs and headlines among it
    (0, 0, 0, 0, [(14, 0.0), (22, 0.2), (60, 0.05), (150, 0.4)], [((1, 1.0), (80, 0.0)), ((60, 0.0), (75, 0.1)), ((40, 0.0), (3, 1.0)), ((2, 1.0), (2, 1.0)), ((0, 0.0), (4, 0.0)), ((5, 0.0), (0, 0.0))], 1),
    (0, 0, 0, 0, [(1, 0.0), (3, 0.1), (8, 0.0)], [((60, 0.0), (70, 0.0)), ((45, 0.1), (30, 0.0)), ((25, 0.0), (40, 0.2)), ((18, 0.0), (20, 0.0)), ((16, 0.1), (30, 0.0))], 1),
    (0, 0, 1, 0, [(3, 0.0), (8, 0.0)], [((2, 1.0), (60, 0.0)), ((45, 0.0), (50, 0.0)), ((0, 0.0), (30, 0.0)), ((2, 1.0), (16, 0.0)), ((16, 0.0), (18, 0.0))], 1),
]
#: Wrappers named for something beside the text: the share of the page's words inside, whether the headline is inside, and
#: whether what is inside is as it would be without the wrapper (else it isn't article text).
WRAPPERS = [
    # layout and state: all of the page, or most of it
    (1.0, 1, 1), (0.9, 1, 1), (0.7, 1, 1), (0.5, 1, 1),
    # banners that hold the name of the site; related, adverts, notices; readers' comments, which may outgrow the article
    (0.2, 1, 0), (0.05, 1, 0), (0.02, 0, 0), (0.1, 0, 0), (0.3, 0, 0), (0.6, 0, 0), (0.9, 0, 0), (1.0, 0, 0),
]
#: Behind what is marked as the article: its share of the page's words, and whether that says nothing of the block.
BEHIND = [(0.1, 1), (0.25, 1), (0.45, 0), (0.7, 0), (0.95, 0)]
#: One row a block: aside, main, link density, words, words and link density before, the same after, heading, own, in a named wrapper, the headline
#: too, the wrapper's share of words, the share of the article that it is behind; label.
_PLAIN = [(aside, main, density, words, *before, *after, heading, own, label) for aside, main, heading, own, blocks, around, label in SITUATIONS for words, density in blocks for before, after in around]
LABELLED = [(*row[:-1], 0, 0, 0.0, 0.0, row[-1]) for row in _PLAIN]
LABELLED += [(*row[:-1], 1, headline, share, 0.0, row[-1] * same) for row in _PLAIN if not row[0] for share, headline, same in WRAPPERS]
LABELLED += [(*row[:-1], 0, 0, 0.0, share, row[-1] * same) for row in _PLAIN if not row[0] for share, same in BEHIND]


class Tree:
    """A decision tree of least Gini impurity, grown until its leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray) -> None:
        self.feature: list[int] = []
        self.at: list[float] = []
        self.below: list[int] = []
        self.above: list[int] = []
        self.share: list[float] = []
        self._grow(rows, labels)

    def _grow(self, rows: np.ndarray, labels: np.ndarray) -> int:
        node = len(self.share)
        self.share.append(float(labels.mean()))
        for x in (self.feature, self.at, self.below, self.above):
            x.append(-1)
        best = (np.inf, 0, 0.0)
        if 0 < labels.mean() < 1:
            for k in range(rows.shape[1]):
                values = np.unique(rows[:, k])
                for at in (values[1:] + values[:-1]) / 2:
                    low = rows[:, k] <= at
                    impurity = sum(m.sum() * (p := labels[m].mean()) * (1 - p) for m in (low, ~low))
                    best = min(best, (impurity, k, float(at)))
        if best[0] < np.inf:
            low = rows[:, best[1]] <= best[2]
            self.feature[node], self.at[node] = best[1], best[2]
            self.below[node] = self._grow(rows[low], labels[low])
            self.above[node] = self._grow(rows[~low], labels[~low])
        return node

    def predict(self, row: tuple) -> float:
        node = 0
        while self.feature[node] >= 0:
            node = self.below[node] if row[self.feature[node]] <= self.at[node] else self.above[node]
        return self.share[node]


def train_tree(table: list[tuple] = LABELLED) -> Tree:
    data = np.array(table, dtype=float)
    return Tree(data[:, :-1], data[:, -1])


def features(blocks: list[Block]) -> list[tuple]:
    """A row for each block, in the order of the labelled table."""
    around = [(0, 0.0), *((b.words, b.link_density) for b in blocks), (0, 0.0)]
    total, in_wrapper, titled, in_level, last = 0.0, {}, set(), [0.0, 0.0, 0.0], [-1, -1, -1]
    for i, b in enumerate(blocks):
        text = b.words * (1 - b.link_density)
        total += text
        for w in b.wrappers:
            in_wrapper[w] = in_wrapper.get(w, 0.0) + text
        if b.headline:
            titled.update(b.wrappers)
        if not b.aside:
            in_level[b.level] += text
            last[b.level] = i
    rows = []
    for i, b in enumerate(blocks):
        inner = b.wrappers[-1] if b.wrappers else 0
        share = in_wrapper[inner] / max(total, 1e-9) if inner else 0.0
        behind = sum(in_level[k] for k in range(b.level + 1, 3) if last[k] < i) / max(total, 1e-9)
        rows.append((int(b.aside), int(b.main), b.link_density, b.words, *around[i], *around[i + 2], int(b.heading), int(b.own), int(inner > 0), int(inner in titled), share, behind))
    return rows


def main_text(page: str, tree: Tree) -> str:
    """Article blocks joined by line feeds; empty if there are none."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if tree.predict(row) >= 0.5)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple] = LABELLED) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every row, repeated rows and null ids included.

    Null, empty and text-free pages give the empty text.  Whole pages are read; nothing is capped.
    Other columns of ``pages`` are not read.
    """
    schema = f"{id_col} {type_of(pages, id_col)}, {url_col} {type_of(pages, url_col)}, text string, n_chars bigint"
    names = [id_col, url_col, "text", "n_chars"]
    tree = train_tree(labelled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, tree) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return map_arrow(pages.select(id_col, url_col, html_col), work, schema)
