"""Main text of web pages by tree scoring.

Method: the page becomes a tree; what is never an article (``DROPPED`` elements, elements named,
by class, id or role, after ``NAMES``, hidden ones) is left out. Each run of text gives points for
its length and its commas, in full to the element that holds the paragraph and by shrinking
shares to the next ancestors; the points of an element are discounted by the share of its text
that is in links. The element with most points is the container; it is widened to the article
or main element around it, else joined by those siblings that have points enough, are
headings, or are paragraphs of prose. Their whole text is the result.

Character references are decoded, white space within a block becomes one space, and blocks are
joined in page order by one space. Nothing is cut: pages are read whole, whatever their length.
Unclosed and misnested tags, stray end tags, unclosed comments and truncated pages are read as
far as they go, in time that grows with the page, not with its nesting. Images and elements of no known
name don't divide words. Of several articles that do not hold one another the one whose paragraphs
have most points is the text. Inside an article a name drops an element only if the whole of one of its
class or role names says so (``NAMES`` words and filling ones), and it is no paragraph named by its id alone, nor an element of prose
under one of the ``DOUBTFUL`` names, which sections of an article have, too. A null or empty page, or one without text, has the empty text. Ties go to the
element that begins first. Repeated rows are extracted alike; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signbridge.llm.common import text_slices

# Element names of HTML, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
DROPPED = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label map menu nav noembed "
                    "noframes noscript object script select style svg template textarea title video xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: Elements that make a block of their own; any other (images, unknown names) stands within its line.
BLOCK = frozenset("#root address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link listing main menu meta "
                  "nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Words in a class, id or role that name what is not the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising advertorial alert author-bio banner breadcrumb breadcrumbs byline-share "
                  "comment comments complementary consent contentinfo cookie cookies dialog discussion disqus feedback footer "
                  "gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
                  "outbrain overlay pager pagination paywall popup promo promos promoted promotion reactions recommended "
                  "related replies reply respond responses search share sharing sidebar signin signup skip social sponsor "
                  "sponsored subscribe subscription taboola toolbar topbar tracking warning widget widgets".split())
#: Of these the names that sections of an article have, too, and words that say nothing beside a name.
DOUBTFUL = frozenset("alert author-bio banner dialog discussion feedback header notification overlay reactions recommended related replies reply "
                     "respond responses search skip social toolbar topbar tracking warning widget".split())
FILLING = frozenset("area aside block body bottom box col column container content group inner item left list main outer page panel "
                    "post right row section site top wrap wrapper".split())
#: Elements that end an open one of the same group, up to the element that holds them.
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDERS = frozenset("ul ol dl table select html body article section div".split())

#: Characters outside of links from which on an element of a doubtful name in an article holds prose.
PROSE = 40
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile("[,،、，;；]")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "points", "text", "linked", "order", "inline", "block", "held", "main", "doubtful")

    def __init__(self, tag: str, parent: Node | None, dropped: bool | None, order: int, doubtful: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.order, self.doubtful = tag, parent, dropped, order, doubtful
        self.items: list[Node | str] = []
        self.inline = tag in INLINE or tag not in BLOCK and tag not in DROPPED
        #: The nearest block, the tags open since the nearest holder, and the nearest article around it.
        self.block: Node = parent.block if self.inline and parent else self
        self.held: Counter = Counter() if parent is None or tag in HOLDERS else parent.held
        self.main: Node | None = parent if parent and parent.tag in MAIN else parent and parent.main
        self.points = 0.0
        self.text = self.linked = 0


def _words(value: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(value)]


def _named(attributes: str, tag: str, in_main: bool) -> tuple[str, bool]:
    """The name by which the attributes place the element beside the article ("" if none does), and whether they hide it."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            if in_main:  # one whole name, and no anchor of a paragraph
                lists = [[w for w in _words(v) if not w.isdigit()] for v in value.split()] if name != "id" or tag not in PARAGRAPH else []
                found = [w for v in lists if all(x in NAMES or x in FILLING for x in v) for w in v if w in NAMES]
            else:
                found = [w for w in _words(value) if w in NAMES]
            if found:
                return next((w for w in found if w not in DOUBTFUL), found[0]), False
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "", True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "", True
    return "", False


def parse(page: str) -> list[Node]:
    """The nodes of the page in page order; the first is the root. An element that ``NAMES`` names is
    marked by ``dropped = None`` until it is known how much of the page it holds."""
    root = Node("#root", None, False, 0)
    nodes, now, at, end = [root], root, 0, len(page)
    holders: Counter = Counter()  # open elements of ``HOLDERS``

    def up_to(node: Node) -> Node:
        """End all elements within ``node``, and it."""
        x = now
        while True:
            if x.tag in HOLDERS:
                holders[x.tag] -= 1
            else:
                x.held[x.tag] -= 1
            if x is node:
                return node.parent
            x = x.parent

    def innermost(tags: tuple[str, ...]) -> Node | None:
        """The innermost open element of ``tags`` below the nearest holder."""
        if not any(now.held[t] for t in tags):
            return None
        x = now
        while x.tag not in tags:
            x = x.parent
        return x

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!][^<]*\Z", rest)  # a tag that the end of the page cuts
            now.items.append(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            now.items.append(page[at: m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # a stray end tag doesn't close what is around it
            if tag in HOLDERS:
                node = now if holders[tag] else None
                while node is not None and node.tag != tag:
                    node = node.parent
            else:
                node = innermost((tag,))
            if node is not None and node.parent is not None:
                now = up_to(node)
            continue
        if tag not in INLINE and (tag in BLOCK or tag in DROPPED) and tag not in VOID or tag == "hr":  # blocks end an open paragraph
            node = now.block
            if node.tag in ("p", *HEADINGS) and (node.tag == "p" or tag in HEADINGS):
                now = up_to(node)
        if tag in CLOSES:
            while (node := innermost(CLOSES[tag])) is not None:
                now = up_to(node)
        in_main = now.tag in MAIN or now.main is not None
        name, hidden = _named(m[3], tag, in_main) if m[3] and tag not in ("html", "body", *MAIN) or tag == "article" and m[3] else ("", False)
        node = Node(tag, now, True if hidden or tag in DROPPED else None if name else False, len(nodes), in_main and name in DOUBTFUL)
        nodes.append(node)
        now.items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if close is None:
                break
            at = close.end()
        elif tag not in VOID and not m[3].endswith("/"):
            now = node
            if tag in HOLDERS:
                holders[tag] += 1
            else:
                node.held[tag] += 1
    return nodes


def score(nodes: list[Node]) -> None:
    """Text lengths, what is left out, and points."""
    def measure(node: Node) -> None:
        node.text = sum(len(x.strip()) if isinstance(x, str) else x.text for x in node.items) if node.dropped is not True else 0
        node.linked = node.text if node.tag == "a" else sum(x.linked for x in node.items if isinstance(x, Node))

    for node in reversed(nodes):
        measure(node)
    # what is around the largest article stays, and without one a wrapper that is named after a part of it
    star = max((n for n in nodes if n.tag in MAIN and n.dropped is False), key=lambda n: n.text, default=None)
    wrappers: set[Node] = set()
    if star is not None:
        up = star
        while up is not None:
            wrappers.add(up)
            up = up.parent
    else:
        held: Counter = Counter()
        for node in reversed(nodes[1:]):
            held[node.parent] += held[node] + (node.tag in PARAGRAPH and node.text > 0)
        wrappers = {n for n, paragraphs in held.items() if paragraphs >= 3 and n.text >= 0.6 * nodes[0].text}
    for node in nodes:
        if node.parent is not None and node.parent.dropped is True:
            node.dropped = True
        elif node.tag == "header":  # a page's header goes, an article's stays
            node.dropped = node.main is None and node not in wrappers
        elif node.doubtful and node.dropped is None and (node.text - node.linked >= PROSE or node.inline or node.tag in PARAGRAPH):
            node.dropped = False
        elif node.dropped is None:
            node.dropped = node not in wrappers
    for node in reversed(nodes):
        measure(node)
    for node in nodes:
        if node.dropped or node.inline:
            continue
        own, linked, commas = 0, 0, 0
        stack: list[tuple[Node | str, bool]] = [(x, False) for x in node.items]
        while stack:  # the text that no deeper block holds
            x, in_link = stack.pop()
            if isinstance(x, str):
                size = len(x.strip())
                own += size
                linked += size * in_link
                commas += len(_COMMAS.findall(x))
            elif not x.dropped and x.inline:
                stack += [(y, in_link or x.tag == "a") for y in x.items]
        if not own:
            continue
        points = ((own >= 25) + min(own / 100, 3) + commas) * (1 - linked / own)
        up, share = (node.parent if node.tag in PARAGRAPH else node), 1.0
        for _ in range(4):
            if up is None or up.parent is None:
                break
            if not up.inline:
                up.points += points * share
                share = share / 2 if share == 1 else share / 3
            up = up.parent


def blocks(node: Node, out: list[list[str]]) -> None:
    """The text below ``node``, a list of pieces for each block."""
    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif not x.dropped:
            if x.inline:
                stack += reversed(x.items)
            else:
                out.append([])
                stack += [None, *reversed(x.items)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = parse(page)
    named = [n for n in nodes if n.dropped is None]
    score(nodes)
    if named and not nodes[0].text:  # all that the page has is named like something beside an article
        nodes = parse(page)
        for n in nodes:
            n.dropped = bool(n.dropped)
        score(nodes)
    live = [n for n in nodes if not n.dropped and n.parent is not None and not n.inline]
    density = lambda n: n.linked / n.text if n.text else 0.0
    value = lambda n: n.points * (1 - density(n))
    best = max(live, key=lambda n: (value(n), -n.order), default=nodes[0])
    if not best.points:
        best = next((n for n in live if n.tag in MAIN), next((n for n in live if n.tag == "body"), nodes[0]))
    up = around = best
    while up is not None:
        if up.tag in MAIN:
            around = up
            break
        up = up.parent
    chosen = [around]
    if up is None and best.parent is not None and best.tag != "body":
        enough = max(2.0, 0.2 * value(best))
        chosen = []
        for x in best.parent.items:
            if x is best:
                chosen.append(x)
            elif isinstance(x, Node) and not x.dropped and x.text and density(x) < 0.33:
                prose = x.tag == "p" and (x.text > 80 or density(x) == 0)
                if x.tag in HEADINGS or prose or value(x) >= enough:
                    chosen.append(x)
    out: list[list[str]] = [[]]
    for x in chosen:
        out.append([])
        blocks(x, out)
    texts = (" ".join(html.unescape("".join(b)).split()) for b in out if b)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
