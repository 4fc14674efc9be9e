"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path. Text length and punctuation are summed per path
and divided by its blocks; both ratios are smoothed over neighbouring blocks, fused by their product, and blocks at or
above a threshold are content, as are headings right before them. The text of its content blocks is the weight of an
element, and decides what the page is about:

* Menus, footers and dialogs go by their tags, asides and forms unless they hold the article or over half of the page's weight.
* The article is looked for without what is marked as menu, sidebar, advert, notice and the like, by a word in class, id or role: it is the heaviest article, a main element, or else the deepest element that holds all content.
  A mark only proposes; the mean fused ratio of the blocks in the marked element decides. Outside of the article it goes if
  that is below the article's highest, or if the page names its article or main; inside, if it is below the threshold of content, or
  if the tags that its content stands in aren't those of the article's own content.
  What is mostly links goes in either place; what is left is part of the text.
* Comments are told by structure: an element with such a word that repeats like elements, or has the word again inside, is
  left out wherever it is and whatever it weighs; without that structure the word counts outside of the article.
* Article and main elements are the article if they hold half of the weight or more, else the deepest element that holds
  all of it. All their blocks are returned, short ones too; lists of links without content are left out of the latter.

Time and memory are linear in the page. Defined cases: null html counts as empty; a page without text gives ''; unclosed,
truncated and stray tags are allowed; repeated rows give repeated rows; an empty table gives no rows; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea title select option button iframe object svg canvas math".split())
#: Up to the end of the page if unclosed, as in browsers; other raw elements then end at the next tag.
TO_END = frozenset(("script", "style"))
#: The end of an option or button, or what shows that it is unclosed.
BREAKS = {
    "option": re.compile(r"(</option\s*(?:>|\Z))|<(?:option|optgroup|/optgroup|/select|/datalist)\b", re.I),
    "button": re.compile(r"(</button\s*(?:>|\Z))|<(?:/?(?:article|aside|body|footer|form|header|html|li|main|nav|ol|section|table|td|ul)|button|h[1-6]|p)\b", re.I),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Never the article, whatever they hold.
HARD = frozenset("nav footer menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsbygoogle sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "masthead toolbar pagination pager login copyright complementary contentinfo".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies discussion disqus".split())
#: What a single comment may be; paragraphs and headings repeat in any text.
UNITS = frozenset("div li article section dd tr blockquote".split())
#: Words of boxes that are left out only if their own ratio is low.
BOX_WORDS = frozenset("promo promotion banner widget widgets notice notices popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations search skip".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z:_-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.S)
_WORDS = re.compile(r"[a-z]+")
_PUNCT = re.compile(r"[.,;:!?。，؟¿¡]")
SMOOTH = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
_TAG = re.compile(r"<[A-Za-z/!?]")
#: Class words that only say whether a page has something.
_STATE = re.compile(r"\b(?:has|have|with|without|no)[-_]+[A-Za-z]+")
#: Share of the weight that article and main elements must hold, and of the page's weight that no mark may take.
HOLD = 0.5
#: Sums of the same ratios may differ by rounding.
SAME = 1 - 1e-9


class Node:
    """An element: what its tag and attributes say, its place in page order and the number of its tag path."""

    __slots__ = ("tag", "parent", "at", "path", "mark", "box", "talk", "hidden", "main", "inside", "link", "kind")

    def __init__(self, tag: str, parent: "Node | None", attrs: str, at: int, path: int):
        self.tag, self.parent, self.at, self.path = tag, parent, at, path
        self.main = tag in ("article", "main")
        self.inside = parent is not None and (parent.inside or parent.main)
        self.link = tag == "a" or parent is not None and parent.link
        self.mark = tag in ASIDE_TAGS or (tag == "header" and not self.inside)
        self.box = self.talk = self.hidden = False
        self.kind = tag
        if attrs and tag not in ("html", "body"):
            for name, value in _ATTR.findall(attrs):
                name = name.lower()
                if name in ("class", "id", "role"):
                    words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", _STATE.sub(" ", value)).lower())
                    self.mark = self.mark or bool(ASIDE_WORDS.intersection(words)) or not self.inside and "header" in words
                    self.box = self.box or bool(BOX_WORDS.intersection(words))
                    self.talk = self.talk or bool(COMMENT_WORDS.intersection(words))
                    if name == "class":
                        self.kind = f"{tag} {' '.join(words)}"
                if name == "role" and "main" in value.lower():
                    self.main = True
                if name == "style" and re.search(r"display\s*:\s*none", value, re.I) or name == "aria-hidden" and "true" in value.lower():
                    self.hidden = True
            if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
                self.hidden = True


class Page:
    """The elements of a page in page order, parents first, and its blocks: owner, text, and how much of it is links."""

    def __init__(self, page: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes = [Node("", None, "", 0, 0)]
        self.owners: list[Node] = []
        self.texts: list[str] = []
        self.links: list[float] = []
        self._read(page)

    def _node(self, tag: str, parent: Node, attrs: str) -> Node:
        path = parent.path if tag in INLINE else self.paths.setdefault((parent.path, tag), len(self.paths) + 1)
        self.nodes.append(Node(tag, parent, attrs, len(self.nodes), path))
        return self.nodes[-1]

    def _read(self, page: str) -> None:
        top = owner = self.nodes[0]
        held: list[str] = []
        linked = 0
        open_tags: dict[str, int] = defaultdict(int)

        def end_block() -> None:
            nonlocal linked
            if held:
                raw = "".join(held)
                text = " ".join(entities.unescape(raw).split())
                if text:
                    self.owners.append(owner)
                    self.texts.append(text)
                    self.links.append(linked / len(raw))
                held.clear()
                linked = 0

        def words(text: str) -> None:
            nonlocal owner, linked
            if text:
                if not held:
                    owner = top
                held.append(text)
                linked += len(text) * top.link

        def close(node: Node) -> None:
            nonlocal top
            while top is not node.parent:
                open_tags[top.tag] -= 1
                top = top.parent

        def pop_to(tags: tuple[str, ...], stop: frozenset) -> None:
            if not any(open_tags[t] for t in tags):
                return
            node = top
            while node.parent is not None and node.tag not in stop:
                if node.tag in tags:
                    close(node)
                    return
                node = node.parent

        at, n = 0, len(page)
        absent: set[str] = set()

        def closing(tag: str):
            """The next end of a raw element; what has none isn't searched for again."""
            found = None if tag in absent else re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            if found is None:
                absent.add(tag)
            return found

        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                words(page[at:])
                break
            words(page[at : m.start()])
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                end_block()
            if m.group(1):
                if open_tags[tag]:
                    node = top
                    while node.tag != tag and (tag not in INLINE or node.tag in INLINE):
                        node = node.parent
                    if node.tag == tag:  # a stray end of an inline element doesn't close blocks
                        if node.mark or node.box or node.talk or node.hidden:
                            end_block()
                        close(node)
                continue
            if tag in RAW:
                if not m.group(3).rstrip().endswith("/"):
                    end = BREAKS[tag].search(page, at) if tag in BREAKS else closing(tag)
                    if end and tag in BREAKS and not end.group(1):
                        end = None
                    if end is None and tag not in TO_END:
                        after = _TAG.search(page, at)
                        at = after.start() if after else n
                    else:
                        at = end.end() if end else n
                continue
            if tag in VOID:
                continue
            if tag in BLOCK_CLOSES_P:
                pop_to(("p",), frozenset(("article", "aside", "body", "button", "div", "section", "td", "th", "main", "li", "blockquote")))
            if tag in CLOSED_BY:
                pop_to(CLOSED_BY[tag], frozenset(("ul", "ol", "dl", "table", "menu", "div", "article", "section")))
            node = self._node(tag, top, m.group(3))
            if node.mark or node.box or node.talk or node.hidden:
                end_block()
            open_tags[tag] += 1
            top = node
        end_block()

    def inherited(self, own) -> list[bool]:
        """For each element whether own(element) holds for it or for one that it is in."""
        out: list[bool] = []
        for x in self.nodes:
            out.append(bool(own(x)) or x.parent is not None and out[x.parent.at])
        return out

    def sums(self, values) -> list:
        """For each element the sum of values (one for each block) over the blocks in it."""
        out = [0] * len(self.nodes)
        for owner, value in zip(self.owners, values):
            out[owner.at] += value
        for x in reversed(self.nodes[1:]):
            out[x.parent.at] += out[x.at]
        return out


def path_scores(paths: list[int], texts: list[str]) -> np.ndarray:
    """The fused tag-path ratio of each block."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in zip(paths, texts):
        length[path] += len(text)
        marks[path] += len(_PUNCT.findall(text))
        count[path] += 1
    text_ratio = np.array([length[p] / count[p] for p in paths])
    mark_ratio = np.array([marks[p] / count[p] for p in paths])

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, 2, mode="edge")
        return np.convolve(padded, SMOOTH, mode="valid")

    return smooth(text_ratio) * (1 + smooth(mark_ratio))


def _scores(page: Page, live: list[bool]) -> tuple[list[float], float]:
    """The score of each block, 0 if it isn't live, and the threshold of content."""
    at = [k for k, on in enumerate(live) if on]
    out = [0.0] * len(live)
    if not at:
        return out, 0.0
    scores = path_scores([page.owners[k].path for k in at], [page.texts[k] for k in at])
    for k, score in zip(at, scores.tolist()):
        out[k] = score
    return out, float(min(scores.mean(), 0.5 * scores.max()))


def _content(page: Page, live: list[bool]) -> list[bool]:
    """Of each block whether it is content among the live ones."""
    at = [k for k, on in enumerate(live) if on]
    scores, least = _scores(page, live)
    out = [on and score >= least for on, score in zip(live, scores)]
    heading = page.inherited(lambda x: x.tag in HEADINGS)
    for k, after in zip(at[-2::-1], at[:0:-1]):
        if out[after] and heading[page.owners[k].at]:
            out[k] = True
    return out


def _deepest(page: Page, content: list[bool]) -> Node:
    """The deepest element that holds all content, and isn't part of a paragraph."""
    total = page.sums(content)
    best = page.nodes[0]
    for x in page.nodes:  # parents come first, so the deepest that holds all content is the last
        if total[x.at] == total[0]:
            best = x
    while best.parent is not None and (best.tag in INLINE or best.tag == "p" or best.tag in HEADINGS):
        best = best.parent
    return best


def _leaf(x: Node) -> str:
    """The tag that ends the tag path of a block."""
    while x.tag in INLINE and x.parent is not None:
        x = x.parent
    return x.tag


def _talks(page: Page, live: list[bool]) -> list[bool]:
    """Of each element with a word of comments whether its structure is that of comments: like units, or the word again inside."""
    size = page.sums([len(t) * v for t, v in zip(page.texts, live)])
    again = [False] * len(page.nodes)
    units: dict[tuple[int, str], int] = defaultdict(int)
    for x in reversed(page.nodes[1:]):
        up = x.parent.at
        again[up] = again[up] or again[x.at] or x.talk
        if x.tag in UNITS and size[x.at]:
            units[up, x.kind] += 1
    repeats = [False] * len(page.nodes)
    for (at, _), n in units.items():
        repeats[at] = repeats[at] or n > 1
    for x in reversed(page.nodes[1:]):  # the units may stand in a list inside
        if repeats[x.at] and not x.talk:
            repeats[x.parent.at] = True
    return [x.talk and (again[x.at] or repeats[x.at]) for x in page.nodes]


def _asides(page: Page) -> list[bool]:
    """Of each element whether it is left out, or in one that is."""
    gone = page.inherited(lambda x: x.hidden or x.tag in HARD)
    live = [not gone[o.at] for o in page.owners]
    talks = _talks(page, live)
    chatter = page.inherited(lambda x: talks[x.at])
    live = [on and not chatter[o.at] for on, o in zip(live, page.owners)]
    scores, least = _scores(page, live)
    content = _content(page, live)
    weight = page.sums([len(t) * c for t, c in zip(page.texts, content)])
    blocks, length = page.sums(live), page.sums([len(t) * v for t, v in zip(page.texts, live)])
    ratio = [s / max(n, 1) for s, n in zip(page.sums(scores), blocks)]
    links = page.sums([len(t) * s * v for t, s, v in zip(page.texts, page.links, live)])
    marked = [x.mark or x.box or x.talk for x in page.nodes]
    in_article = page.inherited(lambda x: x.tag == "article")
    articles = [x for x in page.nodes if x.tag == "article" and weight[x.at]]
    cores = {x.at for x in page.nodes if x.main and x.tag != "article" and length[x.at]}
    if articles:
        cores.add(max(articles, key=lambda x: weight[x.at]).at)
    if not cores:
        beside = page.inherited(lambda x: marked[x.at])
        plain = _content(page, [on and not beside[o.at] for on, o in zip(live, page.owners)])
        if any(plain):
            cores = {_deepest(page, plain).at}
    inside = page.inherited(lambda x: x.at in cores)
    needed = [x.at in cores for x in page.nodes]
    for x in reversed(page.nodes[1:]):
        needed[x.parent.at] = needed[x.parent.at] or needed[x.at]
    has_core = any(x.main and length[x.at] for x in page.nodes)
    richest = max((score for score, o in zip(scores, page.owners) if inside[o.at]), default=0.0)

    beside = page.inherited(lambda x: marked[x.at])
    leaves = [_leaf(o) for o in page.owners]
    own = {leaf for leaf, o, c in zip(leaves, page.owners, content) if c and inside[o.at] and not beside[o.at]}
    alike = page.sums([len(t) * (c and leaf in own) for t, c, leaf in zip(page.texts, content, leaves)])

    def left_out(x: Node) -> bool:
        if x.hidden or x.tag in HARD or talks[x.at]:
            return True
        if not marked[x.at] or needed[x.at] or x.tag == "article" and not in_article[x.parent.at]:
            return False
        if ratio[x.at] < SAME * least or links[x.at] > HOLD * max(length[x.at], 1):
            return True
        if x.mark and x.tag in ASIDE_TAGS and (has_core or weight[x.at] <= HOLD * weight[0]):
            return True  # the tag itself says that it isn't the article
        if inside[x.at]:
            return alike[x.at] < HOLD * weight[x.at] or not weight[x.at]
        return x.talk or has_core or ratio[x.at] < SAME * richest

    return page.inherited(left_out)


def main_text(html: str | None) -> str:
    page = Page(html or "")
    aside = _asides(page)
    live = [not aside[o.at] for o in page.owners]
    content = _content(page, live)
    if not any(content):
        return ""
    weight = [len(t) * c for t, c in zip(page.texts, content)]
    in_main, in_article = page.inherited(lambda x: x.main), page.inherited(lambda x: x.tag == "article")
    held = sum(w for w, o in zip(weight, page.owners) if in_main[o.at])
    if held and held >= HOLD * sum(weight):
        # of a main element whose content is all in articles, what is beside these isn't the article
        outer = [None] * len(page.nodes)
        for x in page.nodes:
            outer[x.at] = (x.parent is not None and outer[x.parent.at]) or (x if x.main else None)
        own = page.sums(weight)
        inner = page.sums([w * in_article[o.at] for w, o in zip(weight, page.owners)])
        keep = []
        for o, on in zip(page.owners, live):
            top = outer[o.at]
            keep.append(on and top is not None and (in_article[o.at] or not own[top.at] or own[top.at] > inner[top.at]))
    else:
        total, best = page.sums(content), _deepest(page, content)
        size, links = page.sums([len(t) * v for t, v in zip(page.texts, live)]), page.sums([len(t) * s * v for t, s, v in zip(page.texts, page.links, live)])
        lists = page.inherited(lambda x: x.tag not in INLINE and not total[x.at] and links[x.at] > HOLD * size[x.at])
        within = page.inherited(lambda x: x is best)
        keep = [on and within[o.at] and not lists[o.at] for o, on in zip(page.owners, live)]
    return " ".join(text for text, k in zip(page.texts, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text: one row for each row of pages."""

    def one(batch: pa.RecordBatch):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return common.map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), one, "page_id long, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
