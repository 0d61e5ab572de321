"""Main text of web pages by scores in the tree of elements.

The page is read in one pass into blocks of text, each in the element that holds it. Every
paragraph passes points for its length and its commas to its container and less to the
containers around; a container's points are discounted by its share of link text. The best one
only says where the article is: the whole <article> or <main> around it is kept, and on the way up
to the page all that stands beside it, as long as nothing there is a menu or left out; where
something is, siblings that aren't mostly links and hold a paragraph. No bar grows with the page.
Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and hidden parts
count for nothing and are left out wherever they stand. A class, id or role marks such a part if every
word of a name is one of boilerplate or of layout (site-footer, but not has-sidebar or related-work), and
doesn't where the element holds most of the page's points; comments, adverts and consent never count.

Nulls: null or empty html, and a page without text, give an empty text; null page_id and url are
kept. Unclosed, crossed and cut-off tags never fail: a raw element without an end (svg, iframe, select) ends where the next
block begins, and only script, style, textarea and title run to the end. Of containers with equal scores the first counts.
Long and deep pages take linear time. Repeated pages get a row each. Only page_id, url and html are read, so other
columns can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logsift.llm.tokens import lean
from logsift.session import ship_package

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Elements by what they do; fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp svg math object canvas select".split())
OUT = frozenset("nav footer aside form button menu dialog fieldset head label datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark meter output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id and role that mark what isn't the article, those that no wrapper of an article has, and those that say nothing beside them.
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply respond search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo alert alertdialog".split())
FOREIGN = frozenset("ad ads advert adverts advertisement advertising captcha comment comments commentlist consent cookie cookies disqus gdpr hidden login newsletter reply respond".split())
LAYOUT = frozenset("site page main global top bottom left right center upper lower primary secondary fixed sticky first second third inner outer wrap wrapper container box block area section region row column col panel bar list item items group holder slot unit zone inline mobile desktop link links button buttons icon icons title heading text body bg overlay the and of for by js id my wp m u l r".split())
OF_ARTICLES = frozenset("article articles post posts entry story stories news blog content product products topic topics thread form media network networks google dfp facebook twitter count counter meta info message messages signup nav tags cloud sub".split())
TO_THE_END = frozenset("script style textarea title".split())  # without an end tag all that follows is theirs
BLOCK = re.compile(rf"<(?:{'|'.join(sorted(CLOSES_P | PARAGRAPH))})[\s/>]", re.IGNORECASE)
HEADER_WORDS = frozenset(("header", "topbar"))
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 2.0, "td": 1.0, "body": 0.0, "html": 0.0}


class Node:
    __slots__ = ("tag", "parent", "score", "chars", "links", "out", "marked", "kids", "prose", "in_header", "in_article")

    def __init__(self, tag: str, parent: Node | None, out: bool, marked: str = ""):
        self.tag, self.parent, self.out, self.marked = tag, parent, out, marked
        self.score, self.chars, self.links, self.kids, self.prose = 0.0, 0, 0, [], False
        self.in_header = tag == "header" or bool(parent) and parent.in_header
        self.in_article = tag in ("article", "main") or bool(parent) and parent.in_article

    def linked(self) -> bool:
        return self.links * 2 >= self.chars > 0


def _marks(name: str) -> str:
    """Whether a name in class, id or role says that an element isn't the article's: "foreign", "layout" or ""."""
    words = {w.lower() for w in NAME.findall(name)}
    if words & BOILERPLATE and words <= BOILERPLATE | LAYOUT | OF_ARTICLES:
        return "foreign" if words & FOREIGN else "layout"
    return "header" if words & HEADER_WORDS and words <= HEADER_WORDS | LAYOUT else ""


def _leaves_out(tag: str, attributes: str, parent: Node) -> tuple[bool, str]:
    """Whether an element and all in it is no part of an article for certain, and by what its names mark it as such."""
    if parent.out or tag in OUT:
        return True, ""
    if tag == "header" and not parent.in_article:
        return True, ""
    marked = ""
    if not attributes.strip() or tag in ("html", "body"):
        return False, ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for mark in map(_marks, value.split()):
                if tag == "header" and "banner" in value.lower().split():
                    return True, ""
                if mark and tag not in ("article", "main") and not (mark == "header" and tag in HEADINGS | {"header"}):
                    marked = marked if marked == "foreign" else mark
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, ""
    return False, marked


def _judge(blocks: list[tuple[Node, int, str]], nodes: list[Node]) -> None:
    """Leaves marked elements out, but those that hold most of the points of all that isn't foreign."""
    if not any(n.marked for n in nodes):
        return
    foreign, points = set(), dict.fromkeys(map(id, nodes), 0.0)
    for n in nodes:
        if n.marked == "foreign" or id(n.parent) in foreign:
            foreign.add(id(n))
    for n, links, text in blocks:
        if not n.out and id(n) not in foreign and links * 2 < len(text):
            points[id(n)] += _points(text)
    for n in reversed(nodes):
        if n.parent:
            points[id(n.parent)] += points[id(n)]
    for n in nodes:  # parents come before their children
        n.out = n.out or bool(n.parent) and n.parent.out or bool(n.marked) and points[id(n)] * 2 <= points[id(nodes[0])]


def _points(text: str) -> float:
    return min(len(text) / 100, 3) + text.count(",") + (1 if len(text) >= 25 else 0)


def _parse(html: str) -> tuple[list[tuple[Node, int, str]], list[Node]]:
    """Blocks in page order, as (element, letters in links, text), and all elements."""
    root = Node("html", None, False)
    nodes, stack, blocks = [root], [root], []
    text: list[str] = []
    links, depth, end = 0, 0, len(html)
    tags, unclosed = Counter(), set()  # open elements by tag; tags that no end tag follows any more

    def end_of(tag: str, at: int):
        found = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
        if not found:
            unclosed.add(tag)
        return found

    def flush():
        nonlocal links
        if text:
            if words := "".join(text).split():
                out, at = " ".join(words), stack[-1]
                blocks.append((at, min(links, len(out)), out))
                at.chars += len(out)
                at.links += min(links, len(out))
            text.clear()
        links = 0

    def add(raw: str):
        nonlocal links
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if depth:
                links += len(raw)

    def close(names, stop=()):
        if not any(tags[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                flush()
                tags.subtract(n.tag for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    at = 0
    while at < end:
        m = TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE and tag not in VOID:
                flush()
                close({tag})
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag in TO_THE_END:
                if found := end_of(tag, at):
                    at = found.end()
                elif tag in TO_THE_END:
                    at = end
                elif found := BLOCK.search(html, at):  # not closed: it ends where the next block begins
                    at = found.start()
            if tag not in ("script", "style"):
                text.append(" ")
            continue
        if tag in INLINE:
            if m[3] and any(_leaves_out(tag, m[3], stack[-1])) and not stack[-1].out and tag != "a":  # an inline advert
                found = end_of(tag, at)
                at = found.end() if found else at
            elif tag == "a":
                depth = 1
            continue
        flush()
        depth = 0
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close({"p"}, ("td", "th", "li", "div", "article", "section"))
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(HEADINGS)
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], ("ul", "ol", "table", "dl", "select"))
        node = Node(tag, stack[-1], *_leaves_out(tag, m[3], stack[-1]))
        stack[-1].kids.append(node)
        nodes.append(node)
        stack.append(node)
        tags[tag] += 1
    flush()
    return blocks, nodes


def main_text(html: str | None) -> str:
    """The blocks of the article, one a line."""
    if not html:
        return ""
    blocks, nodes = _parse(html)
    _judge(blocks, nodes)
    kept = [(n, links, x) for n, links, x in blocks if not n.out and (n.tag in HEADINGS or not n.in_header)]
    if not kept:
        return ""
    for n in reversed(nodes):  # children come after their parents
        if n.parent and not n.out:
            n.parent.chars += n.chars
            n.parent.links += n.links
    touched = {}
    for n, links, text in kept:
        points = _points(text)
        at = n.parent if n.tag in PARAGRAPH and n.parent else n
        share = 1.0
        while at and share >= 0.125:
            touched[id(at)] = at
            at.score += points * share
            at, share = at.parent, share / 2
        if links * 2 < len(text) and (n.tag in PARAGRAPH or len(text) >= 25):
            at = n
            while at and not at.prose:
                at.prose, at = True, at.parent
    lists = ("ul", "ol", "dl", "table", "tbody", "thead", "tr")
    best, top = None, -1.0
    for n in touched.values():
        if n.tag in PARAGRAPH or n.tag in lists:
            continue
        score = (n.score + BONUS.get(n.tag, 0.0)) * (1 - n.links / max(1, n.chars))
        if score > top:
            best, top = n, score
    whole, own = _article(best or nodes[0])

    for n in nodes:  # parents come before their children
        if n.parent and id(n.parent) in whole and id(n) not in own:
            whole.add(id(n))
    return "\n".join(text for n, links, text in kept if (links * 2 < len(text) if id(n) in own else id(n) in whole))


def _article(best: Node) -> tuple[set[int], set[int]]:
    """(elements kept whole, elements around them of which the text of their own is kept unless it is links)."""
    around, at = [], best
    while at:
        around.append(at)
        at = at.parent
    at = next((n for tag in ("article", "main") for n in reversed(around) if n.tag == tag), best)
    whole, own = {id(at)}, set()
    while at.parent:
        others = [s for s in at.parent.kids if s is not at]
        if any(s.out or s.linked() for s in others):
            whole |= {id(s) for s in others if s.prose and not s.linked()}
            own.add(id(at.parent))
        else:
            whole.add(id(at.parent))
        at = at.parent
    return whole, own


def _extract(batches):
    for b in batches:
        texts = [main_text(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html)."""
    ship_package(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(lean(_extract), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
