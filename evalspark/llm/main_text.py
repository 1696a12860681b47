"""Main text of web pages by tree scoring.

A page becomes a tree of elements (unclosed paragraphs and list items end where the next
one starts). Every paragraph gives points for its length and its commas to its parent,
half of them to the grandparent, a third beyond; link text counts against the points.
Menus, page headers, footers, asides, forms, notices, adverts, comments, scripts and
styles are cut out before. An element named so by its class or id alone stays if it frames
the page's text, and names count for nothing on a page that they would empty. The best
container is kept with the whole article or main around it but its link-heavy blocks;
elsewhere with siblings of few links, all of them where links are few among them, and those
whose points come near it otherwise. Blocks are joined in page order.

Cases: a null or empty page, and one without any paragraph, gives an empty text. Broken
markup never fails: an unclosed comment or script ends with the page, a stray end tag is
ignored, a ``<`` that opens no tag is text. Work is linear in the page. Rows may repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text.
CUT = frozenset("head nav footer aside form script style noscript template svg math iframe object canvas audio video button select "
                "textarea input label dialog menu title xmp noembed noframes figure-menu".split())
BLOCKS = frozenset("html body main article section div p pre blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption "
                   "h1 h2 h3 h4 h5 h6 header footer nav aside form fieldset figure figcaption address hr details summary center hgroup".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 figcaption".split())
CONTAINERS = frozenset("#root body main article section div td blockquote table tbody ul ol dl figure details center html".split())
#: An opening tag ends these open elements, up to the listed borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
        "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set())}
CLOSES_PARAGRAPH = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CUT_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion sidebar side menu nav navbar navigation footer "
                      "masthead comment comments disqus respond cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe "
                      "signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager toolbar widget skip".split())

#: Names of what readers wrote; it may hold more text than the page's own.
REPLY_NAMES = frozenset("comment comments disqus respond".split())

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")


#: Below this a container holds no paragraph of 25 characters or a comma.
LEAST_SCORE = 1.25


class Node:
    __slots__ = ("tag", "parent", "cut", "named", "children", "points", "held", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, cut: bool) -> None:
        self.tag, self.parent, self.cut = tag, parent, cut
        self.named = False
        self.children: list[Node | str] = []
        self.points = self.held = 0.0
        self.chars = self.link_chars = 0


def _is_cut(tag: str, attributes: str, parent: Node, names: bool) -> tuple[bool, bool]:
    """Whether an element is cut with all below it, and whether its names say that it may be."""
    if parent.cut or tag in CUT:
        return True, False
    node: Node | None = parent
    if tag == "header":  # a page's header, not an article's
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
        if node is None:
            return True, False
    named = False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "style":
            if _HIDDEN.search(value):
                return True, False
        elif name == "aria-hidden":
            if value.lower() == "true":
                return True, False
        elif name == "role":
            if value.lower() in CUT_ROLES:
                return True, False
        elif names:
            found = CUT_NAMES.intersection(_NAME.findall(value.lower()))
            if not REPLY_NAMES.isdisjoint(found):
                return True, False
            named = named or bool(found)
    return False, named


def _tag_end(html: str, at: int, last_quotes: dict[str, int]) -> int:
    """Place after the ``>`` that ends a tag; quoted values may hold one, and may be of any length."""
    begin = start = at
    while True:
        end = html.find(">", at)
        if end < 0:
            return len(html)
        inner = html[start:end]
        if '"' not in inner and "'" not in inner:
            return end + 1
        rest = _QUOTED.sub("", inner)
        quote = re.search("[\"']", rest)
        if quote is None or not re.search(r"=\s*$", rest[:quote.start()]):
            return end + 1
        if end > last_quotes[quote[0]]:  # no closing quote: the first bracket ends the tag
            return html.find(">", begin) + 1
        at = start = html.find(quote[0], end) + 1


def parse(html: str, names: bool = True) -> Node:
    """The tree of a page; ``names`` tells whether class and id names count."""
    root = Node("#root", None, False)
    node, at, n = root, 0, len(html)
    opened: Counter[str] = Counter()
    last_quotes = {quote: html.rfind(quote) for quote in "\"'"}

    def back_to(target: Node) -> Node:
        up = node
        while up is not target:
            opened[up.tag] -= 1
            up = up.parent
        return target
    lower: str | None = None
    while at < n:
        found = _TAG.search(html, at)
        if found is None:
            node.children.append(html[at:])
            break
        if found.start() > at:
            node.children.append(html[at:found.start()])
        if found[1]:
            end = html.find("-->", found.end())
            at = n if end < 0 else end + 3
            continue
        if found[2]:
            end = html.find(">", found.end())
            at = n if end < 0 else end + 1
            continue
        tag, at = found[4].lower(), _tag_end(html, found.end(), last_quotes)
        if found[3]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = back_to(up.parent)
            continue
        if tag in CLOSES_PARAGRAPH and opened["p"] > 0:
            up = node
            while up.tag != "p" and (up.tag not in BLOCKS):
                up = up.parent
            if up.tag == "p":
                node = back_to(up.parent)
        if tag in ENDS:
            ended, borders = ENDS[tag]
            if any(opened[name] > 0 for name in ended):
                up, last = node, None
                while up is not root and up.tag not in borders:
                    last = up if up.tag in ended else last
                    up = up.parent
                if last is not None:
                    node = back_to(last.parent)
        attributes = html[found.end():at - 1]
        cut, named = _is_cut(tag, attributes, node, names)
        made = Node(tag, node, cut)
        made.named = named
        node.children.append(made)
        if tag in RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == n else html.find(f"</{tag}", at)
            stop = n if end < 0 else end
            if stop > at:
                made.children.append(html[at:stop])
            at = n if end < 0 else _tag_end(html, end, last_quotes)
        elif tag not in VOID and not attributes.endswith("/"):
            node = made
            opened[tag] += 1
    return root


def _measure(root: Node) -> list[Node]:
    """Characters and link characters of every node, points of containers; nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.cut:
            continue
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    commas: dict[int, int] = {}
    for node in reversed(order):
        texts = [c for c in node.children if isinstance(c, str)]
        node.chars += sum(len(t.strip()) for t in texts)
        count = commas.pop(id(node), 0) + sum(t.count(",") + t.count("、") + t.count("，") for t in texts)
        if node.tag == "a":
            node.link_chars = node.chars
        loose = node.tag in CONTAINERS and any(t.strip() for t in texts)
        if (node.tag in PARAGRAPHS or loose) and node.chars:
            points = (1 + count + min(node.chars / 100, 3)) * (1 - node.link_chars / node.chars)
            node.held += points
            up, share = (node if loose and node.tag not in PARAGRAPHS else node.parent), 1.0
            while up is not None and share > 0.1:
                up.points += points * share
                share = {1.0: 0.5, 0.5: 1 / 3}.get(share, share / 2)
                up = up.parent
        if node.parent is not None:
            node.parent.held += node.held
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
            if node.tag not in PARAGRAPHS:
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + count
    return order


def _cut_names(order: list[Node]) -> None:
    """Cut the named nodes that are no frame of the page's text, and forget what was measured.

    A frame holds more than half of the page's points, or its ``<main>``, or the ``<article>`` with the most
    points if that is a fifth of all.
    """
    total = order[0].held
    frames = {id(node) for node in order if node.named and node.held > total / 2}
    top = max((node for node in order if node.tag == "article"), key=lambda node: node.held, default=None)
    inside = [node for node in order if node.tag == "main" and node.held > 0]
    for up in inside + ([top] if top is not None and top.held >= total / 5 else []):
        while up is not None and id(up) not in frames:
            frames.add(id(up))
            up = up.parent
    for node in order:
        if node.named and id(node) not in frames:
            node.cut = True
        node.points, node.held, node.chars, node.link_chars = 0.0, 0.0, 0, 0


def _score(node: Node) -> float:
    bonus = 1.5 if node.tag in ("article", "main") else 1.0
    return bonus * node.points * (1 - node.link_chars / node.chars) if node.chars else 0.0


def _blocks(node: Node, out: list[str]) -> None:
    pending: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", unescape("".join(pending))).strip()
        pending.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            pending.append(item)
        elif leaving:
            flush()
        elif item.tag == "br":
            pending.append(" ")
        elif not item.cut:
            if item.tag in BLOCKS:
                flush()
                stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    flush()


def _links_only(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table") and node.link_chars > 0.8 * node.chars > 0


def _best(root: Node) -> tuple[list[Node], Node | None]:
    """Nodes in page order and the best container, after cuts by name."""
    order = _measure(root)
    if any(node.named for node in order):
        _cut_names(order)
        order = _measure(root)
    best = max((n for n in order if n.tag in CONTAINERS), key=_score, default=None)
    return order, best if best is not None and _score(best) > 0 else None


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    order, best = _best(parse(html))
    if best is None or _score(best) < LEAST_SCORE:  # names may have cut all there is
        whole = _best(parse(html, names=False))
        if best is None or whole[1] is not None and _score(whole[1]) > _score(best):
            order, best = whole
    if best is None:
        return ""
    kept, limit, top = [best], 0.2 * _score(best), best
    up = best.parent
    while up is not None:  # the outermost article or main around it
        top = up if up.tag in ("article", "main") else top
        up = up.parent
    if top is not best:
        node = best
        while node is not top:
            for c in node.parent.children:
                if isinstance(c, Node) and c is not node and c.tag in BLOCKS and c.link_chars >= 0.3 * c.chars > 0:
                    c.cut = True
            node = node.parent
        kept = [top]
    elif best.parent is not None and best.tag not in ("body", "html"):
        beside = [c for c in best.parent.children if isinstance(c, Node) and not c.cut and c.tag in CONTAINERS | PARAGRAPHS]
        others = [c for c in beside if c is not best]
        calm = sum(c.link_chars for c in others) < 0.3 * sum(c.chars for c in others)
        kept = [c for c in beside if c is best or (
            c.chars and c.link_chars < 0.3 * c.chars and (calm or c.tag in PARAGRAPHS or _score(c) >= limit))]
    for node in order:
        if node is not best and _links_only(node):
            node.cut = True
    out: list[str] = []
    for node in kept:
        _blocks(node, out)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text and its length per page; one pass, no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
