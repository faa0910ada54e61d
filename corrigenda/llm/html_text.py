"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corrigenda.llm.common import field_of, map_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe template textarea xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead caption tr ul".split()
)
#: Elements that never hold main text.
NOISE = set("nav footer aside form button select option input dialog menu svg canvas audio video object embed map head title".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status".split())
#: Words of class and id that mark parts around the main text, unless what they mark is the main text by its weight (``_spared``).
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal"
    " overlay newsletter subscribe subscription signup sidebar aside widget widgets related recommended recommendations share sharing social"
    " comment comments disqus respond reply replies discussion breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer"
    " header masthead topbar toolbar login search tags hidden copyright".split()
)
#: Those of them that also stand on parts of an article, where these hold prose.
WEAK_WORDS = set("share sharing social widget widgets tags hidden header masthead login search".split())
#: Characters of a paragraph that is prose, without white space.
PROSE_CHARS = 40
_PROSE = {"p", "blockquote", "pre", "ul", "ol", "dl", "table", "figure"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag closes these open elements, unless one of the stops comes first.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}),
}
_P_CLOSERS = BLOCK - {"body", "html", "legend", "caption", "tbody", "thead", "tfoot", "tr", "li", "dt", "dd"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("attrs", "chars", "density", "holds", "items", "link_chars", "link_tags", "named", "noise", "parent", "prose", "settled", "tag", "tags", "text", "total")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.items: list["Node | str"] = []


#: Elements that an inline end tag does not close.
_SCOPES = ("article", "main", "section", "body", "td")
_P_STOPS = ("button", "table", "td", "th", "div", "article", "section", "main", "body", "blockquote", "li")


class _Open:
    """The open elements, with the depths at which each tag is open, so that no end tag walks them."""

    def __init__(self, root: "Node"):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: "Node") -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        """Depth of the innermost open element among ``tags``; 0 if there is none."""
        return max([d[-1] for t in tags if (d := self.depths.get(t))], default=0)

    def close(self, depth: int) -> None:
        """Closes the element at ``depth`` and all within."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()


def parse(html: str) -> Node:
    """A forgiving tree: void and raw elements, implied end tags, stray end tags ignored. Linear in the page."""
    root = Node("html", None)
    opened, pos = _Open(root), 0
    # behind the last ">" there is no markup to find; an unfinished tag there is dropped
    last = html.rfind(">") + 1
    cut = _UNFINISHED.search(html, last)
    html = html[: cut.start()] if cut else html
    for m in _TOKEN.finditer(html, 0, last):
        if m.start() < pos:
            continue
        if m.start() > pos:
            opened.nodes[-1].items.append(html[pos : m.start()])
        pos = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            at = opened.last((tag,))
            if at and (tag in BLOCK or at > opened.last(_SCOPES) or tag in _SCOPES):
                opened.close(at)
            continue
        if tag == "html" and len(opened.nodes) == 1:
            continue
        if tag in _P_CLOSERS and (at := opened.last(("p",))) > opened.last(_P_STOPS):
            opened.close(at)
        if tag in _CLOSES:
            kinds, stops = _CLOSES[tag]
            if (at := opened.last(kinds)) > opened.last(stops):
                opened.close(at)
        node = Node(tag, opened.nodes[-1], attrs)
        opened.nodes[-1].items.append(node)
        if tag in RAW or tag == "title":
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span")):
            opened.push(node)
    if pos < len(html):
        opened.nodes[-1].items.append(html[pos:])
    return root


def _attrs(n: Node) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(n.attrs)}


def _settled(n: Node, in_article: bool) -> bool:
    """What the markup itself says is no main text: its element, role, or that it is hidden."""
    if n.tag in RAW or n.tag in NOISE:
        return True
    if n.tag == "header":
        return not in_article
    if not n.attrs or n.tag in ("html", "body", "article", "main"):
        return False
    attrs = _attrs(n)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return n.tag not in _HEADS and attrs.get("role", "").lower() in NOISE_ROLES


def _named(n: Node) -> set[str]:
    """Words of its class and id that mark a part around the main text."""
    if not n.attrs or n.tag in ("html", "body", "article", "main") or n.tag in _HEADS:
        return set()
    attrs, out = _attrs(n), set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name))]
        if not words or words[0] in ("has", "no", "with", "without", "article", "entry", "post", "content", "main"):
            words = [w for w in words[1:] if w in ("comments", "comment", "footer", "sidebar", "share", "related", "tags")] if words and words[0] not in ("has", "no", "with", "without") else []
        out |= NOISE_WORDS.intersection(words)
    return out


def _spared(x: Node, body: Node, in_article: bool) -> bool:
    """Whether a part that names mark is main text by what it holds: the article, or most of the text of a page without one; in an article also prose under a weak name."""
    return x.holds or (2 * x.text > body.text and not body.holds) or (in_article and x.prose and x.named <= WEAK_WORDS and 3 * x.link_chars <= x.chars)


def _measure(body: Node) -> list[Node]:
    """Every node's characters, tags, link characters and link tags below, its link-adjusted density
    and the sum of its children's; returns the nodes in page order.

    Only what is no text at all (scripts, styles) does not count. ``noise`` marks what is around the main
    text: by its markup, or by names, unless it is ``_spared``. It is measured like all else, but adds
    nothing to its parent's sum.
    """
    order: list[Node] = []
    inside: list[bool] = []
    stack = [(body, False, False)]
    while stack:
        x, link, art = stack.pop()
        order.append(x)
        art = art or x.tag in ("article", "main")
        inside.append(art)
        link = link or x.tag == "a"
        x.settled = x is not body and _settled(x, art)
        x.named = set() if x is body or x.settled else _named(x)
        x.chars = x.link_chars = x.tags = x.link_tags = x.text = 0
        x.items = [i for i in x.items if isinstance(i, str) or i.tag not in RAW]
        for i in reversed(x.items):
            if isinstance(i, str):
                k = len("".join(i.split()))
                x.chars += k
                x.link_chars += k * link
                x.text += k * (not link)
            else:
                stack.append((i, link, art))
    for x in reversed(order):
        x.holds, x.prose = x.tag in ("article", "main"), False
        for i in x.items:
            if isinstance(i, Node):
                x.chars += i.chars
                x.link_chars += i.link_chars
                x.tags += i.tags + 1
                x.link_tags += i.link_tags + (i.tag == "a")
                if not i.settled:
                    x.text += i.text
                    x.holds = x.holds or i.holds
                    x.prose = x.prose or i.prose
        x.prose = x.prose or (x.tag in ("p", "blockquote", "pre") and x.text >= PROSE_CHARS)
    share = body.link_chars / max(body.chars, 1)
    for x, art in zip(order, inside):
        x.noise = x is not body and (x.parent.noise or x.settled or bool(x.named and not _spared(x, body, art)))
    for x in reversed(order):
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, share)
        x.total = sum(i.density for i in x.items if isinstance(i, Node) and not i.noise)
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, damped where links carry them; ``share`` is that of link characters in the body."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / t * max(0.0, math.log(chars / lc * t / lt)) / base


def _select(body: Node, nodes: list[Node]) -> list[Node]:
    """The subtree with the largest sum of child densities, and what stands beside the path from it
    to the body and is at least as dense as the least dense node on that path.

    Of equal sums the one with more characters wins, then the first in page order.
    """
    best = body
    for x in nodes:
        if not x.noise and (x.total, x.chars) > (best.total, best.chars):
            best = x
    while best is not body and best.tag not in BLOCK:  # an inline element is no subtree of blocks
        best = best.parent
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(x.density for x in path)
    on_path = set(map(id, path))
    out = [best]
    for up in path[1:]:
        for i in up.items:
            if isinstance(i, Node) and id(i) not in on_path and not i.noise and i.chars and 3 * i.link_chars <= i.chars:
                # titles are short, and so may be the neighbours of the subtree's own blocks
                if i.density >= least or i.tag in _HEADS or (up is path[1] and i.tag in _PROSE):
                    out.append(i)
    return out


def _blocks(n: Node, keep: set[int] | None) -> list[str]:
    """Texts of the blocks below ``n``, in page order; with ``keep``, only inside those nodes."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    stack: list[tuple[Node | str | None, bool]] = [(n, keep is None)]
    while stack:
        x, on = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if on:
                now.append(x)
        else:
            if x.noise:
                continue
            on = on or id(x) in keep  # type: ignore[operator]
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append((None, on))
            elif x.tag in ("br", "td", "th", "img"):
                now.append(" ")
            stack += [(i, on) for i in reversed(x.items)]
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one a line; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    body = next((i for i in root.items if isinstance(i, Node) and i.tag == "body"), root)
    chosen = _select(body, _measure(body))
    return "\n".join(_blocks(body, set(map(id, chosen))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row, in one pass without a shuffle.

    Null html is empty and gives an empty text; null or repeated ids and urls keep their rows; an
    empty table stays empty; pages are read whole, in time linear in their length. Text that cannot
    be parsed as markup is the text of the body.
    """
    schema = T.StructType([field_of(pages, id_col), field_of(pages, url_col), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(ids, urls, pages_):
        texts = [main_text(h.as_py()) for h in pages_]
        yield {id_col: ids, url_col: urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages, [id_col, url_col, html_col], schema, run)
