"""Operator 1: main text by composite text density.

A page becomes a tree. Elements whose tag, role or hidden state says that they never are article text
(menus, headers, footers, sidebars, forms, scripts, styles) go first. Each other node has a density:
its characters outside links, per tag that is no link, times the share of its text outside links; a
node's density sum is its own characters and the densities of its children. The node with the largest
density sum is selected; the least density on the path from it to the body is the threshold. From the
body down, every node that reaches the threshold gives the subtree with the largest sum in it, and is
looked into; a node that doesn't is left. Paragraphs, headings, lists, tables, quotes and loose text
beside one of these subtrees belong to it, and so do blocks between two of them.

Words of a class or id (adverts, sharing, comments ...), a heading that announces comments, and text
that is nearly all links are a prior: they lower a node's density to PRIOR of it and keep it out of the
counts of what holds it. Nothing is removed for that alone: beside or in a selected subtree such a block
goes if its density is below that of the selected node or the mean of its children, and it is selected like any other where the
page's text is in it.

The published density has a logarithm whose base depends on the page's links and tends to 1 where it
has few, so that any short line there is denser than an article; the plain ratio doesn't have that.

Defined results: null or empty html, or a page without text, gives the empty text; a text of any length
is extracted whole; of equal density sums the last node in page order is selected, so the inmost; unclosed and
stray tags are repaired the way browsers do for paragraphs, list items and table cells; character
references are decoded; white space (as Unicode has it) inside a block becomes one space, blocks are
trimmed and joined by one space, empty ones dropped; one row per row, repeated rows too; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the first kind ends an open one of the second.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("thead", "tbody")}
#: How far up an end is looked for.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
ENDS_P = BLOCK - frozenset("br body html li dt dd td th tr tbody thead tfoot caption option optgroup button legend summary".split()) | {"li", "dt", "dd"}

#: What a head may hold; any other tag, or text, ends an open head and opens the body.
HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button input select textarea iframe object embed svg canvas audio video dialog menu noembed noframes xmp title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
#: Words of a class or id that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination sidebar sidebars aside rail widget widgets "
    "footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus discussion replies reply respond share sharing social related recommended recommendations teaser teasers outbrain taboola "
    "copyright legal disclaimer skip form search".split()
)
#: Those that do inside an article too, where sections may be named for what they are about.
NOISE_INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist disqus respond "
    "share sharing newsletter subscribe signup login outbrain taboola cookie cookies consent gdpr popup form search".split()
)
SPLIT = re.compile(r"[^A-Za-z0-9]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: What belongs to a selected subtree beside it.
BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINKS = 0.6  # of its characters, from which on a block without a paragraph is a list of links
PRIOR = 0.1  # of its density that a block keeps for which its words or links are a reason
#: How pages in the languages of the corpus announce what readers wrote.
REMARKS = re.compile(r"\W*(?:\d+\W*)?(?:(?:reader|readers|user|visitor|leave an?|post an?|your)\W+)?(?:comments?|remarks?|replies|responses|reply|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas)\W*(?:\d+\W*)?", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "doubted", "marks", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", in_article: bool = False):
        self.tag, self.parent, self.parts, self.marks = tag, parent, [], attributes if in_article else ""
        self.noise, self.doubted = _noise(tag, attributes, in_article)
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _noise(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element never is article text, and whether its words are a reason to doubt that it is."""
    if tag in ("html", "body"):
        return False, False
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, False
    if not attributes:
        return False, False
    values: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), "".join(value))
    classes, own = values.get("class", ""), values.get("id", "")
    if values.get("role", "").strip().lower() in ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True, False
    if "hidden" in classes.lower().split():
        return True, False
    if tag in ("article", "main"):
        return False, "comment" in classes.lower().split()
    if in_article:  # an id is often the words of a heading
        return False, not (tag[0] == "h" and re.search("header|title", classes, re.I)) and bool(_words(classes) & NOISE_INSIDE) or own.lower() in NOISE_INSIDE and tag not in HEADINGS
    return False, _marked(classes, own)


def _words(value: str) -> set[str]:
    """The words of a class or id, in lower case: 'sideBar' has side, bar and sidebar."""
    parts = SPLIT.split(value)
    return {x.lower() for part in parts for x in (part, *HUMP.split(part)) if x}


def _marked(classes: str, own: str) -> bool:
    return bool((_words(classes) | _words(own)) & NOISE)


def parse(page: str) -> Node:
    root = Node("#root", None)
    at, pos, end = root, len(page) - len(page.lstrip("\ufeff")), len(page)
    articles = 0
    top = {"#root": root}  # and html, head and body, of which there is one each

    def content(at: Node) -> Node:
        """Where text and tags that a head can't hold go: the body, opened if at is outside of it."""
        if at.tag not in ("#root", "html", "head"):
            return at
        if "body" not in top:
            held = top.get("html", root)
            top["body"] = Node("body", held)
            held.parts.append(top["body"])
        return top["body"]

    while pos < end:
        m = TOKEN.search(page, pos)
        start = m.start() if m else end
        if start > pos:
            if not page[pos:start].isspace():
                at = content(at)
            at.parts.append(page[pos:start])
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                at = content(at)
                at.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):  # what follows them goes where it would have gone before
                continue
            up = at
            while up.parent is not None and up.tag != tag:
                if up.tag in ("article", "td", "table") and tag not in BLOCK:
                    up = root  # an inline end doesn't reach out of these
                    break
                up = up.parent
            if up.parent is not None:
                stop = up.parent
                while at is not stop:
                    articles -= at.tag in ("article", "main")
                    at = at.parent
            elif tag == "p":
                at.parts.append(Node("br", at))
            continue
        if tag in ("html", "head", "body"):
            if tag not in top and "body" not in top and (tag == "body" or at.tag in ("#root", "html")):
                held = top.get("html", root)
                at = top[tag] = Node(tag, held, m[3])
                held.parts.append(at)
            continue
        if tag not in HEAD:
            at = content(at)
        if tag in ENDS_P:
            up = at
            while up.parent is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in CLOSES:
            up = at
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in SCOPE[tag]:
                up = up.parent
            if up.tag in CLOSES[tag]:
                at = up.parent
                if tag == "tr" and at.tag == "tr":
                    at = at.parent
        node = Node(tag, at, m[3], articles > 0)
        at.parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, pos)
            if tag == "title" or not close:
                node.parts.append(page[pos : close.start() if close else end])
            pos = close.end() if close else end
            continue
        articles += tag in ("article", "main")
        at = node
    return root


def _related(attributes: str) -> bool:
    """Of a list of links inside an article: whether it is marked as no part of it, unlike references."""
    values = {name.lower(): "".join(value) for name, *value in reversed(ATTRIBUTE.findall(attributes))} if attributes else {}
    return _marked(values.get("class", ""), values.get("id", ""))


def _announced(node: Node) -> None:
    """Doubts what follows a heading that announces comments, up to the next heading, or the block that it opens."""
    on, first = False, True
    for x in node.parts:
        if isinstance(x, str) or x.noise:
            first = first and not (isinstance(x, str) and x.strip())
            continue
        if x.tag in HEADINGS or first and x.tag in ("b", "strong", "p", "div", "span", "legend"):
            words = "".join(y for y in _text(x, 60))
            if on := bool(words.strip()) and len(words) <= 60 and REMARKS.fullmatch(html.unescape(words)) is not None:
                if first and node.tag not in ("body", "html", "article", "main", "#root"):
                    node.doubted = True
        first = False
        x.doubted = x.doubted or on


def _text(node: Node, most: int) -> Iterator[str]:
    """The text of a node, up to the piece that makes it longer than most."""
    stack: list = [node]
    while stack and most >= 0:
        x = stack.pop()
        if isinstance(x, str):
            most -= len(x)
            yield x
        elif not x.noise:
            stack += reversed(x.parts)


def measure(root: Node) -> None:
    """chars, link_chars, tags, link_tags of every node, children first; noise counts as nothing, and what
    is doubted counts for itself alone."""
    order, stack = [], [(root, False, False)]
    links, articles = {}, set()
    while stack:
        node, inside, article = stack.pop()
        order.append(node)
        _announced(node)
        links[node] = inside = inside or node.tag == "a"
        if article := article or node.tag in ("article", "main"):
            articles.add(node)
        stack += [(x, inside, article) for x in node.parts if isinstance(x, Node) and not x.noise]
    for node in reversed(order):
        chars = link_chars = tags = link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                n = len("".join(x.split()))
                chars += n
                link_chars += n * links[node]
            elif not (x.noise or x.doubted):
                chars, link_chars, tags, link_tags = chars + x.chars, link_chars + x.link_chars, tags + x.tags + (x.tag not in VOID), link_tags + x.link_tags + (x.tag == "a")
        node.chars, node.link_chars, node.tags, node.link_tags = chars, link_chars, tags, link_tags
        if node.tag in BLOCK and node.tag not in ("p", "body", "html", "article", "main", "br") and chars and link_chars >= LINKS * chars and link_tags > 1 and (node not in articles or _related(node.marks)):
            node.doubted = True


def density(node: Node) -> float:
    """Characters outside links per tag that is no link, times the share of text outside links."""
    plain = node.chars - node.link_chars
    return (PRIOR if node.doubted else 1.0) * plain / (node.tags - node.link_tags + 1) * plain / node.chars if node.chars else 0.0


def densities(root: Node) -> list[Node]:
    """Sets density and total, returns the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.noise]
    for node in reversed(order):
        node.density = density(node)
        own = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        node.total = own * (PRIOR if node.doubted else 1.0) + sum(x.density for x in node.parts if isinstance(x, Node) and not x.noise)
    return order


def select(root: Node) -> Node | None:
    """The body, with all that isn't the page's text marked as noise; None if there is no text."""
    body = next((x for x in _walk(root) if x.tag == "body"), root)
    measure(root)
    nodes = [x for x in densities(root) if x is body or x.total and x.tag in BLOCK and x.tag != "html"]
    best = max(reversed(nodes), key=lambda x: x.total)
    if not best.total:
        return body if any(x.strip() for x in _text(body, 1 << 60)) else None
    path, up = [best], best
    while up is not body and up.parent is not None:
        up = up.parent
        path.append(up)
    least = min((x.density for x in path if x.density), default=0.0)
    held = sum(isinstance(x, str) and not x.isspace() or isinstance(x, Node) and x.density > 0 and not x.noise for x in best.parts)
    _keep(body, nodes, set(path), least, max(least, best.density, best.total / max(1, held)))
    return body


def _keep(body: Node, nodes: list[Node], path: set[Node], least: float, doubted: float) -> None:
    """Marks as noise what isn't in or beside a selected subtree, and what is doubted in one. nodes: in page order."""
    most: dict[Node, Node] = {}
    for x in reversed(nodes):  # the largest sum in each subtree; inline nodes hand it on
        most[x] = max(most.get(x, x), x, key=lambda y: y.total)
        up = x
        while up is not body and (up := up.parent) is not body and up.tag not in BLOCK:
            pass
        most[up] = max(most.get(up, most[x]), most[x], key=lambda y: y.total)
    kept, on, stack = set(), set(), [body]
    while stack:
        x = stack.pop()
        if x in kept:
            continue
        if x.tag in BLOCK or x is body:
            if x not in path and x.density < (doubted if x.doubted else least):
                continue
            top = most.get(x, x)
            kept.add(top)
            while top is not body:
                top = top.parent
                on.add(top)
            if x in kept:
                continue
        stack += [y for y in x.parts if isinstance(y, Node) and not y.noise]
    for x in on - kept:
        parts = [y for y in x.parts if isinstance(y, Node) and not y.noise]
        held = [k for k, y in enumerate(parts) if y in kept or y in on]
        for k, y in enumerate(parts):
            if y in kept or y in on:
                continue
            if y.tag not in BLOCK:
                y.noise = y.chars <= y.link_chars
            elif y.doubted or not any(p in kept for p in parts):
                y.noise = True
            else:
                y.noise = y.tag not in BESIDE and not held[0] < k < held[-1]
    stack = [body]
    while stack:
        x = stack.pop()
        for y in x.parts:
            if isinstance(y, Node) and not y.noise:
                if y.doubted and y.density < doubted and y not in path and y not in on:
                    y.noise = True
                else:
                    stack.append(y)


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.noise:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.parts)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    top = select(parse(page))
    return " ".join(blocks(top)) if top is not None else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=names)

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
