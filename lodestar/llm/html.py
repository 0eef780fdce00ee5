"""A tolerant HTML tokenizer and tree, and the text of its containers.

All steps take time in proportion to the page, whatever its markup: a tag that the page's end cuts off
is found once, an element knows the nearest ones around it that a rule asks for, end tags without an
open element are not looked for, and what a rule wants to know of all that an element holds is summed
up from below, once for all elements.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li td".split()) | CONTAINERS
#: Never part of an article.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu title head audio video map noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that mark what surrounds an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar header masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search share sharing social related recommended comment comments commentlist disqus respond reply replies toolbar pagination pager widget".split()
)
#: What can be such a surrounding part; a class or id says nothing of the kind about headings, paragraphs, cells and inline elements.
MARKABLE = frozenset("div section article ul ol dl table center figure details address fieldset ins".split())
#: Classes that say it about any element but headings and cells.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsored share sharing breadcrumb breadcrumbs pagination".split())
#: Words beside a mark that tell no subject ("comment-list", "related-posts"), unlike "related-work" or "social-history".
PLAIN = frozenset("list lists area box boxes wrap wrapper container holder block inner outer left right top bottom main content primary secondary site page global link links button buttons icon icons bar form field item items post posts article articles story stories news thread panel unit slot row col column section region group by us media widgets text".split())
#: First words of a class that tell what an element has, not what it is.
ABOUT = frozenset("has have with without no not non is show hide".split())
_SECTIONS = {"thead", "tbody", "tfoot", "tr", "td", "th"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": _SECTIONS, "tbody": _SECTIONS, "tfoot": _SECTIONS}
#: The parts of tables and of lists, which missing end tags are found by; a part is looked for up to its table or list.
_ROWS = _SECTIONS | {"table"}
_LISTS = {"ul", "ol", "menu", "dir", "dl", "select", "table"}
_ITEMS = _LISTS | {"li", "dt", "dd", "option"}
SCOPE = {"td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}} | dict.fromkeys(("li", "dt", "dd", "option"), _LISTS)
#: What an open paragraph is looked for up to.
_NEAR = frozenset("p button td th table li div article section main body".split())
#: The fourth group of a tag is empty where the page's end cuts it off. Quotes count after an equals sign only.
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:>|\Z|[^a-zA-Z>][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"(?<![\d_-])[\d_-]*\d[\w-]*|>")
_ENDLESS = re.compile(r"&#[0-9]{20,};?")
#: Marks that text of an article may have in the names of its boxes ("widget-text").
WEAK = frozenset("widget social related search share sharing header notice notices promotion banner overlay toolbar respond recommended".split())


def decoded(text: str) -> str:
    """With its character references decoded."""
    if "&" not in text:
        return text
    return unescape(_ENDLESS.sub("\ufffd", text))


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "mark", "near", "row", "item", "box", "article", "root", "score", "heading", "holds")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children, self.mark = tag, attributes, parent, [], None
        if parent is None:
            self.near = self.row = self.item = self.root = self
            self.box = self.article = None
            self.score = self.heading = self.holds = None
            return
        # the nearest of some kinds among the element and those around it
        self.near = self if tag in _NEAR else parent.near
        self.row = self if tag in _ROWS else parent.row
        self.item = self if tag in _ITEMS else parent.item
        self.box = self if tag in CONTAINERS else parent.box
        self.article = self if tag == "article" else parent.article
        self.root = parent.root

    def step(self) -> str:
        """The tag with its classes (its id if it has none), numbers generalised away."""
        words = self.attributes.get("class", "").split() or self.attributes.get("id", "").split()
        marks = sorted({x for w in words if (x := _NUMBER.sub("", w.lower()).strip("-_"))})
        return ".".join([self.tag, *marks])

    def path(self) -> str:
        steps, node = [], self
        while node is not None and node.tag:
            steps.append(node.step())
            node = node.parent
        return ">".join(reversed(steps))


def marked(node: Node) -> bool:
    """Whether the element is a menu, header, footer, sidebar, notice, advert, form or reader comment."""
    if node.mark is None:
        node.mark = node.tag in DROPPED or bool(node.attributes) and _named(node)
    return node.mark


def _named(node: Node) -> bool:
    a = node.attributes
    if node.tag in ("html", "body", "main"):
        return False
    words = f"{a.get('class', '')} {a.get('id', '')}".split()
    if node.tag == "article":  # its classes tell what it has ("has-comments"), unless it is one whole word
        return any(w.lower() in ("comment", "comment-body", "ad", "advert", "promo", "related") for w in words)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag not in MARKABLE:
        return node.tag not in HEADINGS and node.tag not in ("td", "th") and not ADVERTS.isdisjoint(a.get("class", "").lower().split())
    for word in words:
        parts = [x.lower() for x in _WORD.findall(word)]
        if not ABOUT.isdisjoint(parts[:1]):  # "with-sidebar", "no-header"
            continue
        pairs = [x + y for x, y in zip(parts, parts[1:])]  # noqa: B905  "SideBar", "nav-bar"
        if MARKS.isdisjoint([*parts, *pairs]):
            continue
        other = [x for i, x in enumerate(parts) if x not in MARKS and x not in PLAIN and not any(0 <= j < len(pairs) and pairs[j] in MARKS for j in (i - 1, i))]
        if other and _has_paragraphs(node, parts):
            continue
        if node.article is not None and not {"text", "body", "content"}.isdisjoint(parts) and WEAK >= MARKS.intersection([*parts, *pairs]) and _has_paragraphs(node, parts, 1.0):
            continue
        if not _holds_article(node):
            return True
    return False


def _has_paragraphs(node: Node, name: list[str], least: float = 3.0) -> bool:
    """Whether an element has text like an article's: a paragraph if its heading is its name, two or three otherwise."""
    if node.root.score is None:
        _sum_up(node.root)
    heading = node.heading
    if isinstance(heading, Node):
        heading.heading = heading.heading if isinstance(heading.heading, frozenset) else frozenset(x.lower() for x in _WORD.findall("".join(_strings(heading))))
        heading = heading.heading
    return node.score >= (1 if heading and heading >= set(name) else least)


def _sum_up(root: Node) -> None:
    """Set the score of the paragraphs and the first heading of all elements; a heading's own one is itself, then the words of it."""
    every = _every(root)
    for node in reversed(every):
        node.score, node.heading = 0.0, None
        for child in reversed(node.children):
            if isinstance(child, Node) and child.tag not in DROPPED:
                node.score += child.score
                if child.heading is not None:
                    node.heading = child if child.tag in HEADINGS else child.heading
        if node.tag in HEADINGS:
            node.heading = node
        elif node.tag in PARAGRAPHS:
            text, links = _own_text(node, True)
            if len(text) >= 25 and links <= len(text) / 2:
                node.score += _worth(node, text, links)


def _every(root: Node) -> list[Node]:
    """All elements, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _strings(node: Node):
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        else:
            stack.extend(reversed(item.children))


def _holds_article(node: Node) -> bool:
    if node.root.holds is None:
        for x in reversed(_every(node.root)):
            x.holds = any(c.tag == "main" or c.tag == "article" and not marked(c) or c.holds for c in x.children if isinstance(c, Node))
    return node.holds


def parse(html: str) -> Node:
    """The tree of a page. Missing end tags close as browsers close them; what does not parse is text."""
    root = node = Node("", {}, None)
    open_: dict[str, int] = {}  # how many elements of a name hold the present place
    at = 0

    def leave(element: Node) -> Node:
        """Close an element and all that is open in it."""
        up = node
        while up is not element.parent:
            open_[up.tag] -= 1
            up = up.parent
        return up

    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html):
                node.children.append(decoded(html[at:]))
            return root
        if m.start() > at:
            node.children.append(decoded(html[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            continue
        if tag in BLOCK:  # a block ends an open paragraph, and list or table parts their like
            if node.near.tag == "p":
                node = leave(node.near)
            if tag in CLOSES:
                stop, rows = SCOPE[tag], tag in _ROWS
                up = node.row if rows else node.item
                while up.tag and up.tag not in stop:
                    if up.tag in CLOSES[tag]:
                        node = leave(up)
                    up = up.parent.row if rows else up.parent.item
        attributes = {}
        if m[3] and not m[3].isspace():
            for x in _ATTRIBUTE.finditer(m[3]):
                attributes.setdefault(x[1].lower(), decoded(x[2] or x[3] or x[4] or ""))
        new = Node(tag, attributes, node)
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            if tag not in DROPPED:
                new.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            node = new
            open_[tag] = open_.get(tag, 0) + 1


def elements(root: Node):
    """All elements that are not within a marked one, in page order; without recursion, however deep the page is."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag:
            yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not marked(c))


def blocks(container: Node) -> list[str]:
    """The blocks of text of a container without marked elements: white space is one space, empty blocks go."""
    out: list[str] = []
    pieces: list[str] = []

    def close():
        if pieces:
            if text := _SPACE.sub(" ", "".join(pieces)).strip():
                out.append(text)
            pieces.clear()

    stack: list = [iter(container.children)]
    tags = [container.tag]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                pieces.append(child)
            elif child.tag == "br":
                pieces.append(" ")
            elif not marked(child):
                if child.tag in BLOCK:
                    close()
                stack.append(iter(child.children))
                tags.append(child.tag)
                break
        else:
            stack.pop()
            if tags.pop() in BLOCK:
                close()
    close()
    return out


def scores(root: Node) -> list[tuple[float, Node]]:
    """(score, container) for each container that holds text: own paragraphs count fully, those one level down by half.

    A paragraph counts by its length and commas, less the share that is links.
    """
    found: dict[int, list] = {}
    for node in elements(root):
        if node.tag in CONTAINERS:
            found[id(node)] = [{"article": 30.0, "main": 15.0, "body": -10.0}.get(node.tag, 0.0), node, False]
    for node in elements(root):
        if node.tag in PARAGRAPHS:
            text, links = _own_text(node)
            if not text:
                continue
            worth = _worth(node, text, links)
            up, share = node.box, 1.0
            while up is not None and share > 0.2:
                found[id(up)][0] += worth * share
                found[id(up)][2] = True
                share /= 2
                up = up.parent.box
    return [(score, node) for score, node, used in found.values() if used]


def _worth(node: Node, text: str, links: int) -> float:
    if not text:
        return 0.0
    size = len(text)
    return (1 + text.count(",") + min(size / 100, 6)) * (1 - links / size) if size >= 25 or node.tag[0] == "h" else 0.3 * (1 - links / size)


def _own_text(node: Node, unmarked: bool = False) -> tuple[str, int]:
    """The text of an element without that of blocks within it, and how much of it is links. unmarked: marks are not looked at."""
    pieces, links, stack = [], 0, [(c, node.tag == "a") for c in reversed(node.children)]
    while stack:
        child, linked = stack.pop()
        if isinstance(child, str):
            pieces.append(child)
            links += len(child) if linked else 0
        elif child.tag not in BLOCK and (child.tag not in DROPPED if unmarked else not marked(child)):
            stack.extend((c, linked or child.tag == "a") for c in reversed(child.children))
    text = "".join(pieces)
    kept = text.strip()
    return kept, min(links, len(kept))


def best(root: Node) -> tuple[float, Node] | None:
    """The container with the highest score, the first of equal ones; none if no container has as much as a paragraph."""
    found = max(scores(root), key=lambda x: x[0], default=None)
    return found if found and found[0] >= 1 else None


def at_path(root: Node, path: str) -> list[Node]:
    """All containers at a generalised path, in page order; only what agrees with the path so far is looked at.

    Where some of them are mostly links and others are not, those of links are left out.
    """
    steps, found = path.split(">"), []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if depth == len(steps):
            found.append(node)
            continue
        stack.extend((c, depth + 1) for c in reversed(node.children) if isinstance(c, Node) and c.step() == steps[depth] and not marked(c))
    if len(found) > 1:
        sizes = [_size([x]) for x in found]
        return [x for x, (size, links) in zip(found, sizes, strict=True) if links <= size / 2] or found
    return found


def article(nodes: list[Node]) -> list[str]:
    """The blocks of the whole article that some containers, none within another, are parts of.

    A container within an <article> stands for all of the outermost one. What is beside a container,
    and beside what holds it, up to <main> or <body>, is added where it reads as text: headings before
    text, paragraphs, lists and tables, and containers with a fifth of the score of those given (other
    sections beside a section: with a paragraph's score), all with at most half of their text in links.
    Other articles are not added, and nothing beside an <article> that has a heading of its own.
    """
    starts: dict[int, Node] = {}
    on: set[int] = set()  # the starts and all that hold them
    beside: set[int] = set()  # those that other text is taken from
    seen: set[tuple[int, bool]] = set()
    titled = False
    for node in nodes:
        top, up = node, node.parent.article if node.parent is not None else None
        while up is not None and id(up) not in starts:
            top, up = up, up.parent.article
        top = up or top
        starts[id(top)] = top
    for start in starts.values():
        heads = {x.tag for x in elements(start)} & HEADINGS
        titled |= "h1" in heads
        open_, up = start.tag not in ("main", "body") and not (start.tag == "article" and heads), start.parent
        on.add(id(start))
        while up is not None and (id(up), open_) not in seen:
            seen.add((id(up), open_))
            on.add(id(up))
            if open_ and up.tag in (*CONTAINERS, "center", "form"):
                beside.add(id(up))
            open_ = open_ and up.tag not in ("main", "body")
            up = up.parent
    least = max(10.0, 0.2 * sum(_score(x) for x in starts.values())) if beside else 0.0
    root = next(iter(starts.values()), None)
    while root is not None and root.parent is not None:
        root = root.parent
    out: list[str] = []
    stack: list = [root] if root is not None else []
    while stack:
        item = stack.pop()
        if isinstance(item, list):  # text and inline elements
            holder = Node("div", {}, None)
            holder.children = item
            out += blocks(holder)
        elif id(item) not in on or id(item) in starts:
            out += blocks(item)
        elif id(item) not in beside:
            stack.extend(c for c in reversed(item.children) if isinstance(c, Node) and id(c) in on)
        else:
            before_text = False
            parts = _parts(item, on)
            sections = any(isinstance(x, Node) and x.tag == "section" and id(x) in on for x in parts)
            for part in reversed(parts):  # so that the stack gives them in page order
                if isinstance(part, Node) and id(part) in on:
                    before_text = True
                elif isinstance(part, Node) and part.tag in HEADINGS:
                    size, links = _size([part])
                    if not before_text or not size or links > size / 2 or part.tag == "h1" and titled:
                        continue
                else:
                    size, links = _size([part] if isinstance(part, Node) else part)
                    if not size:
                        continue
                    before_text = links <= size / 2 and _reads(part, size, item.tag == "body", 1.0 if sections else least, least)
                    if not before_text:
                        continue
                stack.append(part)
    return out


def _parts(node: Node, on: set[int]) -> list:
    """The unmarked blocks of an element, and the lists of text and inline elements between them."""
    out: list = []
    for child in node.children:
        if isinstance(child, Node) and (child.tag in BLOCK or id(child) in on):
            if not marked(child):
                out.append(child)
        elif isinstance(child, str) or not marked(child):
            if not out or isinstance(out[-1], Node):
                out.append([])
            out[-1].append(child)
    return out


def _reads(part, size: int, in_body: bool, section: float, least: float) -> bool:
    if isinstance(part, Node) and part.tag == "article":
        return False
    if isinstance(part, Node) and part.tag in CONTAINERS and part.tag != "blockquote":
        return _score(part) >= (section if part.tag == "section" else least)
    if in_body:  # a line of its own there is seldom the article's
        return size >= 80
    return isinstance(part, Node) or size >= 25


def _score(node: Node) -> float:
    """What all paragraphs within an element are worth."""
    return sum(_worth(x, *_own_text(x)) for x in elements(node) if x.tag in PARAGRAPHS)


def linked(node: Node) -> bool:
    """Whether over half of an element's text is links."""
    size, links = _size([node])
    return links > size / 2


def _size(items: list) -> tuple[int, int]:
    """The characters of text of some nodes, and how many of them are links."""
    size = links = 0
    stack = [(x, False) for x in items]
    while stack:
        item, linked = stack.pop()
        if isinstance(item, str):
            n = len(item.strip())
            size, links = size + n, links + (n if linked else 0)
        elif not marked(item):
            stack.extend((c, linked or item.tag == "a") for c in item.children)
    return size, links
