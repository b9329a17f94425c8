"""Markup as a tree, and what can be read off it: text, nodes by selector, links. Plain functions; no recursion."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# ---------------------------------------------------------------- the tree

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This node and those below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Node):
                yield node
                todo += reversed(node.children)

    def text(self) -> str:
        return written(self)


class _Tree(HTMLParser):
    """``sealed`` elements end at their own end tag only: nothing that ends around them lets their content out."""

    def __init__(self, void: frozenset, sealed: frozenset):
        super().__init__(convert_charrefs=True)
        self.void, self.sealed = void, sealed
        self.root = self.here = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in self.void:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.tag != tag:
            if node.tag in self.sealed:
                return
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        self.here.children.append(data)


def dom(markup: str, void: frozenset = VOID, sealed: frozenset = frozenset()) -> Node:
    """The tree of a page; what was read before any damage."""
    tree = _Tree(void, sealed)
    try:
        tree.feed(markup)
        tree.close()
    except Exception:
        pass
    return tree.root


def _nothing(node: Node) -> str:
    return ""


def written(root: Node, skipped: frozenset = frozenset(), before: Callable[[Node], str] = _nothing, after: Callable[[Node], str] = _nothing) -> str:
    """The texts below a node in document order, with what ``before`` and ``after`` put around each element."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag not in skipped:
            out.append(before(item))
            todo.append(after(item))
            todo += reversed(item.children)
    return "".join(out)


# ---------------------------------------------------------------- text

UNREAD = frozenset(("script", "style", "noscript", "template"))
CHROME = frozenset(("nav", "header", "footer", "form", "iframe"))
BLOCKS = frozenset(("p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"))
CELLS = frozenset(("td", "th"))
_GAP = re.compile(r"[ \t\r\f\v\n|]+")


def _gap(m: re.Match) -> str:
    """Between two words: a cell's end if several cells end there, else one or two line feeds, else what stood there."""
    bars, feeds = m[0].count("|"), m[0].count("\n")
    if bars > 1:
        return " | "
    return "\n" * min(feeds, 2) or " ".join(["", *m[0].split(), ""] if bars and m[0] != "|" else m[0].split()) or " "


def tidy(text: str) -> str:
    return _GAP.sub(_gap, text).strip(" \n|")


def _page(html: str, skipped: frozenset, attributes: tuple) -> str:
    def before(node: Node) -> str:
        said = "".join(f"\n{node.attrs[a].strip()}\n" for a in node.attrs if a in attributes and node.attrs[a].strip())
        return said + "\n" * (node.tag in BLOCKS)

    def after(node: Node) -> str:
        return " | " if node.tag in CELLS else "\n" * (node.tag in BLOCKS and node.tag not in VOID)

    return tidy(written(dom(html, sealed=skipped), skipped, before, after))


def html_text(html: str) -> str:
    """What a judge reads: no scripts, no site furniture, no asides; pictures by their alternative text."""
    return _page(html, UNREAD | CHROME | {"aside"}, ("alt",))


def html_text_wide(html: str) -> str:
    """What the page might have said: asides and titles too. Answers only whether the strict reading lost something."""
    return _page(html, UNREAD | CHROME, ("alt", "title", "aria-label"))


def xml_text(data: bytes) -> str:
    """Text of a document in which every element stands on lines of its own."""
    root = dom(data.decode("utf-8", "replace"), void=frozenset(), sealed=UNREAD)
    return tidy(written(root, UNREAD, after=lambda node: "\n"))


def docx_text(data: bytes) -> tuple[str, str]:
    """(text, why not)."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, OSError) as e:
        return "", f"not a zip: {e}"
    except KeyError:
        return "", "no word/document.xml"

    def after(node: Node) -> str:
        if node.tag == "w:tc":
            return " | "
        ends_cell = node.tag == "w:p" and node.parent.tag == "w:tc" and node.parent.children[-1] is node
        return "\n" * (node.tag in ("w:p", "w:tr", "w:br") and not ends_cell)

    return tidy(written(dom(body, void=frozenset()), UNREAD, after=after)), ""


# ---------------------------------------------------------------- selectors

_PART = re.compile(r"""\s+|[\w-]+|"[^"]*"|'[^']*'|[*^]?=|.""", re.S)
_COMPARE = {"=": str.__eq__, "^=": str.startswith, "*=": str.__contains__}


class _Selector:
    """Reads a selector part by part into steps; each step is a list of tests on a node."""

    def __init__(self, text: str):
        self.text, self.parts = text, _PART.findall(text.strip())[::-1]
        self.steps: list[list[Callable[[Node], bool]]] = [[]]
        while self.parts:
            self.read()
        if not all(self.steps):
            self.refuse()

    def refuse(self):
        raise ValueError(f"selector not supported: {self.text}")

    def take(self) -> str:
        return self.parts.pop() if self.parts else self.refuse()

    def name(self) -> str:
        return part if re.fullmatch(r"[\w-]+", part := self.take()) else self.refuse()

    def read(self) -> None:
        part, tests = self.take(), self.steps[-1]
        if part.isspace():
            self.steps.append([])
        elif part == "#":
            tests.append(lambda n, v=self.name(): n.attrs.get("id") == v)
        elif part == ".":
            tests.append(lambda n, v=self.name(): v in n.attrs.get("class", "").split())
        elif part == "[":
            tests.append(self.attribute())
        elif part[0].isalpha() and not tests:
            tests.append(lambda n, v=part: n.tag == v)
        else:
            self.refuse()

    def attribute(self) -> Callable[[Node], bool]:
        inside: list[str] = []
        while (part := self.take()) != "]":
            inside.append(part)
        inside = "".join(inside).strip(), *[p for p in inside if p in _COMPARE][:1]
        key, operator, value = inside[0].partition(inside[1]) if len(inside) > 1 else (inside[0], "", "")
        key, value = key.strip(), value.strip()
        if not re.fullmatch(r"[\w-]+", key) or operator and not value:
            self.refuse()
        if not operator:
            return lambda n: key in n.attrs
        if value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        return lambda n: key in n.attrs and _COMPARE[operator](n.attrs[key], value)


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that match a selector of tags, #id, .class, [attribute] tests and descent; other syntax is an error.

    One walk down: with each node goes how many of the first steps its ancestors have met, in order.
    """
    *above, last = _Selector(selector).steps
    found: list[Node] = []
    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, met = todo.pop()
        if node.parent is not None:
            if met == len(above) and all(test(node) for test in last):
                found.append(node)
            met += met < len(above) and all(test(node) for test in above[met])
        todo += [(child, met) for child in reversed(node.children) if isinstance(child, Node)]
    return found
