"""A document tree from HTML as found: forgiving, with the standard library's tokenizer."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "template", "noscript"])
#: Start tags that end an open element: (what ends, what stops the search for it).
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    """An element; its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, as the tree is when each is reached."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            if node.children:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def nodes(self) -> list[Node]:
        """All elements below, in document order, as the tree is now."""
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if c.__class__ is not str:
                out.append(c)
                if c.children:
                    todo += c.children[::-1]
        return out

    def strings(self) -> Iterator[str]:
        todo = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in RAW:
                todo += reversed(c.children)

    def text(self, between: str = " ") -> str:
        """Stripped strings that are not blank, joined."""
        out, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if c.__class__ is str:
                if s := c.strip():
                    out.append(s)
            elif c.tag not in RAW:
                todo += c.children[::-1]
        return between.join(out)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.nodes() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def unwrap(self) -> None:
        """Put the children in the element's place."""
        at = next(k for k, c in enumerate(self.parent.children) if c is self)
        for c in self.children:
            if isinstance(c, Node):
                c.parent = self.parent
        self.parent.children[at : at + 1] = self.children
        self.parent = None

    def replace(self, text: str) -> None:
        at = next(k for k, c in enumerate(self.parent.children) if c is self)
        self.parent.children[at] = text
        self.parent = None

    def attached(self, root: Node) -> bool:
        n = self
        while n is not None and n is not root:
            n = n.parent
        return n is root

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def after(self, element: bool = True) -> Node | None:
        """The next element that has the same parent."""
        if self.parent is None:
            return None
        own = self.parent.children
        at = next(k for k, c in enumerate(own) if c is self)
        return next((c for c in own[at + 1 :] if isinstance(c, Node)), None)

    def html(self) -> str:
        out, todo = [], [self] if self.tag else list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(escape(c, quote=False))
            else:
                attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in c.attrs.items())
                out.append(f"<{c.tag}{attrs}{'/' if c.tag in VOID else ''}>")
                if c.tag not in VOID:
                    todo.append((f"</{c.tag}>",))
                    todo += reversed(c.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are asked for by nobody."""
        return j

    def _close(self, k: int) -> None:
        del self.open[k:]

    def _end_implied(self, tag: str) -> None:
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in stops:
                    break
                if self.open[k].tag in ends:
                    self._close(k)
                    if tag != "tr":
                        break
        elif tag in _ENDS_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    self._close(k)
                    break
                if self.open[k].tag in ("div", "td", "th", "li", "section", "article", "table", "body"):
                    break

    def handle_starttag(self, tag, attrs):
        self._end_implied(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._close(k)
                break

    def handle_data(self, data):
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)


def parse(html: str | None) -> Node:
    """The tree of a document or fragment; null is an empty one.  Comments are left out."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]")
_TESTS: dict[str, Callable[[str, str], bool]] = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda have, want: want in have.split()}


@lru_cache(maxsize=1024)
def _parts(simple: str) -> list[tuple[str, ...]]:
    return _SIMPLE.findall(simple)


@lru_cache(maxsize=1024)
def _chains(selector: str) -> list[list[str]]:
    return [re.sub(r"\s*>\s*", " > ", one.strip()).split() for one in selector.split(",") if one.strip()]


def _fits(node: Node, simple: str) -> bool:
    for tag, id_, class_, attr, how, value in _parts(simple):
        if tag and tag not in ("*", node.tag) or id_ and node.get("id") != id_ or class_ and class_ not in node.get("class").split():
            return False
        if attr and (attr not in node.attrs or how and not _TESTS[how](node.get(attr), value)):
            return False
    return bool(simple)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that fit a selector: tags, ids, classes, attributes, descendants, children and lists of these."""
    chains = _chains(selector)

    def chained(node: Node, chain: list[str]) -> bool:
        if not chain:
            return True
        if chain[-1] == ">":
            return node.parent is not None and chained_at(node.parent, chain[:-1])
        up = node.parent
        while up is not None:
            if chained_at(up, chain):
                return True
            up = up.parent
        return False

    def chained_at(node: Node, chain: list[str]) -> bool:
        return bool(node.tag) and _fits(node, chain[-1]) and chained(node, chain[:-1])

    if all(len(c) == 1 for c in chains):  # no ancestors to look at
        return [n for n in root.nodes() if n.tag and any(_fits(n, c[0]) for c in chains)]
    return [n for n in root.nodes() if any(chained_at(n, c) for c in chains)]
