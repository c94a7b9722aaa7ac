"""One document in memory: parse it, walk it, select from it, change it, write it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from ..functions import matcher, serialize
from ..functions.tags import BLOCK, FORMAT_INLINE, INLINE, RAW, RCDATA
from ..functions.tree import Node, build, label, text_of
from ..plans.selector import Selector

Sel = Selector | str


class CardinalityError(ValueError):
    """More or fewer matches than were asked for."""


class Element:
    """A handle on a node; equal handles have equal nodes of one document."""

    def __init__(self, document: Document, idx: int):
        self.document, self.index = document, idx

    @property
    def node(self) -> Node:
        return self.document.nodes[self.index]

    def __eq__(self, other) -> bool:
        return isinstance(other, Element) and other.document is self.document and other.index == self.index

    def __hash__(self) -> int:
        return hash((id(self.document), self.index))

    def __repr__(self) -> str:
        return f"<{label(self.node)}>"

    tag = property(lambda self: self.node.tag)
    id = property(lambda self: self.node.id)
    classes = property(lambda self: list(self.node.classes or []))
    depth = property(lambda self: self.node.depth)
    label = property(lambda self: label(self.node))
    is_block = property(lambda self: self.node.tag in BLOCK)
    is_inline = property(lambda self: self.node.tag in INLINE)
    is_format_inline = property(lambda self: self.node.tag in FORMAT_INLINE)
    is_raw_text = property(lambda self: self.node.tag in RAW | RCDATA)

    @property
    def attrs(self) -> dict[str, str]:
        own = {} if self.node.classes is None else {"class": " ".join(self.node.classes)}
        return own | dict(self.node.attrs or ())

    def get(self, name: str) -> str | None:
        return matcher.get(self.node, name)

    def __getitem__(self, name: str) -> str:
        value = self.get(name)
        if value is None:
            raise KeyError(name)
        return value

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    @property
    def text(self) -> str:
        return text_of(self.document.nodes, self.index)

    @property
    def own_text(self) -> str | None:
        said = "".join(x.text for x in self.document.nodes[self.index + 1 : self.node.end] if x.kind == "text" and x.parent == self.index)
        return said or None

    def characters(self, kinds: tuple[str, ...] = ("text",)) -> str:
        """All text, comments, or both, of the subtree in order."""
        return "".join(x.text for x in self.document.nodes[self.index : self.node.end] if x.kind in kinds)

    def _at(self, i: int | None) -> Element | None:
        return None if i is None else Element(self.document, i)

    parent = property(lambda self: self._at(self.node.parent))
    next_sibling = property(lambda self: self._at(self.node.next_el))
    prev_sibling = property(lambda self: self._at(self.node.prev_el))
    children = property(lambda self: [Element(self.document, i) for i in self.node.children])

    @property
    def ancestors(self) -> list[Element]:
        out, at = [], self.parent
        while at is not None:
            out.append(at)
            at = at.parent
        return out

    @property
    def css_path(self) -> str:
        own = [label(e.node) for e in [self, *self.ancestors] if e.index]
        return " > ".join(reversed(own))

    def first_child(self, tag: str | None = None) -> Element | None:
        return next((c for c in self.children if tag is None or c.tag == tag), None)

    def child_path(self, *tags: str) -> Element | None:
        at: Element | None = self
        for t in tags:
            at = at.first_child(t) if at else None
        return at

    def walk(self, how: str = "descendants", kinds: tuple[str, ...] = ("element",)) -> Iterator[Element]:
        """descendants in preorder; forwards to the end of the document; reverse back to its start."""
        to = {"descendants": range(self.index + 1, self.node.end), "forwards": range(self.index + 1, len(self.document.nodes)), "reverse": range(self.index - 1, 0, -1)}[how]
        return (Element(self.document, i) for i in to if self.document.nodes[i].kind in kinds)

    def events(self) -> Iterator[tuple[str, Element]]:
        """open and close of every element of the subtree."""
        open_: list[int] = []
        for x in self.document.nodes[self.index : self.node.end]:
            while open_ and self.document.nodes[open_[-1]].end <= x.idx:
                yield "close", Element(self.document, open_.pop())
            if x.kind in ("element", "root"):
                yield "open", Element(self.document, x.idx)
                open_.append(x.idx)
        yield from (("close", Element(self.document, i)) for i in reversed(open_))

    def matches(self, selector: Sel) -> bool:
        return any(matcher.matches_complex(self.document.nodes, self.node, c) for c in Selector.of(selector).alternatives)

    def select(self, selector: Sel, scope: str = "subtree") -> list[Element]:
        return [Element(self.document, x.idx) for x in matcher.select(self.document.nodes, selector, self.index, scope)]

    def select_first(self, selector: Sel) -> Element | None:
        return next(iter(self.select(selector)), None)

    def select_text(self, selector: Sel) -> list[str]:
        return [e.text for e in self.select(selector)]

    def select_attr(self, selector: Sel, name: str, *, skip_missing: bool = False) -> list[str | None]:
        found = [e.get(name) for e in self.select(selector)]
        return [v for v in found if v is not None] if skip_missing else found

    def select_count(self, selector: Sel, attr: str | None = None) -> int:
        return sum(attr is None or attr in e for e in self.select(selector))

    def select_html(self, selector: Sel, pretty: bool = False) -> list[str]:
        return [e.to_html(pretty) for e in self.select(selector)]

    def select_child(self, selector: Sel) -> list[Element]:
        return [c for c in self.children if c.matches(selector)]

    def exactly(self, selector: Sel, least: int, most: int | None = None) -> list[Element]:
        found, most = self.select(selector), least if most is None else most
        if not least <= len(found) <= most:
            raise CardinalityError(f"{len(found)} matches of {Selector.of(selector).source!r}, not {least} to {most}")
        return found

    def to_html(self, pretty: bool = False) -> str:
        return (serialize.pretty if pretty else serialize.raw)(self.document.nodes, self.index)


class Document(Element):
    """A parsed document; as an element it is its root."""

    def __init__(self, nodes: list[Node], key: str | None = None, meta: dict | None = None):
        self.nodes, self.key, self.meta = nodes, key, meta
        super().__init__(self, 0)

    @property
    def root(self) -> Element:
        return Element(self, 0)

    @property
    def body(self) -> Element | None:
        return next((Element(self, x.idx) for x in self.nodes if x.tag == "body" and x.kind == "element"), None)

    def changed(self, change: Callable[[object], None]) -> Document:
        """A document after change(tree), where tree is a mutate.Tree of this one."""
        from .mutate import Tree

        tree = Tree(self.nodes)
        change(tree)
        return Document(tree.rebuilt(), self.key, self.meta)


def parse(html: str, strict_end: bool = False) -> Document:
    return Document(build(html, strict_end))
