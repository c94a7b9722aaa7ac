"""Changes of a document's tree: removal with pruning, unwrapping, replacement, insertion, text, attributes, white space."""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import copy

from ..functions.matcher import select
from ..functions.tags import BLOCK, INLINE, RAW
from ..functions.tree import Node, _number, build
from ..plans.selector import Selector


class Item:
    """A node of a tree that is being changed."""

    def __init__(self, node: Node):
        self.node, self.parent, self.children = node, None, []

    kind = property(lambda self: self.node.kind)
    tag = property(lambda self: self.node.tag)

    def text(self) -> str:
        return self.node.text if self.kind == "text" else "".join(c.text() for c in self.children)

    def neighbours(self) -> tuple[Item | None, Item | None]:
        own = self.parent.children
        i = own.index(self)
        return own[i - 1] if i else None, own[i + 1] if i + 1 < len(own) else None


def _text(said: str) -> Item:
    return Item(Node(0, "text", None, None, 0, text=said))


def _inline(x: Item | None) -> bool:
    return x is not None and (x.kind == "text" or x.tag in INLINE)


class Tree:
    """The items of a document; rebuilt() numbers them anew."""

    def __init__(self, nodes: list[Node]):
        self.items = [Item(copy(x)) for x in nodes]
        for x in self.items[1:]:
            x.parent = self.items[x.node.parent]
            x.parent.children.append(x)
        self._nodes = nodes

    def select(self, selector: Selector | str) -> list[Item]:
        """Items that matched in the document as it was before any change, without those removed since."""
        found = [self.items[x.idx] for x in select(self._nodes, selector)]
        return [x for x in found if self._attached(x)]

    def _attached(self, x: Item) -> bool:
        while x.parent is not None:
            x = x.parent
        return x is self.items[0]

    def _space_between(self, a: Item | None, b: Item | None) -> None:
        """A space where a block stood between inline neighbours that bring none."""
        if _inline(a) and _inline(b) and a.parent is b.parent and not a.text().endswith((" ", "\n", "\t")) and not b.text().startswith((" ", "\n", "\t")):
            own = a.parent.children
            x = _text(" ")
            x.parent = a.parent
            own.insert(own.index(a) + 1, x)

    def _detach(self, x: Item) -> None:
        x.parent.children.remove(x)
        x.parent = None

    def prune(self, x: Item) -> None:
        """Remove x if nothing is left in it, then look at its parent: blocks and body without visible text, others without children."""
        while x.parent is not None and x.kind == "element":
            parent, (before, after) = x.parent, x.neighbours()
            hollow = not x.children or ((x.tag in BLOCK or x.tag == "body") and not x.text().strip())
            if not hollow or x.tag in ("br", "hr"):
                return
            self._detach(x)
            if x.tag in BLOCK:
                self._space_between(before, after)
            x = parent

    def remove(self, x: Item) -> None:
        parent, (before, after) = x.parent, x.neighbours()
        self._detach(x)
        if x.tag in BLOCK:
            self._space_between(before, after)
        self.prune(parent)

    def unwrap(self, x: Item) -> None:
        """Put the children in x's place; summary children go."""
        parent, (before, after) = x.parent, x.neighbours()
        own = [c for c in x.children if c.tag != "summary"]
        at = parent.children.index(x)
        self._detach(x)
        for k, c in enumerate(own):
            c.parent = parent
            parent.children.insert(at + k, c)
        if not own:
            self.prune(parent)
        elif x.tag in BLOCK:
            self._space_between(before, own[0])
            self._space_between(own[-1], after)

    def replace_with(self, x: Item, other: Item) -> None:
        """Move another item into x's place and prune where it came from."""
        source = other.parent
        if source is not None:
            self._detach(other)
        parent, (before, after) = x.parent, x.neighbours()
        at = parent.children.index(x)
        self._detach(x)
        other.parent = parent
        parent.children.insert(at, other)
        if source is not None and self._attached(source):
            self.prune(source)
        if x.tag in BLOCK and _inline(other):
            self._space_between(before, other)
            self._space_between(other, after)

    def clear(self, x: Item) -> None:
        for c in list(x.children):
            self._detach(c)

    def fragment(self, html: str) -> list[Item]:
        """Detached items of some HTML."""
        own = Tree(build(html)).items[0].children
        for x in own:
            x.parent = None
        return own

    def insert(self, x: Item, where: str, *new: Item) -> None:
        """where: first or last child of x, or before or after it."""
        parent = x if where in ("first", "last") else x.parent
        at = {"first": lambda: 0, "last": lambda: len(x.children), "before": lambda: parent.children.index(x), "after": lambda: parent.children.index(x) + 1}[where]()
        for k, c in enumerate(new):
            if c.parent is not None:
                self._detach(c)
            c.parent = parent
            parent.children.insert(at + k, c)

    def append_text(self, x: Item, said: str) -> None:
        self.insert(x, "last", _text(said))

    def replace_text(self, x: Item, said: str) -> None:
        if x.kind in ("text", "comment"):
            x.node.text = said
        else:
            self.clear(x)
            self.append_text(x, said)

    def append_comment(self, x: Item, said: str) -> None:
        self.insert(x, "last", Item(Node(0, "comment", None, None, 0, text=said)))

    def remove_attributes(self, x: Item, test: Callable[[str, str], bool]) -> None:
        x.node.attrs = [(n, v) for n, v in x.node.attrs or () if not test(n, v)]

    def set_attribute(self, x: Item, name: str, value: str) -> None:
        self.remove_attributes(x, lambda n, _: n == name.lower())
        x.node.attrs.append((name.lower(), value))

    def remove_classes(self, x: Item, test: Callable[[str], bool]) -> None:
        left = [c for c in x.node.classes or () if not test(c)]
        x.node.classes = left or None

    def add_class(self, x: Item, name: str) -> None:
        x.node.classes = list(dict.fromkeys([*(x.node.classes or ()), name]))

    def strip_formatting(self) -> None:
        """Drop texts of line ends and tabs only; take tabs out of others and make spaces of their line ends."""

        def walk(x: Item) -> None:
            for c in list(x.children):
                if c.kind in ("text", "comment"):
                    if not re.sub(r"[\n\r\t]", "", c.node.text):
                        self._detach(c)
                    elif re.search(r"[\n\r\t]", c.node.text):
                        c.node.text = c.node.text.replace("\t", "").replace("\r", "\n").strip("\n").replace("\n", " ")
                else:
                    walk(c)

        walk(self.items[0])

    def rebuilt(self) -> list[Node]:
        """Nodes in preorder with all links new; neighbouring texts stay apart."""
        out: list[Node] = []

        def walk(x: Item, parent: int | None, depth: int, raw: bool) -> None:
            node = copy(x.node)
            node.idx, node.parent, node.depth, node.children = len(out), parent, depth, []
            node.raw = raw and node.kind == "text"
            node.prev_el = node.next_el = node.sib_ord = node.sib_rev = node.type_ord = node.type_rev = None
            out.append(node)
            if parent is not None and node.kind == "element":
                out[parent].children.append(node.idx)
            for c in x.children:
                walk(c, node.idx, depth + 1, node.tag in RAW)
            node.end = len(out)

        import sys

        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 4 * max(x.node.depth for x in self.items) + 1000))
        try:
            walk(self.items[0], None, 0, False)
        finally:
            sys.setrecursionlimit(limit)
        _number(out)
        return out
