"""Selectors on one parsed document, by plain backtracking: for single documents, and to hold the plans against."""

from __future__ import annotations

import re

from ..plans.selector import Attribute, Complex, Compound, Pseudo, Selector
from .tags import CASELESS
from .tree import Node, text_of

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def get(node: Node, name: str) -> str | None:
    name = name.translate(_ASCII)
    if name == "class":
        return None if node.classes is None else " ".join(node.classes)
    return next((v for n, v in node.attrs or () if n == name), None)


def _attribute(nodes: list[Node], x: Node, a: Attribute) -> bool:
    prose = a.name == "text"
    value = text_of(nodes, x.idx, everything=True) if prose else get(x, a.name)
    if a.op is None:
        return bool(value) if prose else value is not None
    if value is None:
        return False
    want = a.value
    if a.flag == "i" or (a.flag is None and not prose and a.name in CASELESS):
        value, want = (value.lower(), want.lower()) if prose else (value.translate(_ASCII), want.translate(_ASCII))
    if a.op in ("^=", "$=", "*=") and not want:
        return prose
    return {
        "=": lambda: value == want,
        "^=": lambda: value.startswith(want),
        "$=": lambda: value.endswith(want),
        "*=": lambda: want in value,
        "|=": lambda: value == want or value.startswith(want + "-"),
        "~=": lambda: bool(want) and want in (value.split() if prose else re.split(r"[ \t\n\f\r]+", value)),
    }[a.op]()


def _ordinal(place: int, p: Pseudo) -> bool:
    if p.step == 0:
        return place == p.offset
    k, rest = divmod(place - p.offset, p.step)
    return rest == 0 and k >= 0


def _pseudo(nodes: list[Node], x: Node, p: Pseudo) -> bool:
    if p.name == "not":
        return not any(matches_complex(nodes, x, c) for c in p.inner)
    if p.name == "is":
        return any(matches_complex(nodes, x, c) for c in p.inner)
    if p.name == "has":
        return any(_relative(nodes, x, c, 0) for c in p.inner)
    return {
        "root": lambda: x.parent == 0,
        "empty": lambda: not x.children,
        "first-child": lambda: x.sib_ord == 1,
        "last-child": lambda: x.sib_rev == 1,
        "only-child": lambda: x.sib_ord == x.sib_rev == 1,
        "first-of-type": lambda: x.type_ord == 1,
        "last-of-type": lambda: x.type_rev == 1,
        "only-of-type": lambda: x.type_ord == x.type_rev == 1,
        "nth-child": lambda: _ordinal(x.sib_ord, p),
        "nth-last-child": lambda: _ordinal(x.sib_rev, p),
        "nth-of-type": lambda: _ordinal(x.type_ord, p),
        "nth-last-of-type": lambda: _ordinal(x.type_rev, p),
    }[p.name]()


def _relative(nodes: list[Node], x: Node, c: Complex, k: int) -> bool:
    if k == len(c.compounds):
        return True
    comb = c.combinators[k]
    siblings = nodes[x.parent].children[x.sib_ord :] if x.sib_ord else []
    to = {" ": range(x.idx + 1, x.end), ">": x.children, "+": siblings[:1], "~": siblings}[comb]
    return any(matches_compound(nodes, nodes[i], c.compounds[k]) and _relative(nodes, nodes[i], c, k + 1) for i in to)


def matches_compound(nodes: list[Node], x: Node, c: Compound) -> bool:
    return (
        x.kind == "element"
        and (c.tag is None or x.tag == c.tag)
        and all(x.id == i for i in c.ids)
        and all(k in (x.classes or ()) for k in c.classes)
        and all(_attribute(nodes, x, a) for a in c.attributes)
        and all(_pseudo(nodes, x, p) for p in c.pseudos)
    )


def matches_complex(nodes: list[Node], x: Node, c: Complex, k: int | None = None) -> bool:
    k = len(c.compounds) - 1 if k is None else k
    if not matches_compound(nodes, x, c.compounds[k]):
        return False
    if k == 0:
        return True
    comb = c.combinators[k - 1]
    if comb == ">":
        to = [x.parent]
    elif comb in "+~":
        to = nodes[x.parent].children[: x.sib_ord - 1]
        to = to[-1:] if comb == "+" else to
    else:
        to, at = [], x
        while at.parent is not None:
            to.append(at.parent)
            at = nodes[at.parent]
    return any(matches_complex(nodes, nodes[i], c, k - 1) for i in to)


def select(nodes: list[Node], selector: Selector | str, start: int = 0, scope: str = "subtree") -> list[Node]:
    """Matches inside an element in document order; scope "forward": from the element to the end of the document."""
    own = Selector.of(selector).alternatives
    to = nodes[start].end if scope == "subtree" else len(nodes)
    return [x for x in nodes[start + 1 : to] if any(matches_complex(nodes, x, c) for c in own)]
