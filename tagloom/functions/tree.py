"""HTML text to a flat tree: a tolerant tokenizer and a builder without implied elements.

Nodes are numbered in preorder from the root, 0; the subtree of a node is the interval [idx, end).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.entities import html5

import xxhash

from .tags import CLOSED_BY, CLOSED_UNDER, FOREIGN, RAW, RCDATA, STANDARD, VOID

MAX_NODES = 16_777_215
MAX_DEPTH = 8_192

_SPACE = re.compile(r"[ \t\n\f\r]+")
_ATTR = re.compile(r"""[\s/]*(=?[^\s/>=]+|=)(\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


class CapacityError(ValueError):
    """A document with more nodes or deeper nesting than allowed."""


@dataclass(slots=True)
class Node:
    idx: int
    kind: str  # root, element, text, comment, doctype
    tag: str | None
    parent: int | None
    depth: int
    attrs: list[tuple[str, str]] | None = None
    classes: list[str] | None = None
    text: str | None = None
    raw: bool = False  # text inside script or style
    end: int = 0
    children: list[int] = field(default_factory=list)  # of elements only
    prev_el: int | None = None
    next_el: int | None = None
    sib_ord: int | None = None
    sib_rev: int | None = None
    type_ord: int | None = None
    type_rev: int | None = None

    @property
    def id(self) -> str | None:
        return next((v for n, v in self.attrs or () if n == "id"), None)


def _closed_references(said: str) -> str:
    """Character references that end in ; decoded, and no others."""
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], said)


def _attr_value(value: str, bare: bool = True) -> str:
    """Character references of an attribute's value; unlike in text, a name without ; before = or a letter or digit stays."""
    if "&" not in value:
        return value
    if not bare:
        return _closed_references(value)

    def one(m: re.Match) -> str:
        said = m[0]
        if said[1] == "#":
            return html.unescape(said)
        if said[1:] not in html5 or (said[-1] != ";" and value[m.end() : m.end() + 1] == "="):
            return said
        return html5[said[1:]]

    return _REFERENCE.sub(one, value)


def _attributes(s: str, at: int, bare: bool = True) -> tuple[list[tuple[str, str]], bool, int] | None:
    """Attributes from `at` on, whether the tag ends in />, and where it ends; None if it doesn't end."""
    attrs: list[tuple[str, str]] = []
    n = len(s)
    while True:
        while at < n and (s[at].isspace() or s[at] == "/"):
            at += 1
        if at >= n:
            return None
        if s[at] == ">":
            return attrs, s[at - 1] == "/", at + 1
        m = _ATTR.match(s, at)
        if m is None:
            at += 1
            continue
        name, value = m[1].translate(_UPPER), next((v for v in (m[3], m[4], m[5]) if v is not None), "")
        at = m.end()
        if m[2] is not None and m[3] is None and m[4] is None and m[5] is None and at < n and s[at] in "\"'":
            return None  # a quote that isn't closed
        if name[0].isalnum():
            pair = name, _attr_value(value, bare)
            if pair not in attrs:
                attrs.append(pair)


def _classes(attrs: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[str] | None]:
    """Attributes without class, and its tokens."""
    for a, v in attrs:
        if a == "class":
            return [(a, v) for a, v in attrs if a != "class"], list(dict.fromkeys(_SPACE.split(v.strip(" \t\n\f\r"))))
    return attrs, None


_WELL = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:\s+[A-Za-z][^\s"'>/=<]*="[^"]*")*)\s*(/?)>""")  # a tag as most are written
_PAIR = re.compile(r"""([A-Za-z][^\s"'>/=<]*)="([^"]*)\"""")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_COMMENT_END = re.compile(r"--!?>")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW | RCDATA}

_SEEN: dict[bool, dict[str, tuple]] = {True: {}, False: {}}  # by bare_references: what short tags in the usual form say, by their text: most are repeated again and again
_SEEN_MOST, _SEEN_LENGTH = 20_000, 40

KINDS = ("root", "element", "text", "comment", "doctype")
ROOT, ELEMENT, TEXT, COMMENT, DOCTYPE = range(5)
Row = tuple[int, str | None, int | None, int, list | None, list | None, str | None, bool]  # kind, tag, parent, depth, attrs, classes, text, raw


def parse_rows_of(source: str, strict_end: bool = False, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH, bare_references: bool = True) -> tuple[list[Row], list[int]]:
    """A row for each node of a document, the root's first, and where each node's subtree ends.

    No element is implied and p doesn't close p. An end tag closes the innermost element of its name with all that is open in it;
    where none is open it is ignored. strict_end: an end tag that finds one child of CLOSED_UNDER open closes only that child.
    bare_references: those of HTML that may go without ; are decoded so too.
    One pass without objects: tags in the usual form are one match of one expression, others are read sign by sign.
    """
    s = source.replace("\r\n", "\n").replace("\r", "\n") if "\r" in source else source
    unescape = html.unescape if bare_references else _closed_references
    n, at, last = len(s), 0, 0
    rows: list[Row] = [(ROOT, "[document]", None, 0, None, None, None, False)]
    ends = [1]
    open_, names = [0], ["[document]"]
    foreign: list[int] = []
    texts: list[str] = []  # of the text node that is being read

    def flush() -> None:
        said = "".join(texts)
        texts.clear()
        if said:
            if len(rows) > max_nodes:
                raise CapacityError(f"more than {max_nodes} nodes")
            rows.append((TEXT, None, open_[-1], len(open_), None, None, said, names[-1] in RAW))
            ends.append(len(rows))

    def pop() -> None:
        i = open_.pop()
        names.pop()
        ends[i] = len(rows)
        if foreign and foreign[-1] == i:
            foreign.pop()

    find, seen = s.find, _SEEN[bare_references]
    while True:
        at = find("<", at)
        if at < 0 or at + 1 >= n:
            break
        to = find(">", at, at + _SEEN_LENGTH) + 1
        known = seen.get(s[at:to]) if to else None
        if known:
            slash, name, attrs, classes, closing = known
            after = to
        elif m := _WELL.match(s, at):
            slash, name, inside, closing = m.groups()
            attrs = [(a if a.islower() else a.translate(_UPPER), _attr_value(v, bare_references)) for a, v in _PAIR.findall(inside)] if inside and not slash else []
            if len(attrs) > 1 and len(set(attrs)) < len(attrs):
                attrs = list(dict.fromkeys(attrs))
            after = m.end()
            if not name.islower():
                name = name.translate(_UPPER)
            attrs, classes = _classes(attrs)
            if after == to and len(seen) < _SEEN_MOST:
                seen[s[at:to]] = slash, name, attrs, classes, closing
        elif m := _TAG.match(s, at):
            slash, name = m.groups()
            parsed = _attributes(s, m.end(), bare_references)
            if parsed is None:  # the text ends inside the tag
                if last < at:
                    texts.append(unescape(s[last:at]))
                last = n
                break
            attrs, closing, after = parsed
            if not name.islower():
                name = name.translate(_UPPER)
            attrs, classes = _classes(attrs)
        else:
            c = s[at + 1]
            if c not in "!?/":
                at += 1
                continue
            if last < at:
                texts.append(unescape(s[last:at]))
            said = None  # of a comment
            if s.startswith("<!--", at):
                if s.startswith(("<!-->", "<!--->"), at):
                    said, after = "", at + (5 if s[at + 4] == ">" else 6)
                else:
                    m = _COMMENT_END.search(s, at + 4)
                    said, after = (s[at + 4 : m.start()], m.end()) if m else (s[at + 4 :], n)
            elif foreign and s.startswith("<![CDATA[", at):
                to = s.find("]]>", at)
                to, after = (to, to + 3) if to >= 0 else (n, n)
                texts.append(s[at + 9 : to])
            else:
                to = s.find(">", at)
                to, after = (to, to + 1) if to >= 0 else (n, n)
                if c == "!" and s[at + 2 : at + 9].lower() == "doctype":
                    flush()
                    if len(rows) > max_nodes:
                        raise CapacityError(f"more than {max_nodes} nodes")
                    rows.append((DOCTYPE, "!doctype", open_[-1], len(open_), [("html", "")], None, None, False))
                    ends.append(len(rows))
                elif c != "/" or to > at + 2:
                    said = s[at + (1 if c == "?" else 2) : to]
            if said is not None:
                flush()
                if len(rows) > max_nodes:
                    raise CapacityError(f"more than {max_nodes} nodes")
                rows.append((COMMENT, None, open_[-1], len(open_), None, None, said, False))
                ends.append(len(rows))
            at = last = after
            continue

        if last < at:
            said = s[last:at]
            texts.append(unescape(said) if "&" in said else said)
        at = last = after
        if texts:
            flush()
        if slash:
            if name not in VOID and name in names:
                if strict_end and names[-1] != name and names[-2] == name and name in CLOSED_UNDER.get(names[-1], ()):
                    pop()
                else:
                    while names[-1] != name:
                        pop()
                    pop()
            continue
        if len(open_) > 1 and name in CLOSED_BY.get(names[-1], ()):
            pop()
        if len(rows) > max_nodes:
            raise CapacityError(f"more than {max_nodes} nodes")
        idx = len(rows)
        rows.append((ELEMENT, name, open_[-1], len(open_), attrs, classes, None, False))
        ends.append(idx + 1)
        if name in VOID or (closing and (foreign or name in FOREIGN)):
            continue
        if len(open_) > max_depth:
            raise CapacityError(f"nesting deeper than {max_depth}")
        open_.append(idx)
        names.append(name)
        if name in FOREIGN:
            foreign.append(idx)
        elif name in _CLOSE and not foreign:
            close = _CLOSE[name].search(s, at)
            to = close.start() if close else n
            if at < to:
                said = s[at:to]
                texts.append(unescape(said) if name in RCDATA and "&" in said else said)
            at = last = to
    if last < n:
        texts.append(unescape(s[last:]))
    flush()
    for i in open_:
        ends[i] = len(rows)
    return rows, ends


def build(source: str, strict_end: bool = False, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH) -> list[Node]:
    """The nodes of a document as objects, the root first; see parse_rows_of."""
    rows, ends = parse_rows_of(source, strict_end, max_nodes, max_depth)
    nodes = [Node(i, KINDS[k], tag, parent, depth, None if attrs is None else [*attrs], None if classes is None else [*classes], text, raw, end) for i, ((k, tag, parent, depth, attrs, classes, text, raw), end) in enumerate(zip(rows, ends, strict=True))]
    for x in nodes:
        if x.kind == "element":
            nodes[x.parent].children.append(x.idx)
    _number(nodes)
    return nodes


def rows_of(nodes: list[Node]) -> tuple[list[Row], list[int]]:
    """Objects as rows again."""
    number = {k: i for i, k in enumerate(KINDS)}
    rows = [(number[x.kind], x.tag, x.parent, x.depth, None if x.attrs is None else [tuple(a) for a in x.attrs], x.classes, x.text, x.raw) for x in nodes]
    return rows, [x.end for x in nodes]


def _number(nodes: list[Node]) -> None:
    """Places among element siblings, from both ends, all and of the same name."""
    for parent in nodes:
        own = parent.children
        if not own:
            continue
        total: dict[str, int] = {}
        for i in own:
            total[nodes[i].tag] = total.get(nodes[i].tag, 0) + 1
        seen: dict[str, int] = {}
        for k, i in enumerate(own):
            x = nodes[i]
            seen[x.tag] = seen.get(x.tag, 0) + 1
            x.sib_ord, x.sib_rev = k + 1, len(own) - k
            x.type_ord, x.type_rev = seen[x.tag], total[x.tag] - seen[x.tag] + 1
            x.prev_el = own[k - 1] if k else None
            x.next_el = own[k + 1] if k + 1 < len(own) else None


def checksum(rows: list[Row]) -> int:
    """A hash of structure, names, attributes, classes and texts; signed 64 bits."""
    said = repr([(kind, tag, parent, attrs or None, classes, text) for kind, tag, parent, _, attrs, classes, text, _ in rows])
    return xxhash.xxh3_64_intdigest(said.encode()) - 2**63


def is_standard(tag: str | None) -> bool:
    return tag in STANDARD


def label(node: Node) -> str:
    return (node.tag or "") + (f"#{node.id}" if node.id is not None else "") + "".join(f".{c}" for c in node.classes or ())


def text_of(nodes: list[Node], idx: int, everything: bool = False) -> str:
    """Text of a subtree; script and style only if asked for or if the node is one."""
    inside = everything or nodes[idx].tag in RAW
    return "".join(x.text for x in nodes[idx : nodes[idx].end] if x.kind == "text" and (inside or not x.raw))
