"""Trees back to HTML, as it stands or indented."""

from __future__ import annotations

import re

from .tags import FOREIGN, FORMAT_INLINE, RAW, SLASHED, SVG_ATTRIBUTES, SVG_NAMES, VOID
from .tree import Node

_CONTENT_CHARSET = re.compile(r"(charset\s*=\s*)(?:\"([^\"]*)|'([^']*)|([^;\"'\s]*))", re.I)


def text_escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def value_escaped(s: str) -> str:
    return s.replace("&", "&amp;").replace('"', "&quot;")


def start_tag(node: Node) -> str:
    attrs = list(node.attrs or ())
    if node.tag == "meta":  # what is written is UTF-8
        typed = any(n == "http-equiv" and v.strip().lower() == "content-type" for n, v in attrs)
        attrs = [(n, _as_utf8(n, v, typed)) for n, v in attrs]
    if node.classes is not None:
        attrs.insert(0, ("class", " ".join(node.classes)))
    said = "".join(f' {SVG_ATTRIBUTES.get(n, n)}="{value_escaped(v)}"' if v else f" {SVG_ATTRIBUTES.get(n, n)}" for n, v in attrs)
    return f"<{SVG_NAMES.get(node.tag, node.tag)}{said}{' /' if node.tag in SLASHED else ''}>"


def _as_utf8(name: str, value: str, typed: bool) -> str:
    if name == "charset":
        return value if value.strip().lower() == "utf-8" else "utf-8"
    if name == "content" and typed and (m := _CONTENT_CHARSET.search(value)):
        i = next(k for k in (2, 3, 4) if m[k] is not None)
        return value if m[i].strip().lower() == "utf-8" else value[: m.start(i)] + "utf-8" + value[m.end(i) :]
    return value


def _end_tag(node: Node) -> str:
    return f"</{SVG_NAMES.get(node.tag, node.tag)}>"


def raw(nodes: list[Node], idx: int = 0) -> str:
    """The subtree as HTML without any change of white space."""
    out: list[str] = []
    open_: list[tuple[int, Node]] = []
    for x in nodes[idx : nodes[idx].end]:
        while open_ and open_[-1][0] <= x.idx:
            out.append(_end_tag(open_.pop()[1]))
        if x.kind == "text":
            verbatim = x.raw and not any(n.tag in FOREIGN for _, n in open_)
            out.append(x.text if verbatim else text_escaped(x.text))
        elif x.kind == "comment":
            out.append(f"<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append("<!DOCTYPE html>")
        elif x.kind == "element":
            out.append(start_tag(x))
            if x.tag not in VOID:
                open_.append((x.end, x))
    out += [_end_tag(n) for _, n in reversed(open_)]
    return "".join(out)


def pretty(nodes: list[Node], idx: int = 0) -> str:
    """The subtree with tabs by depth; runs of text and formatting elements stay on a line, layout white space is collapsed."""
    end = nodes[idx].end
    children: dict[int, list[Node]] = {i: [] for i in range(idx, end)}
    inline = dict.fromkeys(range(idx, end), True)
    for x in reversed(nodes[idx:end]):  # children come before their parents
        own = x.kind == "text" or (x.kind == "element" and x.tag in FORMAT_INLINE and inline[x.idx])
        inline[x.idx] = own
        if x.idx != idx:
            children[x.parent].append(x)
            inline[x.parent] = inline[x.parent] and (own or x.kind in ("comment", "doctype"))
    for own in children.values():
        own.reverse()

    def squeezed(x: Node) -> str:
        return x.text.strip("\n\t") if x.raw else text_escaped(re.sub(r"[\t\n ]+", " ", x.text.strip("\n\t")))

    def flat(x: Node) -> str:
        out: list[str] = []
        todo: list[Node | str] = [x]
        while todo:
            y = todo.pop()
            if isinstance(y, str):
                out.append(y)
            elif y.kind == "text":
                out.append(squeezed(y))
            elif y.kind == "element":
                out.append(start_tag(y))
                todo += ([] if y.tag in VOID else [_end_tag(y)]) + children[y.idx][::-1]
        return "".join(out)

    out: list[str] = []
    base = nodes[idx].depth + (nodes[idx].kind == "root")
    todo: list[Node | str] = [nodes[idx]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        indent = "\n" + "\t" * max(0, x.depth - base)
        if x.kind == "comment":
            out.append(f"{indent}<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append(f"{indent}<!DOCTYPE html>")
        elif x.kind == "text":
            out.append(indent + squeezed(x))
        else:
            own = children[x.idx]
            closing = "" if x.kind == "root" or x.tag in VOID else _end_tag(x)
            if x.kind == "element":
                out.append(indent + start_tag(x))
                if own and all(inline[c.idx] for c in own):
                    out.append("".join(map(flat, own)).strip(" ") + closing)
                    continue
            then: list[Node | str] = []
            run: list[str] = []
            for c in [*own, None]:
                if c is not None and inline[c.idx]:
                    run.append(flat(c))
                    continue
                if said := "".join(run).strip(" "):
                    then.append((indent + "\t" if x.kind == "element" else "\n") + said)
                run = []
                if c is not None:
                    then.append(c)
            then.append((indent if own else "") + closing if closing else "")
            todo += then[::-1]
    return "".join(out).lstrip("\n")


__all__ = ["RAW", "pretty", "raw", "start_tag", "text_escaped", "value_escaped"]
