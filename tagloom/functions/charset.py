"""Bytes of a page to text: byte-order mark, UTF-8, the header's and the page's labels, then a guess."""

from __future__ import annotations

import codecs
import re

_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_LABEL = re.compile(rb"charset\s*=\s*(?:\"([^\"]*)|'([^']*)|([^;\"'\s>]*))", re.I)
_META = re.compile(rb"<!--.*?-->|<meta(?=[\s/>])([^>]*)>", re.I | re.S)
# Labels that mean another encoding on the web, and likely encodings by country domain.
_ALIASES = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "x-user-defined": "cp1252", "iso-8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "x-sjis": "cp932", "tis-620": "cp874", "iso-8859-11": "cp874"}
_BY_DOMAIN = {"ru": "cp1251", "ua": "cp1251", "bg": "cp1251", "jp": "cp932", "cn": "gb18030", "tw": "big5", "kr": "cp949", "pl": "cp1250", "cz": "cp1250", "hu": "cp1250", "gr": "cp1253", "tr": "cp1254", "il": "cp1255", "th": "cp874"}


def _encoding(label: bytes | None) -> str | None:
    """A usable encoding; those that ASCII markup can't be written in don't count."""
    name = (label or b"").strip().decode("ascii", "replace").lower()
    if not name or name.startswith(("utf-16", "utf-32", "iso-2022-kr", "utf-7")):
        return None
    try:
        return codecs.lookup(_ALIASES.get(name, name)).name
    except LookupError:
        return None


def _label(s: bytes | None) -> str | None:
    m = _LABEL.search(s or b"")
    return _encoding(next(g for g in m.groups() if g is not None)) if m else None


def _damaged_utf8(raw: bytes, labelled: bool) -> bool:
    """UTF-8 with a few bad bytes, such as a cut at the end leaves."""
    valid = bad = at = 0
    while at < len(raw):
        try:
            valid += sum(c > "\x7f" for c in raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            valid += sum(c > "\x7f" for c in raw[at : at + e.start].decode("utf-8"))
            cut = at + e.end >= len(raw) and e.reason == "unexpected end of data"
            bad += not cut
            at += e.end
    return (valid > 0 or labelled) and valid >= bad * (1 if labelled else 4)


def decode_html(raw: bytes, content_type: str | None = None, url: str | None = None) -> str:
    for bom, name in _BOMS:
        if raw.startswith(bom):
            return raw[len(bom) :].decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    labels = [_label((content_type or "").encode("latin-1", "replace"))]
    labels += [_label(m[1]) for m in _META.finditer(raw[:4096]) if m[1] is not None]
    labels = [x for x in labels if x]
    if _damaged_utf8(raw, labels[:1] == ["utf-8"]):
        return raw.decode("utf-8", "replace")
    own = next((x for x in labels if x != "utf-8"), None)
    return raw.decode(own or _guess(raw, url), "replace")


def _guess(raw: bytes, url: str | None) -> str:
    m = re.match(r"[^:]+://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    domain = m[1].rstrip(".").rpartition(".")[2].lower() if m else ""
    hint = _BY_DOMAIN.get(domain)
    if hint:
        try:
            raw.decode(hint)
            return hint
        except UnicodeDecodeError:
            pass
    if sum(c > 127 for c in raw) < 6:  # too few to tell anything from
        return "cp1252"
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return "cp1252"
    best = from_bytes(raw, cp_exclusion=["utf_8"]).best()
    plain = bytes(range(32, 127))
    if best and _encoding(best.encoding.encode()) and plain.decode(best.encoding, "replace") == plain.decode("ascii"):
        return best.encoding
    return "cp1252"
