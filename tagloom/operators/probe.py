"""Hierarchical counts: elements labelled by the first expression that they match, nested by matched ancestors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compile import _compare, attribute_value, has_attribute, select
from ..plans.selector import Selector
from .corpus import Corpus
from .filter import Filter

_STYLES = ("HtmlFmt", "CssFmt", "CssTerse")
_PART = re.compile(r"\[\s*([\w-]+)\s*(?:([\^$*~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")


class Expression:
    """`css => Format[attribute]...@words`."""

    def __init__(self, source: str):
        css, arrow, form = source.partition("=>")
        if not arrow:
            raise ValueError("missing '=>'")
        self.selector, form = Selector(css.strip()), form.strip()
        self.style = next((s for s in _STYLES if form.startswith(s)), None)
        if not self.style:
            raise ValueError(f"no format in {form!r}")
        at, self.parts = len(self.style), []
        while m := _PART.match(form, at):
            self.parts.append((m[1].lower(), m[2], next((g for g in m.groups()[2:] if g is not None), "")))
            at = m.end()
        self.words = form[at:] == "@words"
        if form[at:] not in ("", "@words"):
            raise ValueError(f"unexpected {form[at:]!r}")

    def label(self) -> Column:
        """The element as text; the column _text must hold its text where a part asks for it."""
        html, terse = self.style == "HtmlFmt", self.style == "CssTerse"
        classes, others = [], []
        for name, op, want in self.parts:
            if name == "class":
                own = F.coalesce("classes", F.array().cast("array<string>"))
                if op:
                    own = F.filter(own, _class_test(op, want))
                classes.append(F.array_join(own, " ") if html else F.array_join(F.transform(own, lambda c: F.concat(F.lit("."), c)), ""))
                if not html:
                    others.append(classes[-1])
                continue
            value = F.nullif(F.col("_text"), F.lit("")) if name == "text" else attribute_value(name)
            ok = value.isNotNull() if name == "text" else has_attribute(name)
            if op:
                ok = ok & F.coalesce(_compare(value, op, want, False, prose=name == "text"), F.lit(False))
            if html:
                said = F.concat(F.lit(f" {name}='"), value, F.lit("'"))
            elif name == "id":
                said = F.concat(F.lit("#"), value)
            else:
                said = F.concat(F.lit("['" if terse else f"[{name}='"), value, F.lit("']"))
            others.append(F.when(ok, said).otherwise(""))
        if html:
            own = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in classes)) if classes else F.lit("")
            return F.concat(F.lit("<"), F.col("tag"), F.when(own != "", F.concat(F.lit(" class='"), own, F.lit("'"))).otherwise(""), *others, F.lit(">"))
        return F.concat(F.col("tag"), *others)


def _class_test(op: str, want: str):
    return lambda c: _compare(c, op, want, False)


def matches(corpus: Corpus, expressions: Iterable[Expression | str], keep: Filter | None = None) -> DataFrame:
    """(pos, key, idx, end_idx, label, words) of labelled elements."""
    own = [e if isinstance(e, Expression) else Expression(e) for e in expressions]
    found = None
    for i, e in enumerate(own):
        rows = select(corpus.nodes, e.selector).select("pos", "key", "idx", "end_idx", "tag", "id", "classes", "attrs")
        rows = corpus.texts(rows, "_text") if any(name == "text" for name, _, _ in e.parts) else rows.withColumn("_text", F.lit(""))
        rows = rows.select("pos", "key", "idx", "end_idx", F.lit(i).alias("rank"), e.label().alias("label"), F.lit(e.words).alias("words"))
        found = rows if found is None else found.union(rows)
    first = found.groupBy("pos", "key", "idx", "end_idx").agg(F.min_by(F.struct("label", "words"), "rank").alias("m")).select("pos", "key", "idx", "end_idx", "m.label", "m.words")
    return first if keep is None else first.join(keep.apply(corpus.docs, corpus.nodes).select("pos"), "pos", "left_semi")


def probe(corpus: Corpus, expressions: Iterable[Expression | str], keep: Filter | None = None) -> DataFrame:
    """(path array<string>, n, keys, first): elements by the labels from the outermost matched element down.

    keys: of the pages, in archive order, only where @words asks for them; first: place of the first element. Counts are sums by path, so neither the
    order of pages nor their division matters.
    """
    own = matches(corpus, expressions, keep)
    a = own.select(F.col("pos").alias("a_pos"), F.col("idx").alias("a_idx"), F.col("end_idx").alias("a_end"), F.col("label").alias("a_label"))
    around = (F.col("pos") == F.col("a_pos")) & (F.col("a_idx") <= F.col("idx")) & (F.col("idx") < F.col("a_end"))
    paths = own.join(a, around).groupBy("pos", "key", "idx", "words").agg(F.sort_array(F.collect_list(F.struct("a_idx", "a_label"))).alias("up"))
    path = F.transform("up", lambda x: x["a_label"]).alias("path")
    pages = F.sort_array(F.collect_set(F.when(F.col("words"), F.struct("pos", "key"))))
    return paths.select("pos", "key", "idx", "words", path).groupBy("path").agg(F.count("*").alias("n"), F.transform(pages, lambda x: x["key"]).alias("keys"), F.min(F.struct("pos", "idx")).alias("first"))


_DIGITS = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
_LETTERS = dict(zip("0123456789abcdef", "ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖ", strict=True))


def rendered(rows: DataFrame) -> str:
    """The counts of probe() as an indented tree in order of first appearance: depth as a raised letter, label, raised count, [keys]; paths are few, whatever the corpus."""
    found = {tuple(r["path"]): r for r in rows.collect()}
    out = []
    for path in sorted(found, key=lambda p: [tuple(found[p[:k]]["first"]) for k in range(1, len(p) + 1)]):
        depth, r = len(path) - 1, found[path]
        letter = "".join(_LETTERS[c] for c in f"{depth:x}")
        out.append("  " * depth + letter + path[-1] + str(r["n"]).translate(_DIGITS) + (f"[{','.join(r['keys'])}]" if r["keys"] else ""))
    return "\n".join(out)
