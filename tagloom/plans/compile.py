"""Selectors to DataFrame plans over the nodes table.

A compound without nested combinators is one boolean column, pushed into the scan as far as Parquet takes it. Combinators are
left-semi joins from candidates to a slim set of (pos, idx, ...) rows, so no row is ever produced twice and nothing backtracks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import CASELESS
from .selector import Attribute, Complex, Compound, Pseudo, Selector

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["pos", "idx"]


def folded(c: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def attribute_value(name: str) -> Column:
    """First value of an attribute; the tokens joined by single spaces for class."""
    if name.lower() == "class":
        return F.array_join("classes", " ")
    if name.lower() == "id":
        return F.col("id")
    return F.get(F.filter("attrs", lambda a: a["name"] == name.lower()), 0)["value"]


def has_attribute(name: str) -> Column:
    if name.lower() == "class":
        return F.col("classes").isNotNull()
    if name.lower() == "id":
        return F.col("id").isNotNull()
    return F.coalesce(F.exists("attrs", lambda a: a["name"] == name.lower()), F.lit(False))


def _compare(value: Column, op: str, want: str, caseless: bool, prose: bool = False) -> Column:
    if caseless:
        value, want = (F.lower(value), want.lower()) if prose else (folded(value), want.translate(str.maketrans(_UPPER, _LOWER)))
    if op in ("^=", "$=", "*=") and not want:
        return F.lit(prose)
    if op == "=":
        return value == want
    if op == "^=":
        return value.startswith(want)
    if op == "$=":
        return value.endswith(want)
    if op == "*=":
        return value.contains(want)
    if op == "|=":
        return (value == want) | value.startswith(want + "-")
    return F.array_contains(F.split(value, r"(?U)\s+" if prose else r"[ \t\n\f\r]+"), want) & F.lit(bool(want))


def _attribute(a: Attribute) -> Column:
    if a.op is None:
        return has_attribute(a.name)
    if a.name == "class" and a.op == "~=" and a.flag != "i":
        return F.array_contains("classes", a.value)
    caseless = a.flag == "i" or (a.flag is None and a.name in CASELESS)
    return _compare(attribute_value(a.name), a.op, a.value, caseless)


def ordinal(place: Column, step: int, offset: int) -> Column:
    if step == 0:
        return place == offset
    away = place - offset
    return (away % abs(step) == 0) & ((away >= 0) if step > 0 else (away <= 0))


def _static(p: Pseudo) -> Column:
    c = F.col
    return {
        "root": lambda: c("parent") == 0,
        "empty": lambda: c("n_child_el") == 0,
        "first-child": lambda: c("sib_ord") == 1,
        "last-child": lambda: c("sib_rev") == 1,
        "only-child": lambda: (c("sib_ord") == 1) & (c("sib_rev") == 1),
        "first-of-type": lambda: c("type_ord") == 1,
        "last-of-type": lambda: c("type_rev") == 1,
        "only-of-type": lambda: (c("type_ord") == 1) & (c("type_rev") == 1),
        "nth-child": lambda: ordinal(c("sib_ord"), p.step, p.offset),
        "nth-last-child": lambda: ordinal(c("sib_rev"), p.step, p.offset),
        "nth-of-type": lambda: ordinal(c("type_ord"), p.step, p.offset),
        "nth-last-of-type": lambda: ordinal(c("type_rev"), p.step, p.offset),
    }[p.name]()


def is_local(x: tuple | Complex | Compound) -> bool:
    """Whether one row says if it matches."""
    if isinstance(x, tuple):
        return all(map(is_local, x))
    if isinstance(x, Complex):
        return len(x.compounds) == 1 and is_local(x.compounds[0])
    return all(a.name != "text" for a in x.attributes) and all(p.name != "has" and is_local(p.inner) for p in x.pseudos)


def _tests(c: Compound) -> list[Column]:
    """Conjuncts on an element's row, cheap and pushable ones first. Null means no; where one is negated, null is made false first."""
    own = [F.col("tag") == c.tag] if c.tag else []
    own += [F.col("id") == i for i in c.ids]
    own += [F.array_contains("classes", x) for x in c.classes]
    own += [_attribute(a) for a in c.attributes if a.name != "text"]
    for p in c.pseudos:
        if not p.inner:
            own.append(_static(p))
        elif p.name != "has" and is_local(p.inner):
            inner = _any(p.inner)
            own.append(~F.coalesce(inner, F.lit(False)) if p.name == "not" else inner)
    return own


def _any(alternatives: tuple[Complex, ...]) -> Column:
    """Whether an element's row matches one of them: plain types as one IN, which Parquet takes."""
    own = [_tests(x.compounds[0]) for x in alternatives]
    types = [x.compounds[0].tag for x, tests in zip(alternatives, own, strict=True) if x.compounds[0].tag and len(tests) == 1]
    rest = [reduce(lambda a, b: a & b, t or [F.lit(True)]) for x, t in zip(alternatives, own, strict=True) if not (x.compounds[0].tag and len(t) == 1)]
    plain = [F.col("tag").isin(types) if len(types) > 1 else F.col("tag") == types[0]] if types else []
    return reduce(lambda a, b: a | b, plain + rest)


def local_column(c: Compound) -> Column:
    """What of a compound one row can say."""
    return reduce(lambda a, b: a & b, [F.col("kind") == "element", *_tests(c)])


def local_list(alternatives: tuple[Complex, ...]) -> Column:
    return (F.col("kind") == "element") & _any(alternatives)


def _with_text(nodes: DataFrame, candidates: DataFrame, a: Attribute) -> DataFrame:
    """(pos, idx) of candidates whose whole text, scripts included, satisfies a."""
    texts = nodes.where("kind = 'text'").select("pos", F.col("idx").alias("t_idx"), F.col("text").alias("t_text"))
    inside = (F.col("t_idx") > F.col("idx")) & (F.col("t_idx") < F.col("end_idx"))
    own = candidates.select("pos", "idx", "end_idx").alias("c").join(texts.alias("t"), (F.col("c.pos") == F.col("t.pos")) & inside, "left")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("t_idx").isNotNull(), F.struct("t_idx", "t_text")))), lambda x: x["t_text"]), "")
    whole = own.groupBy(F.col("c.pos").alias("pos"), F.col("idx")).agg(said.alias("_said"))
    test = F.col("_said") != "" if a.op is None else _compare(F.col("_said"), a.op, a.value, a.flag == "i", prose=True)
    return whole.where(test).select("pos", "idx")


def _related(rows: DataFrame, comb: str, left: DataFrame) -> DataFrame:
    """The rows that stand to the right of some element of `left` by a combinator."""
    r, k = rows.alias("r"), left
    if comb == ">":
        k = k.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.parent") == F.col("k_idx")), "left_semi")
    if comb == "+":
        k = k.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.prev_el") == F.col("k_idx")), "left_semi")
    if comb == "~":
        k = k.groupBy(F.col("pos").alias("k_pos"), F.col("parent").alias("k_parent")).agg(F.min("sib_ord").alias("k_ord"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.parent") == F.col("k_parent")) & (F.col("r.sib_ord") > F.col("k_ord")), "left_semi")
    # Of nested intervals the outermost will do: there are far fewer, and they don't overlap.
    before = Window.partitionBy("pos").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    k = k.select("pos", "idx", "end_idx").withColumn("_reach", F.max("end_idx").over(before)).where("_reach IS NULL OR idx >= _reach")
    k = k.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"), F.col("end_idx").alias("k_end"))
    return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.idx") > F.col("k_idx")) & (F.col("r.idx") < F.col("k_end")), "left_semi")


def _leading(rows: DataFrame, comb: str, right: DataFrame) -> DataFrame:
    """The rows that stand to the left of some element of `right` by a combinator."""
    r = rows.alias("r")
    if comb == ">":
        k = right.select(F.col("pos").alias("k_pos"), F.col("parent").alias("k_idx"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.idx") == F.col("k_idx")), "left_semi")
    if comb == "+":
        k = right.select(F.col("pos").alias("k_pos"), F.col("prev_el").alias("k_idx"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.idx") == F.col("k_idx")), "left_semi")
    if comb == "~":
        k = right.groupBy(F.col("pos").alias("k_pos"), F.col("parent").alias("k_parent")).agg(F.max("sib_ord").alias("k_ord"))
        return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("r.parent") == F.col("k_parent")) & (F.col("r.sib_ord") < F.col("k_ord")), "left_semi")
    k = right.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"))
    return r.join(k, (F.col("r.pos") == F.col("k_pos")) & (F.col("k_idx") > F.col("r.idx")) & (F.col("k_idx") < F.col("r.end_idx")), "left_semi")


def _compound(nodes: DataFrame, c: Compound, rows: DataFrame | None = None) -> DataFrame:
    """Rows (of nodes, or of some of them) that match a compound."""
    out = (nodes if rows is None else rows).where(local_column(c))
    for a in c.attributes:
        if a.name == "text":
            out = out.join(_with_text(nodes, out, a), _KEYS, "left_semi")
    for p in c.pseudos:
        if p.name == "has":
            found = [_has(nodes, out, x) for x in p.inner]
            out = found[0] if len(found) == 1 else out.join(reduce(DataFrame.union, (x.select(*_KEYS) for x in found)), _KEYS, "left_semi")
        elif p.inner and not is_local(p.inner):
            inner = reduce(DataFrame.union, (_complex(nodes, x, out).select(*_KEYS) for x in p.inner))
            out = out.join(inner, _KEYS, "left_anti" if p.name == "not" else "left_semi")
    return out


def _has(nodes: DataFrame, rows: DataFrame, x: Complex) -> DataFrame:
    right = _compound(nodes, x.compounds[-1])
    for c, comb in zip(x.compounds[-2::-1], x.combinators[:0:-1], strict=True):
        right = _leading(_compound(nodes, c), comb, right)
    return _leading(rows, x.combinators[0], right)


def _complex(nodes: DataFrame, x: Complex, rows: DataFrame | None = None) -> DataFrame:
    """Rows that match a complex selector; rows limits where its last compound is looked for."""
    last = len(x.compounds) - 1
    out = _compound(nodes, x.compounds[0], rows if not last else None)
    for k, (comb, c) in enumerate(zip(x.combinators, x.compounds[1:], strict=True), 1):
        out = _related(_compound(nodes, c, rows if k == last else None), comb, out)
    return out


def select(nodes: DataFrame, selector: Selector | str) -> DataFrame:
    """The rows of nodes that match, each once, in no set order."""
    own = Selector.of(selector).alternatives
    if is_local(own):
        return nodes.where(local_list(own) if len(own) > 1 else local_column(own[0].compounds[0]))
    if len(own) == 1:
        return _complex(nodes, own[0])
    plain = tuple(x for x in own if is_local(x))
    found = [_complex(nodes, x).select(*_KEYS) for x in own if not is_local(x)]
    if plain:
        found.append(nodes.where(local_list(plain)).select(*_KEYS))
    return nodes.where("kind = 'element'").join(reduce(DataFrame.union, found), _KEYS, "left_semi")
