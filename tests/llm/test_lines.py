import random

from pyspark.sql import functions as F

from tagloom.llm.lines import without_repeated_lines

from .util import collected, documents, odd_rows


def brute(rows):
    seen, cut = {}, {}
    split = {i: t.split("\n") for i, t in rows if i is not None and t is not None}
    for i in sorted(split):
        for p in range(len(split[i]) - 2):
            w = tuple(split[i][p : p + 3])
            if "".join(x.strip(" ") for x in w):
                if w in seen:
                    cut.setdefault(i, set()).update((p, p + 1, p + 2))
                seen.setdefault(w, (i, p))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, None, 0))
        else:
            own = t.split("\n")
            left = [x for p, x in enumerate(own) if i is None or p not in cut.get(i, ())]
            out.append((i, "\n".join(left), len(own), len(own) - len(left)))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in collected(without_repeated_lines(frame))), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d"]) for _ in range(rng.randrange(12)))) for i in rng.sample(range(500), 120)]
    rows += [(1000 + i, "x\ncommon 1\ncommon 2\ncommon 3\ncommon 4\n" + str(i)) for i in range(40)]
    assert result(documents(spark, rows)) == brute(rows)


def test_overlaps_and_blanks(spark):
    rows = [(1, "a\na\na\na\na"), (2, "\n\n\n\n\n"), (3, "\n\n\n\n\n"), (4, "p\nq\nr\ns"), (5, "q\nr\ns\nz"), (6, "p\nq\nr")]
    got = {r[0]: (r[1], r[3]) for r in result(documents(spark, rows))}
    assert got == {1: ("a", 4), 2: ("\n\n\n\n\n", 0), 3: ("\n\n\n\n\n", 0), 4: ("p\nq\nr\ns", 0), 5: ("z", 3), 6: ("", 3)}


def test_odd_rows_keep_other_columns(spark):
    frame = documents(spark, odd_rows())
    out = without_repeated_lines(frame)
    assert out.columns == [*frame.columns, "n_lines", "n_removed"]
    assert result(frame) == brute(odd_rows()) and result(documents(spark, [])) == []


def test_a_very_common_passage_and_clashing_names(spark):
    """A passage in most documents meets its occurrences by broadcast; names that differ in case from the new columns are replaced."""
    rows = [(i, f"{i}\nsame 1\nsame 2\nsame 3\n{i % 7}\nend\n.") for i in range(400)] + [(None, "same 1\nsame 2\nsame 3")]
    assert result(documents(spark, rows)) == brute(rows)
    frame = documents(spark, rows).withColumn("N_Lines", F.lit("x")).withColumn("first", F.lit(1)).withColumn("pos", F.lit("p")).withColumn("a.b", F.lit(2))
    out = without_repeated_lines(frame)
    assert out.columns == [*(c for c in frame.columns if c != "N_Lines"), "n_lines", "n_removed"]
    assert {(r["first"], r["pos"], r["a.b"]) for r in collected(out)} == {(1, "p", 2)}
