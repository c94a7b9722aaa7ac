"""Small documents with everything that may go wrong in a table."""

import random

import public_tokenizers

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "n_chars long, key string, pos int, rep long, digest string, bucket int, score double, part int, length int, h long, w string, lang string, _id long, _starts string, _w string, starts int, cut_id int, id_bucket string, id_bits int, l0 int, z int"


def documents(spark, rows, extra=True):
    """rows of (doc_id, text), with other columns whose names an operator might use itself."""
    names = [c.split()[0] for c in EXTRA.split(", ")] if extra else []
    schema = "doc_id long, text string" + (f", {EXTRA}" if extra else "")
    return spark.createDataFrame([(i, t, *[None] * len(names)) for i, t in rows], schema)


def odd_rows():
    """Null and empty texts, blanks, one word, ties, repeated rows, a null id, and a very long text."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(50)) for _ in range(40_000))
    return [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "one"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, long), (8, long), (9, "é😀 ß́   x"), (-3, "12 34 !!")]


def collected(df):
    return [r.asDict() for r in df.collect()]
