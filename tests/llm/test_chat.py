import hashlib
import random

from pyspark.sql import functions as F

from tagloom.llm import chat, queries

from .util import collected

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|im_start|>", "<|endoftext|>", "\\", "<", "[", "\n", "é", "x", "|>", "<\\|im_end|>", "s>"]


def test_escape_is_undone_and_leaves_no_control_string(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices(PARTS, k=rng.randrange(7))), "".join(rng.choices(PARTS, k=3))) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "text string, role string")
    bad = frame.where((chat.unescaped(chat.escaped(F.col("text"))) != F.col("text")) | (chat.unescaped_role(chat.escaped_role(F.col("role"))) != F.col("role")))
    assert collected(bad) == []
    left = frame.select(chat.escaped(F.col("text")).alias("e")).where(r"e rlike '<[|]im_(start|end)[|]>|</?s>|\\[/?INST\\]|<</?SYS>>'")
    assert collected(left) == []


def test_fold_of_streams_edits_and_regenerations(spark):
    events = [
        (1, 1, "message", None, "user", "Hi"), (1, 2, "message", None, "assistant", ""), (1, 3, "delta", 2, None, "Hel"), (1, 4, "delta", 2, None, "lo"),
        (1, 5, "message", None, "user", "again"), (1, 6, "message", None, "assistant", "no"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "Bye"),
        (1, 9, "edit", 1, None, "Hey"), (1, 10, "delta", 1, None, "!"), (1, 11, "message", None, "user", "last"), (1, 12, "delta", 99, None, "lost"), (1, 13, "other", 1, None, "x"),
        (None, 1, "message", None, None, None), (2, 1, "delta", 1, None, "never opened"),
    ]
    got = chat.folded(spark.createDataFrame(events, "conv_id long, seq long, op string, message long, role string, text string"))
    rows = sorted(((r["conv_id"] or 0, r["message"], r["role"], r["text"]) for r in collected(got)), key=str)
    assert rows == [(0, 1, None, ""), (1, 1, "user", "Hey!"), (1, 11, "user", "last"), (1, 2, "assistant", "Bye")]


def test_messages_of_one_seq_are_one(spark):
    events = [(1, 1, "message", None, "user", "b"), (1, 1, "message", None, "user", "a"), (1, 2, "delta", 1, None, "!")]
    got = chat.folded(spark.createDataFrame(events, "conv_id long, seq long, op string, message long, role string, text string"))
    assert [(r["conv_id"], r["message"], r["role"], r["text"]) for r in collected(got)] == [(1, 1, "user", "b!")]


def python_digest(rows):
    rows = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1] or "", r[2] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_reads_back_what_went_in(spark, tmp_path):
    rows = [
        (0, 0, "user", "a\nb"), (0, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (0, 1, "assistant", None), (0, None, None, "no turn"), (0, 1, "assistant", None),
        (None, 3, "assistant", "null id"), (7, 0, "assistant\nuser", "role \\n"), (8, 0, "system", "😀" * 1000), (9, 0, "assistant", ""), (9, 1, "user", "<|im_end|"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in collected(queries.op4_chat_format(spark, str(tmp_path)))}
    own = {c: [(t, r, x) for i, t, r, x in rows if i == c] for c in {r[0] for r in rows}}
    own[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert got == {c: python_digest(v) for c, v in own.items()}


def test_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert collected(chat.read_back(chat.formatted(chat.folded(chat.events_of(none))))) == []
