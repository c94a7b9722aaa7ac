"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i holds the rank of the pair of symbol i and its next, with i as the lower digits; the root so yields the leftmost
pair of the lowest rank. A merge changes three leaves, each renewed along its path to the root. Words of up to 64 symbols
are done many at a time, a tree each, as rows of one array; longer ones singly.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_NONE = np.int64(2**62)
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split(), not to the tokenizer


class SegmentTree:
    """Least of a row of keys, with point updates in logarithmic time."""

    def __init__(self, keys: list[int]):
        self.width = 1
        while self.width < max(1, len(keys)):
            self.width *= 2
        self.tree = [int(_NONE)] * self.width + list(keys) + [int(_NONE)] * (self.width - len(keys))
        for i in range(self.width - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def root(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        at += self.width
        self.tree[at] = key
        while at > 1:
            at //= 2
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])


class WordBpe:
    """A tokenizer file of lower-cased words with word ends, as the tokenizers library reads it (no special tokens added)."""

    def __init__(self, path: str, most: int = 250_000):
        file = json.loads(open(path, encoding="utf-8").read())
        model = file["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = [0] * 256
        for c in signs:
            sign[c] = chr(c)
        for i, c in enumerate(c for c in range(256) if c not in signs):
            sign[c] = chr(256 + i)
        self.inner = np.array([vocab[c] for c in sign], np.int64)
        self.last = np.array([vocab[c + self.end] for c in sign], np.int64)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = {i: w.encode() for w, i in (vocab | self.special).items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.most = most
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.elder: dict[str, tuple[bytes, bytes]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or _NONE."""
        own = a << 20 | b
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == own, self.ranks[at], _NONE)

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The tokens of one word of any length."""
        sym, n = list(symbols), len(symbols)
        nxt, prv = [*range(1, n), n], [*range(-1, n - 1)]
        x = np.array(sym)
        ranks = self.rank(x[:-1], x[1:]).tolist()
        shift = max(1, n).bit_length()
        tree = SegmentTree([(r << shift | i) if r < _NONE else int(_NONE) for i, r in enumerate(ranks)])
        table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True)) if n > 10_000 else None

        def key(i: int) -> int:
            j = nxt[i]
            if j >= n:
                return int(_NONE)
            r = table.get(sym[i] << 20 | sym[j], int(_NONE)) if table else int(self.rank(np.array([sym[i]]), np.array([sym[j]]))[0])
            return r << shift | i if r < _NONE else int(_NONE)

        while (top := tree.root()) < _NONE:
            i = top & ((1 << shift) - 1)
            j = nxt[i]
            sym[i], nxt[i] = int(self.merged[top >> shift]), nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            sym[j] = -1
            if j < tree.width:
                tree.put(j, int(_NONE))
            tree.put(i, key(i))
            if prv[i] >= 0:
                tree.put(prv[i], key(prv[i]))
        return [s for s in sym if s >= 0]

    def merge_many(self, words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words of at most `width` symbols, a power of two, and where each word's end; row r of the arrays is word r and its tree."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        place = np.arange(width)
        inside = place < lengths[:, None]
        sym = np.full((n, width), -1, np.int64)
        sym[inside] = np.concatenate(words)
        nxt = np.broadcast_to(place + 1, (n, width)).copy()
        prv = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pair = place[:-1] + 1 < lengths[:, None]
        r, c = np.nonzero(pair)
        ranks = self.rank(sym[r, c], sym[r, c + 1])
        tree[r, width + c] = np.where(ranks < _NONE, ranks * width + c, _NONE)
        size = width
        while size > 1:
            tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size //= 2

        def put(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
            at = at + width
            tree[rows, at] = keys
            while at[0] > 1:  # all paths have the same length
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def renew(rows: np.ndarray, at: np.ndarray) -> None:
            if not len(rows):
                return
            to = nxt[rows, at]
            pair = to < lengths[rows]
            ranks = np.where(pair, self.rank(sym[rows, at], sym[rows, np.where(pair, to, 0)]), _NONE)
            put(rows, at, np.where(ranks < _NONE, ranks * width + at, _NONE))

        rows = np.arange(n)
        while True:
            top = tree[rows, 1]
            rows, top = rows[top < _NONE], top[top < _NONE]
            if not len(rows):
                break
            i = top % width
            j = nxt[rows, i]
            sym[rows, i] = self.merged[top // width]
            to = nxt[rows, j]
            nxt[rows, i] = to
            sym[rows, j] = -1
            has = to < lengths[rows]
            prv[rows[has], to[has]] = i[has]
            put(rows, j, np.full(len(rows), _NONE))
            renew(rows, i)
            back = prv[rows, i]
            renew(rows[back >= 0], back[back >= 0])
        keep = sym >= 0
        return sym[keep], np.cumsum(keep.sum(axis=1))

    def learn(self, words: Iterable[str]) -> None:
        """Encode words, so that known has their ids and their tokens' strings."""
        todo: dict[int, list[tuple[str, np.ndarray]]] = {}
        for w in words:
            raw = np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)
            ids = self.inner[raw]
            ids[-1] = self.last[raw[-1]]
            if len(ids) > 64:
                own = np.array(self.merge_one(ids.tolist()), "<u4").tobytes()
                self.known[w] = own, self.decode(own)
            else:
                todo.setdefault(max(2, 1 << (len(ids) - 1).bit_length()), []).append((w, ids))
        for width, some in todo.items():
            for at in range(0, len(some), 8192):
                part = some[at : at + 8192]
                flat, ends = self.merge_many([x for _, x in part], width)
                raw, said = flat.astype("<u4").tobytes(), list(map(self.names.__getitem__, flat.tolist()))
                a = 0
                for (w, _), b in zip(part, ends.tolist(), strict=True):
                    self.known[w] = raw[4 * a : 4 * b], b" ".join(said[a:b])
                    a = b

    def normalized(self, text: str) -> str:
        """NFC, then letters lowered one by one; white space is left to the split."""
        x = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return (x.replace("Σ", "σ") if "Σ" in x else x).lower()

    def decode(self, ids: bytes) -> bytes:
        """The file names no decoder: tokens joined by spaces, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of each text.

        No word spans white space, so normalized texts are cut there, and each distinct piece is encoded once for as long
        as it is remembered. Two generations of at most `most` pieces are: what the younger lacks is taken over from the elder.
        """
        cut = []
        for text in texts:
            pieces: list[str] = []
            at = 0
            spots = list(self.specials.finditer(text)) if "<|" in text else []
            for m in [*spots, None]:
                part = self.normalized(text[at : m.start()] if m else text[at:] if at else text)
                pieces += [x for x in _SPACE.split(part) if x] if _ODD.search(part) else part.split()
                if m:
                    pieces.append("\ud800" + m[0])  # a mark that no text has: a special string, not a piece like it
                    at = m.end()
            cut.append(pieces)
        known, words = self.known, {}
        for p in set().union(*cut).difference(known):
            if p in self.elder:
                known[p] = self.elder[p]
            elif p[0] == "\ud800":
                ids = np.uint32(self.special[p[1:]]).tobytes()
                known[p] = ids, self.decode(ids)
            else:
                words[p] = [p] if p.isalpha() else self.words.findall(p)
        self.learn({w for own in words.values() for w in own if w not in known})
        for p, own in words.items():
            if p not in known:
                parts = [known[w] for w in own]
                known[p] = b"".join([x for x, _ in parts]), b" ".join([x for _, x in parts])
        for pieces in cut:
            found = list(map(known.__getitem__, pieces))
            yield b"".join([x for x, _ in found]), b" ".join([x for _, x in found])
        if len(known) > self.most:
            self.elder, self.known = known, {}


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_tokens long, ids binary: little-endian unsigned 32-bit, decoded string).

    Null text: as "", no ids. Every row of docs gives a row, repeated rows and null doc_ids too; other columns are ignored;
    an empty table gives no rows. The tokenizer's path must be readable on executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer)
        for batch in batches:
            at = 0
            sizes = [len(x.as_buffer() or b"") for x in batch.column("text")]
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size + sizes[to] <= 1_000_000):
                    size += sizes[to]
                    to += 1
                own = batch.slice(at, to - at)
                ids, said = zip(*bpe.encode_batch([x or "" for x in own.column("text").to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(said, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
