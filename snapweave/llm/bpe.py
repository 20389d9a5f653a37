"""BPE encoding and decoding of whole texts.

Merging follows a segment tree over the adjacent pairs of a word: each leaf
holds ``rank << 16 | position`` of the pair that starts there, every inner node
the least of its children, so the root is the leftmost pair of lowest rank. A
merge changes three leaves, each in logarithmic time, until the root says that
no pair can be merged. Words of up to 64 bytes are merged many at a time, with
one tree per row of a numpy matrix; longer ones have a tree of their own.

A text is cut at single spaces between two non-space characters, where the
pre-tokenizer always cuts as well. What a word of up to ``LONG`` characters becomes is
kept in a dictionary of at most ``MEMO`` entries per Python worker, so memory doesn't
grow with the vocabulary; longer ones are forgotten after the texts they stand in.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from snapweave.llm._common import chunks

MEMO, LONG = 300_000, 48
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_RARE = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NONE = np.iinfo(np.int64).max


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = _byte_chars()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in back.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.new_id = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i] << 16 | at, _NONE)

    def _merge_many(self, words: list[bytes], width: int) -> list[list[int]]:
        """Words of at most ``width`` bytes (a power of two), one segment tree per row."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, words), np.int64, n)
        tok = np.zeros((n, width + 1), np.int64)
        tok[:, :width] = self.byte_id[raw]
        cols = np.arange(width)
        nxt = np.tile(np.arange(1, width + 2), (n, 1))
        nxt[:, :width][cols[None] + 1 >= size[:, None]] = width
        prv = np.tile(np.arange(-1, width), (n, 1))
        alive = cols[None] < size[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        has = np.nonzero(cols[None] + 1 < size[:, None])
        tree[has[0], width + has[1]] = self._leaf(tok[has], tok[has[0], has[1] + 1], has[1])
        node = width
        while node > 1:
            tree[:, node // 2 : node] = tree[:, node : 2 * node].reshape(n, -1, 2).min(axis=2)
            node //= 2
        flat, tf, nf, pf = tree.reshape(-1), tok.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        row = np.nonzero(tree[:, 1] != _NONE)[0]
        while len(row):
            base, wide = row * (2 * width), row * (width + 1)
            root = flat[base + 1]
            i = root & 0xFFFF
            j = nf[wide + i]
            k = nf[wide + j]
            p = pf[wide + i]
            new = self.new_id[root >> 16]
            tf[wide + i] = new
            nf[wide + i] = k
            pf[wide + k] = i
            alive[row, j] = False
            right = np.where(k < width, self._leaf(new, tf[wide + k], i), _NONE)
            flat[base + width + j] = _NONE
            flat[base + width + i] = right
            q = np.maximum(p, 0)
            left = np.where(p >= 0, self._leaf(tf[wide + q], new, q), flat[base + width + q])
            flat[base + width + q] = left
            for leaf in (i, j, q):
                node = (width + leaf) >> 1
                while node[0]:
                    flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
                    node = node >> 1
            row = row[flat[base + 1] != _NONE]
        ids = tok[:, :width][alive].tolist()
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_long(self, word: bytes) -> list[int]:
        """One word of any length, with a segment tree in a flat list."""
        n = len(word)
        tok = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        width = 1 << max(1, (n - 1).bit_length())
        none, rank = 1 << 62, self.rank_of
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank.get(tok[i] << 20 | tok[i + 1])
            if r is not None:
                tree[width + i] = r << 32 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            if tree[i] == value:
                return
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least
                i >>= 1

        def leaf(a: int, b: int) -> int:
            r = rank.get(tok[a] << 20 | tok[b])
            return none if r is None else r << 32 | a

        while (root := tree[1]) != none:
            i = root & 0xFFFFFFFF
            j = nxt[i]
            k, p = nxt[j], prv[i]
            tok[i], nxt[i], tok[j] = int(self.new_id[root >> 32]), k, -1
            put(j, none)
            if k < n:
                prv[k] = i
                put(i, leaf(i, k))
            else:
                put(i, none)
            if p >= 0:
                put(p, leaf(p, i))
        return [t for t in tok if t >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-tokenized word."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (2, 4, 8, 16, 32, 64):
            at = np.nonzero((size > low) & (size <= width))[0].tolist()
            for start in range(0, len(at), 65536 // width):
                part = at[start : start + 65536 // width]
                for i, ids in zip(part, self._merge_many([words[i] for i in part], width)):
                    out[i] = ids
            low = width
        for i in np.nonzero(size > 64)[0].tolist():
            out[i] = self._merge_long(words[i])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, which may hold several pre-tokens."""
        words: dict[str, int] = {}
        cut = [[words.setdefault(w, len(words)) for w in _PRE.findall(p)] for p in pieces]
        ids = self.merge([w.encode() for w in words])
        return [ids[c[0]] if len(c) == 1 else [i for w in c for i in ids[w]] for c in cut]


@functools.cache
def load(path: str) -> Bpe:
    return Bpe(path)


class Memo:
    """What words became so far: (ids as text, number of ids, decoded text, ids)."""

    def __init__(self, bpe: Bpe, keep_ids: bool) -> None:
        self.bpe, self.keep = bpe, keep_ids
        self.known: dict[str, tuple] = {}
        self.passing: list[str] = []

    def learn(self, pieces: Iterable[str]) -> None:
        for p in self.passing:
            self.known.pop(p, None)
        new = set(pieces).difference(self.known)
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = set(pieces)
        new = list(new)
        self.passing = [p for p in new if len(p) > LONG]
        for piece, ids in zip(new, self.bpe.pieces(new)):
            said = self.bpe.decode(ids)
            self.known[piece] = (",".join(map(str, ids)), len(ids), piece if said == piece else said, ids if self.keep else None)

    def cut(self, text: str) -> list[str]:
        """Pieces of a text without special tokens that join to it and that the pre-tokenizer never crosses."""
        if " " not in text:
            return [text] if text else []
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _RARE.search(text):
            return _PRE.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]]


def _encoded(path: str, keep_ids: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    memo = Memo(bpe, keep_ids)
    for keys, texts in chunks(batches, 1, 1 << 20):
        cut = []
        for t in texts:
            t = t or ""
            if bpe.special is None or not bpe.special.search(t):
                cut.append(([memo.cut(t)], []))
            else:
                cut.append(([memo.cut(s) for s in bpe.special.split(t)], bpe.special.findall(t)))
        memo.learn({p for segs, _ in cut for seg in segs for p in seg})
        known = memo.known
        rows = []
        for segs, marks in cut:
            said, n, ids, back = [], 0, [], []
            for k, seg in enumerate(segs):
                if k:
                    mark = marks[k - 1]
                    said.append(str(bpe.added[mark]))
                    ids.append([bpe.added[mark]])
                    back.append(bpe.decode([bpe.added[mark]]))
                    n += 1
                if seg:
                    s, m, d, i = zip(*map(known.__getitem__, seg))
                    said.extend(s)
                    back.extend(d)
                    n += sum(m)
                    if keep_ids:
                        ids.extend(i)
            text = "".join(back)
            row = (n, hashlib.sha256(",".join(said).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            rows.append((*row, [x for i in ids for x in i], text) if keep_ids else row)
        n, a, b, *more = zip(*rows)
        arrays = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            arrays += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1])]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per input row: token count and digests of the ids and of the decoded text; with ``keep_ids`` also ``ids array<int>`` and ``decoded``.

    ``path``: a tokenizers JSON file with a byte-level BPE, present on every executor.
    A null or empty text has no ids and decodes to an empty text; a null id stays null;
    repeated rows give repeated results. Other columns are ignored. Special tokens
    spelled out in a text become their own id, as the library does.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(functools.partial(_encoded, path, keep_ids), schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; unknown ids are left out, broken UTF-8 becomes U+FFFD, a null list an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(i for i in (ids or []) if i in bpe.bytes) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
