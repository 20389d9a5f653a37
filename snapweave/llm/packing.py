"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. The rests' lengths,
in units of ``grain`` ids, make a histogram of at most ``capacity / grain`` bins
(its size doesn't depend on the data). The driver solves the cutting-stock
linear program over that histogram: patterns are columns, a knapsack dynamic
programme prices new ones under the duals, and the optimum is rounded down; what
rounding leaves is packed first-fit decreasing. Pieces are then ranked inside
their bin, and a piece's rank names its pattern, copy and slot by arithmetic, so
assignment is one join of the pieces with the list of patterns.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapweave.llm._common import chunks, written

#: Words that a task keeps the ids of, and their characters at most.
MEMO, LONG = 500_000, 48
#: Rows per block when ranks are counted: a block's rows are ranked in one task.
BLOCK_ROWS = 50_000
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_TAIL = ".,!?;:"
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


# What a tokenizer must do with white space, case and words for the short cuts below to hold.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    "post_processor": None,
}


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    spec = json.loads(t.to_str())
    spec["model"] = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
    if any(spec[k] != v for k, v in _KNOWN.items()):
        raise ValueError(f"{path}: only tokenizers that compose, lower and cut texts at white space as this module does are supported")
    return t


@functools.cache
def _last(path: str) -> np.ndarray:
    """Which ids end a word."""
    spec = json.loads(_tokenizer(path).to_str())["model"]
    mark = spec.get("end_of_word_suffix")
    ends = np.zeros(1 + max(spec["vocab"].values()), bool)
    if mark:
        ends[[i for w, i in spec["vocab"].items() if w.endswith(mark)]] = True
    return ends


def _encoded(path: str, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Each word with its ids. Words of letters go to the tokenizer 50 at a time, parted by spaces: if it ends as many words, each is one of them."""
    tok, last = _tokenizer(path), _last(path)
    letters = [w for w in words if w.isalpha()]
    rest = [w for w in words if not w.isalpha()]
    groups = [letters[i : i + 50] for i in range(0, len(letters), 50)]
    for group, e in zip(groups, tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        ends = np.flatnonzero(last[np.minimum(ids, len(last) - 1)]) + 1
        if len(ends) != len(group):
            rest += group
            continue
        data, cuts = ids.tobytes(), (4 * ends).tolist()
        yield from ((w, data[a:b]) for w, a, b in zip(group, [0, *cuts], cuts))
    for w, e in zip(rest, tok.encode_batch_fast(rest, add_special_tokens=False)):
        yield w, np.array(e.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=4096)
def _letter(c: str) -> bool:
    """Whether a character is letters only to the tokenizer, which composes and lowers it first."""
    return unicodedata.normalize("NFC", c).lower().isalpha()


def _split(text: str) -> list[str]:
    """Words between what the tokenizer takes as white space. Latin-1 has lower case letters of its own, so such a text is lowered as a whole, as the tokenizer would do."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    else:
        text = text.lower()
    return _SPACE.split(text) if _SEPARATORS.search(text) else text.split()


def _learn(path: str, known: dict[str, bytes], new: set[str]) -> None:
    """Adds ``new`` words to ``known``. Punctuation behind a letter has ids of its own, so such a word's ids are those of its two parts."""
    cut = []
    for w in new:
        core = w.rstrip(_TAIL)
        if core and len(core) < len(w) and _letter(core[-1]):
            cut.append((w, core, w[len(core) :]))
    whole, cores, tails = zip(*cut) if cut else ((), (), ())
    known.update(_encoded(path, list(new.difference(whole).union(cores, tails).difference(known))))
    known.update((w, known[a] + known[b]) for w, a, b in cut)


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This tokenizer drops white space and never merges across it, so a text's ids are those of its words, which are kept by word in a bounded dictionary."""
    known: dict[str, bytes] = {}
    last = np.array([end_id], "<u4").tobytes()
    for keys, texts in chunks(batches, 1, 1 << 20):
        words = [_split(t) if t else [] for t in texts]
        here = set().union(*words)
        new = here.difference(known)
        if len(known) + len(new) > MEMO:  # what is in use stays
            known = {w: known[w] for w in here.difference(new)}
        _learn(path, known, new)
        long = [w for w in new if len(w) > LONG]
        rows = []
        for key, ws in zip(keys, words):
            ids = b"".join(map(known.__getitem__, ws)) + last
            n = len(ids) // 4
            for start in range(0, n, capacity):
                part = ids[4 * start : 4 * (start + capacity)]
                row = (key, start, len(part) // 4, zlib.crc32(part), n)
                rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
        for w in long:
            known.pop(w, None)
            known.pop(w.rstrip(_TAIL), None)
        cols = list(zip(*rows))
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[5:]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])


def _best_pattern(value: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: sizes 1..cap with these values; the best total and how often each size is in it."""
    best = np.zeros(cap + 1)
    take = np.zeros(cap + 1, np.int64)
    for c in range(1, cap + 1):
        tries = value[:c] + best[c - 1 :: -1][:c]
        k = int(tries.argmax())
        if tries[k] > best[c - 1] + 1e-12:
            best[c], take[c] = tries[k], k + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(cap, np.int64), cap
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[cap]), pattern


def solve(demand: np.ndarray, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns and their number of copies that hold at least ``demand[i]`` items of size i + 1 each in bins of ``len(demand)``.

    Column generation by the revised simplex method, then rounding down, then
    first-fit decreasing for what is left: at most one item per unit of a
    fractional pattern, whatever the demand.
    """
    cap = len(demand)
    sizes = np.nonzero(demand)[0]
    out: list[tuple[np.ndarray, int]] = []
    if not len(sizes):
        return out
    d = demand[sizes].astype(float)
    m = len(sizes)
    basis = [np.zeros(m, np.int64) for _ in range(m)]
    for i, s in enumerate(sizes):
        basis[i][i] = cap // (s + 1)
    inverse = np.diag([1.0 / basis[i][i] for i in range(m)])
    for step in range(rounds):
        if step % 200 == 199:
            inverse = np.linalg.inv(np.array(basis, float).T)
        duals = inverse.sum(axis=0)
        value = np.full(cap, -1.0)
        value[sizes] = duals
        gain, pattern = _best_pattern(value, cap)
        if gain <= 1 + 1e-7:
            break
        column = pattern[sizes]
        x, way = inverse @ d, inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(way > 1e-10, x / way, np.inf)
        out_of = int(ratio.argmin())
        if not np.isfinite(ratio[out_of]):
            break
        row = inverse[out_of] / way[out_of]
        inverse -= np.outer(way, row)
        inverse[out_of] = row
        basis[out_of] = column
    left = demand.astype(np.int64).copy()
    for pattern, copies in zip(basis, np.maximum(inverse @ d, 0)):
        full = np.zeros(cap, np.int64)
        full[sizes] = pattern
        n = int(copies + 1e-9)
        used = full > 0
        n = min(n, int((left[used] // full[used]).min())) if used.any() else 0
        if n > 0:
            left -= n * full
            out.append((full, n))
    bins: list[list] = []
    for s in range(cap - 1, -1, -1):
        for _ in range(int(left[s])):
            at = next((b for b in bins if b[0] >= s + 1), None)
            if at is None:
                bins.append(at := [cap, np.zeros(cap, np.int64)])
            at[0] -= s + 1
            at[1][s] += 1
    return out + [(b[1], 1) for b in bins]


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, grain: int = 16, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A null or empty text is the end id alone; every input row is packed, repeated
    rows and null ids too; an empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    units = capacity // grain
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    pieces = rows.mapInArrow(functools.partial(_pieces, path, end_id, capacity, with_ids), schema)
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    pieces = written(pieces, "pieces")

    # rank inside a size: pieces of one size are dealt to blocks, counted per block, and ranked per block
    total = pieces.count()
    blocks = max(1, -(-total // BLOCK_ROWS)) * 8
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    per_block = pieces.groupBy("size", "block").agg(F.count("*").alias("n"))
    before = per_block.select("size", "block", (F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    own = F.row_number().over(Window.partitionBy("size", "block").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["size", "block"]).withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)))

    demand = np.zeros(units, np.int64)
    for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most capacity / grain rows
        demand[r["size"] - 1] = r["n"]
    plan, first = [], 0
    seen = np.zeros(units, np.int64)
    for pattern, copies in solve(demand):
        for s in np.nonzero(pattern)[0].tolist():
            k = int(pattern[s])
            plan.append((s + 1, int(seen[s]), int(seen[s]) + k * copies, k, first))
            seen[s] += k * copies
        first += copies
    patterns = spark.createDataFrame(plan, "size int, low long, high long, per_copy int, first_sequence long")
    # a pattern holds ranks [low, high) of a size: at most a few hundred patterns a size, looked up by an ordered array
    lists = patterns.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("low", "high", "per_copy", "first_sequence"))).alias("ways"))
    found = F.element_at(F.filter("ways", lambda w: (w["low"] <= F.col("rank")) & (F.col("rank") < w["high"])), 1)
    placed = ranked.join(F.broadcast(lists), "size").withColumn("way", found)  # as bounded as the patterns
    placed = placed.withColumn("sequence_id", F.col("way.first_sequence") + F.floor((F.col("rank") - F.col("way.low")) / F.col("way.per_copy")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return placed.withColumns({"offset": offset, "sequence_id": F.col("sequence_id").cast("long")}).select(*keep)
