"""Exact removal of repeated byte strings, by suffix arrays over what may repeat.

Every string of ``WIDTH`` bytes has an anchor: the ``GRAM``-byte string of least
hash in it (the leftmost of several). Equal strings have equal anchors at equal
places. Consecutive starts with one anchor form a piece; each start is in exactly
one piece.

1. Pieces that are equal to one before them, told by hash, are repeated as a
   whole: first inside a few megabytes, then, dealt by anchor and sorted, in all. Anchors
   that are frequent in a sample of the texts are dealt by anchor and piece instead, so that
   a line that stands everywhere in other surroundings is many tasks' work.
2. Texts that hold the first of a piece whose anchor has other pieces too give
   the bytes of these pieces.
3. The first of each piece goes, with the other pieces of its anchor, into a
   batch of bounded size. The batch's text is cut behind white space into tokens,
   its suffix array is built by ``gsaca`` over the tokens' ranks. Strings are equal
   if their first token is, as far as it lies in them, and what follows are
   neighbours in the suffix array with enough bytes in common. All but the
   earliest repeat.
4. An anchor with more than ``GROUP`` pieces, or dealt by piece, is in several batches;
   the earliest strings of these meet once more by hash.
5. Repeated ranges are gathered per document, merged and cut out.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapweave.llm._common import bitmap_filter, chunks, written
from snapweave.llm._words import _SPACE, mix, prefix_sums, slice_hashes
from snapweave.llm.gsaca import suffix_array

WIDTH, GRAM = 100, 32
#: Pieces of one anchor in one batch, and bytes of a batch beyond which a new one starts.
GROUP, BATCH = 1000, 1 << 18
#: One text in so many is looked at for frequent anchors. Which ones are found decides where pieces meet, not what is found.
SAMPLE = 64
#: An anchor is frequent if it has so many sampled pieces, and so small a part of all of them; hence at most that many are.
FREQUENT, MOST = 32, 10_000
#: Ways that the pieces of a frequent anchor are dealt.
SHARES = 256
#: Starts whose anchors are found at once.
SEGMENT = 1 << 24
_STARTS = WIDTH - GRAM + 1
DOC = ["d", "t"]


def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, hash of the anchor and hash of the bytes of each piece; ``ends``: where each text ends in ``data``."""
    n = len(data)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    sums = prefix_sums(data)
    place = np.empty(n - WIDTH + 1, np.int64)
    gram = np.empty(n - WIDTH + 1, np.uint64)
    for a in range(0, len(place), SEGMENT):
        b = min(a + SEGMENT, len(place))
        at = np.arange(b - a + _STARTS - 1)
        hashes = slice_hashes(sums, a + at, a + at + GRAM)
        least = (hashes & np.uint64(0xFFFFFFFFF0000000)) | at.astype(np.uint64)  # the place breaks ties, and tells which it was
        width = 1
        while 2 * width <= _STARTS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = _STARTS - width
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        own = (least & np.uint64(0xFFFFFFF)).astype(np.int64)
        place[a:b], gram[a:b] = a + own, hashes[own]
    starts = np.arange(len(place))
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(place)]
    ok = starts + WIDTH <= ends[doc]
    starts, place, gram, doc = starts[ok], place[ok], gram[ok], doc[ok]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])]))
    first = starts[new]
    count = np.diff(np.append(new, len(starts)))
    return first, count, gram[new].view(np.int64), slice_hashes(sums, first, first + count + WIDTH - 1).view(np.int64)


_LEAST = -(1 << 63)


def _mark(text: bytes) -> int:
    return zlib.crc32(text) - (1 << 31)


def _pack(carried: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw = [(t or "").encode() for t in b.column(1).to_pylist()]
        ids = [_LEAST if i is None else i for i in b.column(0).to_pylist()]
        marks = pa.array(map(_mark, raw), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), marks, *[b.column(2 + i) for i in range(carried)], pa.array([pack.compress(t) for t in raw], pa.binary())], names=["d", "t", *[f"c{i}" for i in range(carried)], "z"])


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts, with their numbers of pieces, a few megabytes at a time."""
    for _, texts in chunks(batches, 1, 1 << 20):
        _, _, anchor, _ = pieces(*_joined([(t or "").encode() for t in texts]))
        anchors, n = np.unique(anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n, pa.int64())], names=["anchor", "n"])


def frequent(texts: DataFrame, sample: int = SAMPLE, least: int = FREQUENT, most: int = MOST) -> np.ndarray:
    """At most ``most`` anchors that have ``least`` pieces or more in a sample of ``texts`` (id, text), sorted."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counts = written(sample.mapInArrow(_sampled, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(least, -(-total // most))).select("anchor").collect()  # so at most that many rows
    return np.array(sorted(r["anchor"] for r in found), np.int64)


def _pieces(hot: np.ndarray, shares: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts (columns id, text), a few megabytes at a time.

    A piece that occurs earlier among the same megabytes is repeated whatever else there is; the
    ranges of those, merged, are rows of share -1, dealt by id (``anchor``), with the end as ``piece``
    and the start as ``at``. The other pieces are to be compared.
    """
    for ids, texts in chunks(batches, 1, 1 << 20):
        raw = [(t or "").encode() for t in texts]
        data, ends = _joined(raw)
        first, count, anchor, piece = pieces(data, ends)
        doc = np.searchsorted(ends, first, side="right")
        d = np.array([_LEAST if i is None else i for i in ids], np.int64)
        t = np.array([_mark(x) for x in raw], np.int32)
        a = first - np.concatenate([[0], ends[:-1]])[doc]
        order = np.lexsort((a, t[doc], d[doc], piece, anchor))
        again = np.zeros(len(order), bool)
        if len(order):  # rows of one id and text are one document, so they don't repeat each other
            x, y = order[:-1], order[1:]
            same = (anchor[x] == anchor[y]) & (piece[x] == piece[y])
            group = np.concatenate([[0], np.cumsum(~same)])
            lead = order[np.flatnonzero(np.concatenate([[True], ~same]))][group]
            again[order] = (d[doc[lead]] != d[doc[order]]) | (t[doc[lead]] != t[doc[order]]) | (a[lead] != a[order])
        k = ~again
        share = np.where(np.isin(anchor[k], hot), 1 + (piece[k].view(np.uint64) % np.uint64(shares)).astype(np.int32), 0).astype(np.int32)
        own, s, e = _runs_of(doc[again], first[again], first[again] + count[again] + WIDTH - 1)
        base = (np.concatenate([[0], ends[:-1]]))[own]
        ranges = [d[own], np.full(len(own), -1, np.int32), e - base, d[own], t[own], s - base]
        rows = [anchor[k], share, piece[k], d[doc[k]], t[doc[k]], a[k] << 8 | count[k]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(rows, ranges)], names=["anchor", "share", "piece", "d", "t", "at"])


def _runs_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges in joined texts, in order, merged where they touch inside one text: text, start, end."""
    if not len(doc):
        return doc, start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]))
    return doc[new], start[new], reach[np.append(new[1:], len(doc)) - 1]


def _compare(group: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, share, piece and place. Out: pieces that occurred before (``salt`` null), and the first of each piece whose anchor has several, or is frequent (share above 0). Ranges (share -1) pass by, with ``salt`` -1 and their end as ``anchor``."""
    last = None  # the previous row
    held = None  # the first piece of the current anchor, as long as it is the only one
    number = 0  # of the current piece in its anchor and share
    names = ["anchor", "d", "t", "at", "salt"]
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        known = columns[1] < 0
        if known.any():
            _, _, end, d, t, at = (c[known] for c in columns)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (end, d, t, at, np.full(len(d), -1))], names=names)
            columns = [c[~known] for c in columns]
        anchor, share, piece, d, t, at = columns
        if not len(anchor):
            continue
        before = [np.concatenate([[v], c[:-1]]) for v, c in zip(last or (0,) * 6, (anchor, share, piece, d, t, at))]
        new_anchor = (anchor != before[0]) | (share != before[1])
        new_piece = new_anchor | (piece != before[2])
        if last is None:
            new_anchor[0] = new_piece[0] = True
        equal = ~new_piece & (d == before[3]) & (t == before[4]) & (at == before[5])
        lead = np.flatnonzero(new_piece)
        if last is None or new_piece[0]:
            lead_of = lead[np.cumsum(new_piece) - 1]
            first_same = (d == d[lead_of]) & (t == t[lead_of]) & (at == at[lead_of])
        else:
            lead_of = np.concatenate([[-1], lead])[np.cumsum(new_piece)]
            l = [np.where(lead_of >= 0, c[lead_of], v) for c, v in zip((d, t, at), first)]
            first_same = (d == l[0]) & (t == l[1]) & (at == l[2])
        rows = [(anchor[i], d[i], t[i], at[i], None) for i in np.flatnonzero(~new_piece & ~equal & ~first_same).tolist()]
        for i in lead.tolist():
            row = (anchor[i], d[i], t[i], at[i])
            if new_anchor[i]:
                held, number = None if share[i] else row, 0
                if share[i]:
                    rows.append((*row, int(share[i]) << 20))
                continue
            number += 1
            if held is not None:
                rows.append((*held, 0))
                held = None
            rows.append((*row, (int(share[i]) << 20) + number // group))
        if len(lead):
            first = (d[lead[-1]], t[lead[-1]], at[lead[-1]])
        last = (anchor[-1], share[-1], piece[-1], d[-1], t[-1], at[-1])
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the pieces at given places of packed texts."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for d, t, places, z in zip(*[c.to_pylist() for c in b.columns]):
            text = unpack.decompress(z)
            for p in places:
                a, n = p["at"] >> 8, p["at"] & 255
                out.append((p["anchor"], p["salt"], d, t, a, text[a : a + n + WIDTH - 1]))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["anchor", "salt", "d", "t", "a", "data"])


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and rank of each token of a text: up to and with the next white space, ranks in the order of bytes."""
    arr = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(_SPACE[arr]) + 1
    if not len(end) or end[-1] != len(arr):
        end = np.append(end, len(arr))
    start = np.concatenate([[0], end[:-1]])
    return start, end - start, arr


def repeated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a ``WIDTH``-byte string in ``texts``: its text, its place there, and the index (among these starts) of the earliest equal one."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts) + bytes(WIDTH), np.uint8)
    starts, sizes, words, owner = [], [], [], []
    for k, t in enumerate(texts):
        s, n, _ = tokens(t)
        starts.append(s + base[k])
        sizes.append(n)
        owner.append(np.full(len(s) + 1, k))
        words += [t[a : a + b] for a, b in zip(s.tolist(), n.tolist())]
    # symbols: 0 ends all, 1 ends a text, tokens from 2 on in the order of their bytes
    rank = {w: i + 2 for i, w in enumerate(sorted(set(words)))}
    symbols, spot, before, k = [], [], [], 0
    for s, n, b, size in zip(starts, sizes, base.tolist(), lengths.tolist()):
        symbols += [rank[w] for w in words[k : k + len(s)]] + [1]
        k += len(s)
        spot.append(np.append(s, b + size))
        before.append(np.concatenate([[0], n]))
    spot, before, owner = np.concatenate(spot), np.concatenate(before), np.concatenate(owner)
    sa = suffix_array(np.array([*symbols, 0]))[1:]
    left = (base + lengths)[owner] - spot
    # bytes that neighbours have in common, up to WIDTH and to the ends of their texts
    x, y = sa[:-1], sa[1:]
    common = np.zeros(len(sa), np.int64)
    reach = np.arange(WIDTH)
    for i in range(0, len(x), 20000):
        xs, ys = x[i : i + 20000], y[i : i + 20000]
        same = data[spot[xs][:, None] + reach] == data[spot[ys][:, None] + reach]
        run = np.where(same.all(axis=1), WIDTH, same.argmin(axis=1))
        common[i + 1 : i + 1 + len(xs)] = np.minimum(run, np.minimum(left[xs], left[ys]))
    sums = prefix_sums(data)
    sa_before, sa_left, sa_spot = before[sa], left[sa], spot[sa]
    place, key = [], []
    for d in range(1, int(before.max(initial=0)) + 1):  # a string's first token has d bytes, counted from where the string starts
        need = max(WIDTH - d, 0)
        run = np.cumsum(common < need) if need else np.zeros(len(sa), np.int64)
        ok = np.flatnonzero((sa_before >= d) & (sa_left >= need))
        if not len(ok):
            continue
        s = sa_spot[ok] - d
        rest = slice_hashes(sums, s, s + min(d, WIDTH))
        place.append(s)
        key.append(mix(rest + mix(run[ok].astype(np.uint64) * np.uint64(256) + np.uint64(min(d, WIDTH)))))
    if not place:
        none = np.zeros(0, np.int64)
        return none, none, none
    place, key = np.concatenate(place), np.concatenate(key)
    by_place = np.argsort(place, kind="stable")
    place, key = place[by_place], key[by_place]
    _, earliest, which = np.unique(key, return_index=True, return_inverse=True)
    own = np.searchsorted(base + lengths, place, side="right")
    return own, place - base[own], earliest[which]


def _runs(flags: np.ndarray, own: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the bytes that flagged strings cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    new = np.flatnonzero(np.concatenate([[True], (own[at][1:] != own[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    return list(zip(own[at][new].tolist(), place[at][new].tolist(), (place[at][last] + WIDTH).tolist()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (split, d, t, a, data). Ranges that repeat; of split anchors also the strings that are the earliest here."""
    rows.sort(key=lambda r: r[1:4])
    own, place, earliest = repeated([r[4] for r in rows])
    twice = earliest != np.arange(len(own))
    out = [(*rows[k][1:3], rows[k][3] + s, rows[k][3] + e, None) for k, s, e in _runs(twice, own, place)]
    split = np.array([r[0] for r in rows], bool)
    at = np.flatnonzero(~twice & split[own]) if len(own) else []
    if len(at):
        data, ends = _joined([r[4] for r in rows])
        s = place[at] + np.concatenate([[0], ends[:-1]])[own[at]]
        hashes = slice_hashes(prefix_sums(data), s, s + WIDTH).view(np.int64).tolist()
        out += [(*rows[k][1:3], rows[k][3] + p, rows[k][3] + p + WIDTH, h) for k, p, h in zip(own[at].tolist(), place[at].tolist(), hashes)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    cols = list(zip(*out)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["d", "t", "start", "end", "string"])


def _sorted_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns anchor, salt, split, d, t, a, data, sorted by anchor and salt, which are never torn apart."""
    rows, size, now = [], 0, None
    for b in batches:
        for anchor, salt, split, d, t, a, data in zip(*[c.to_pylist() for c in b.columns]):
            if (anchor, salt) != now and size > BATCH:
                yield _batch(rows)
                rows, size = [], 0
            now = (anchor, salt)
            rows.append((split, d, t, a, data))
            size += len(data)
    if rows:
        yield _batch(rows)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(carried: int, with_text: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns d, the carried ones, ranges, z."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for ranges, z in zip(b.column(1 + carried).to_pylist(), b.column(2 + carried).to_pylist()):
            data = unpack.decompress(z)
            spans = merge([(r["start"], r["end"]) for r in ranges or []])
            parts, at = [], 0
            for s, e in spans:
                parts.append(data[at:s])
                at = e
            kept = b"".join([*parts, data[at:]])
            row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
        cols = list(zip(*rows)) or [[]] * (4 + with_text)
        kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
        ids = pa.array([None if i == _LEAST else i for i in b.column(0).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, *[b.column(1 + i) for i in range(carried)], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *[f"c{i}" for i in range(carried)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + carried + with_text])


def remove(df: DataFrame, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group: int = GROUP, sample: int = SAMPLE, least: int = FREQUENT, shares: int = SHARES) -> DataFrame:
    """``doc_id``, the ``carry`` columns, ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``) of every row.

    A byte goes if it lies in a 100-byte string that also starts earlier: in a document of
    smaller id, or before in the same one. A null text is empty; a null id counts as the
    smallest. Rows that share an id but not their text are ordered by the text's CRC-32;
    rows that share both are one document, and each gets its result. ``kept_text`` leaves out
    characters that were cut in two. An empty table gives no rows. ``group``, ``sample``, ``least`` and
    ``shares`` deal the work and change no result.
    """
    rows = df.select(df[id_col].cast("long").alias("d"), df[text_col].alias("text"), *[df[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kinds = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    doc = [T.StructField("d", T.LongType()), T.StructField("t", T.IntegerType())]
    packed = rows.mapInArrow(functools.partial(_pack, len(carry)), T.StructType([*doc, *kinds, T.StructField("z", T.BinaryType())]))
    plain = rows.select("d", "text")

    hot = frequent(plain, sample, least)
    rest = plain.mapInArrow(functools.partial(_pieces, hot, shares), "anchor long, share int, piece long, d long, t int, at long")
    # equal pieces of a few megabytes are one row by now, so an anchor has a row per megabytes at most where its pieces are equal
    rest = rest.repartition("anchor", "share").sortWithinPartitions("anchor", "share", "piece", "d", "t", "at")
    rest = written(rest.mapInArrow(functools.partial(_compare, group), "anchor long, d long, t int, at long, salt long"), "pieces")
    near = rest.where("salt < 0").select("d", "t", F.col("at").alias("start"), F.col("anchor").alias("end"))
    start = F.shiftright("at", 8)
    whole = rest.where("salt is null").select("d", "t", start.alias("start"), (start + F.col("at").bitwiseAND(F.lit(255)) + WIDTH - 1).alias("end"))

    firsts = rest.where("salt >= 0")
    split = firsts.where("salt > 0").select("anchor").distinct().withColumn("split", F.lit(True))
    places = firsts.groupBy(*DOC).agg(F.collect_set(F.struct("anchor", "salt", "at")).alias("places"))  # at most one a start
    places = written(places, "places")
    texts = rows.select("d", "text").mapInArrow(functools.partial(_pack, 0), T.StructType([*doc, T.StructField("z", T.BinaryType())]))
    cut = bitmap_filter(texts, places, "d").join(places, DOC).select("d", "t", "places", "z")
    cut = cut.mapInArrow(_cut, "anchor long, salt long, d long, t int, a long, data binary").join(split, "anchor", "left")
    dealt = cut.select("anchor", "salt", F.col("split").isNotNull().alias("split"), "d", "t", "a", "data").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = written(dealt.mapInArrow(_sorted_batches, "d long, t int, start long, end long, string long"), "found")
    inside = found.where("string is null").drop("string")
    met = found.where("string is not null").groupBy("string").agg(F.min(F.struct("d", "t", "start")).alias("least"), F.collect_list(F.struct("d", "t", "start", "end")).alias("all"))  # one a batch
    later = met.where(F.size("all") > 1).select("least", F.explode("all").alias("x")).where(F.struct("x.d", "x.t", "x.start") != F.col("least")).select("x.*")

    ranges = near.unionByName(whole).unionByName(inside).unionByName(later).groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    both = packed.join(ranges, DOC, "left").select("d", *[f"c{i}" for i in range(len(carry))], "ranges", "z")
    out = [T.StructField("doc_id", T.LongType()), *kinds, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    out += [T.StructField("kept_text", T.StringType())] * with_text
    done = both.mapInArrow(functools.partial(_kept, len(carry), with_text), T.StructType(out))
    return done.select("doc_id", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[f.name for f in out[1 + len(carry) :]])
