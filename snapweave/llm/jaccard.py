"""Similarity join on word shingles by vertical partitioning.

Sets are the distinct 5-word shingles of a text, as 64-bit hashes; equal sets
count as one. Pairs are looked for where the rarest shingles of two sets meet:

1. In the order of hashes, two similar sets share ``k`` of their first
   ``n - ceil(0.8 n) + k`` shingles. With ``k`` at ``EXTRA`` percent of the smaller
   set, sets that share fewer of these with all other sets together are done; for
   most texts that is all, and a passage that many texts share doesn't change it.
2. For the others, shingles are counted and ordered from rare to frequent. Each
   shingle in a set's prefix is a posting. In each posting list, the set whose
   shingles are the most frequent on average (the likeliest original) is paired
   with all others; then, what is still in another component is paired with the
   list. Pairs that can't have enough in common given where they meet are left
   out. Both steps together miss no link between components.
3. A pair's overlap is counted fragment by fragment: the global order of hashes
   is cut into ``FRAGMENTS`` ranges, sets are stored as one sorted segment per
   range, partial overlaps are counted where segments of one range meet, and
   summed per pair.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm._common import bitmap_filter, chunks, give_back, semi_join, written
from snapweave.llm._words import mix, shingles
from snapweave.llm.graph import components

FRAGMENTS = 4
#: Percent of a set by which the first prefix is longer than one shared shingle needs; so many more must be shared.
EXTRA = 20
#: Stands for a null id; only a set all of whose rows have none is found by it.
_NO_ID = (1 << 63) - 1
#: Shingles in a bucket, about, where buckets of shingles are counted in one task each.
BUCKET_ROWS = 500_000


def _sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index and value of each shingle, set sizes, and set keys (a hash of the set; 0 for empty ones)."""
    docs, hashes = shingles([(t or "").encode().lower() for t in texts], k)
    n = np.bincount(docs, minlength=len(texts))
    cuts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes.view(np.uint64)))])
    ends = np.cumsum(n)
    keys = mix(cuts[ends] - cuts[ends - n] + n.astype(np.uint64)).view(np.int64)
    return docs, hashes, n, np.where(n > 0, keys, 0)


def _sizes(k: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, *marks in chunks(batches, 1, 1 << 20):
        _, _, n, keys = _sets(texts, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(keys), *[pa.array(m, pa.string()) for m in marks]], names=["doc_id", "n", "key", "mark"][: 3 + len(marks)])


def _prefixes(k: int, percent: int, buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of a megabyte of texts, a row per bucket of shingles, as bytes.

    ``shingle, owner``: 32 bits of each shingle (the bucket has told others apart; shingles that
    agree in them only make a set wait for the next filter) that one set of these has, and that set's key. ``told``: shingles that several of these
    sets share, once each. ``keys, local``, in one row: the sets themselves, and how many of
    their shingles were told.
    """
    for _, texts in chunks(batches, 1, 1 << 20):
        docs, hashes, n, keys = _sets(texts, k)
        size = np.where(n > 0, n - -(-percent * n // 100) + np.maximum(1, EXTRA * n // 100), 0)
        lead = np.zeros(len(texts), bool)
        lead[np.unique(keys, return_index=True)[1]] = True  # equal sets count once
        lead &= n > 0
        inside = (np.arange(len(docs)) - (np.cumsum(n) - n)[docs] < size[docs]) & lead[docs]
        docs, hashes = docs[inside], hashes[inside]
        _, at, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        alone = counts[which] == 1
        local = np.bincount(docs[~alone], minlength=len(texts))
        plain, whose, told = hashes[alone].view(np.uint64), keys[docs[alone]], hashes[at[counts > 1]].view(np.uint64)
        parts = []
        for values in (plain, told):
            place = values % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            parts.append((order, np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64))))
        (order, cuts), (order_told, cuts_told) = parts
        short, whose = (plain[order] >> np.uint64(32)).astype("<u4"), whose[order].astype("<i8")
        short_told = (told[order_told] >> np.uint64(32)).astype("<u4")
        rows = []
        for i in range(buckets):
            u, v = slice(cuts[i], cuts[i + 1]), slice(cuts_told[i], cuts_told[i + 1])
            if u.start < u.stop or v.start < v.stop:
                rows.append((i, short[u].tobytes(), whose[u].tobytes(), short_told[v].tobytes(), b"", b""))
        if lead.any():
            rows.append((int(keys[lead][0] % buckets), b"", b"", b"", keys[lead].astype("<i8").tobytes(), local[lead].astype("<i8").tobytes()))
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int32()] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["bucket", "shingle", "owner", "told", "keys", "local"])


def _meet(group: pa.Table) -> pa.Table:
    """One bucket: how many shingles each set shares with other megabytes' sets, or shared with its own."""

    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

    shingle, told, key = column("shingle", "<u4"), column("told", "<u4"), column("owner", "<i8")
    order = np.argsort(shingle, kind="stable")
    shingle, key = shingle[order], key[order]
    hit = np.zeros(0, bool)
    if len(shingle):
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        starts = np.flatnonzero(new)
        shared = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)) | np.isin(shingle[starts], told)
        hit = shared[np.cumsum(new) - 1]
    names, n = np.unique(key[hit], return_counts=True)
    keys, local = column("keys", "<i8"), column("local", "<i8")
    del shingle, key, hit, order
    give_back()
    return pa.table({"key": np.concatenate([names, keys]), "shared": np.concatenate([n, local])})


def _segments(k: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = np.array([-(1 << 63) + i * ((1 << 64) // FRAGMENTS) for i in range(1, FRAGMENTS)], np.int64)
    for _, texts in chunks(batches, 1, 1 << 20):
        docs, hashes, n, keys = _sets(texts, k)
        part = docs * FRAGMENTS + np.searchsorted(cut, hashes, side="right")
        sizes = np.bincount(part, minlength=len(texts) * FRAGMENTS)
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes))
        outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * FRAGMENTS + 1, FRAGMENTS, dtype=np.int32)), inner)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64()), outer], names=["key", "n", "segments"])


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(names, cols)})


def _column(group: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)


_DEALT, _GRADED = ["bucket", "shingles", "keys", "counts", "sizes"], ["bucket", "codes", "keys", "counts", "sizes"]


def _deal(buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingles of a few sets, a row per bucket of shingles, as bytes; each set's follow one another, with their number in ``counts`` and the set's in ``sizes``."""
    for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        keys, n = b.column("key").to_numpy().astype("<i8"), b.column("n").to_numpy()
        lists = b.column("segments")
        shingles = lists.flatten().flatten().to_numpy().astype("<i8")
        place = (shingles.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        own = np.repeat(np.arange(len(keys)), n)
        order = np.lexsort((own, place))
        place, own, shingles = place[order], own[order], shingles[order]
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])])[: len(place)])
        counts, whose, sizes = np.diff(np.append(starts, len(place))).astype("<u4"), keys[own[starts]], n[own[starts]].astype("<i8")
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        runs = np.searchsorted(place[starts], np.arange(buckets + 1))
        rows = [(i, shingles[cuts[i] : cuts[i + 1]].tobytes(), *[x[runs[i] : runs[i + 1]].tobytes() for x in (whose, counts, sizes)]) for i in range(buckets) if cuts[i] < cuts[i + 1]]
        yield from _rows(rows, _DEALT).to_batches()


def _grade(buckets: int, group: pa.Table) -> pa.Table:
    """One bucket of shingles: the codes of each set's shingles that other sets have as well, a row per bucket of sets.

    A code is a grade of how many sets have the shingle (up to 63 as it is, then four steps for
    each doubling) before 56 bits of the shingle: codes are ordered from rare to frequent.
    """
    shingles, keys, counts, sizes = (_column(group, c, t) for c, t in (("shingles", "<i8"), ("keys", "<i8"), ("counts", "<u4"), ("sizes", "<i8")))
    _, which, df = np.unique(shingles, return_inverse=True, return_counts=True)
    grades = np.where(df < 64, df, np.minimum(127, np.floor(4 * np.log2(df)) + 40)).astype(np.int64)
    shared = df[which] > 1
    codes = (grades[which] << 56 | shingles & ((1 << 56) - 1))[shared]
    own = np.repeat(np.arange(len(keys)), counts)[shared]
    place = (keys.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    by_run, by_code = np.argsort(place, kind="stable"), np.argsort(place[own], kind="stable")
    runs = np.searchsorted(place[by_run], np.arange(buckets + 1))
    cuts = np.searchsorted(place[own][by_code], np.arange(buckets + 1))
    counts = np.bincount(own, minlength=len(keys)).astype("<u4")
    codes, keys, counts, sizes = codes[by_code].astype("<i8"), keys[by_run], counts[by_run], sizes[by_run]
    return _rows([(i, codes[cuts[i] : cuts[i + 1]].tobytes(), *[x[runs[i] : runs[i + 1]].tobytes() for x in (keys, counts, sizes)]) for i in range(buckets) if cuts[i] < cuts[i + 1]], _GRADED)


def _postings(percent: int, group: pa.Table) -> pa.Table:
    """One bucket of sets: the codes in each set's prefix, their places, and the mean grade of the set."""
    codes, keys, counts, sizes = (_column(group, c, t) for c, t in (("codes", "<i8"), ("keys", "<i8"), ("counts", "<u4"), ("sizes", "<i8")))
    own = np.repeat(np.arange(len(keys)), counts)
    order = np.lexsort((codes, keys[own]))
    codes, key, n = codes[order], keys[own][order], sizes[own][order]
    _, first, which, m = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    unique = n - m[which]  # shingles that no other set has come first
    place = np.arange(len(codes)) - first[which] + 1 + unique
    inside = place <= n - -(-percent * n // 100) + 1
    grades = np.bincount(which, (codes >> 56).astype(float), minlength=len(m))[which] if len(codes) else np.zeros(0)
    weight = (grades + unique) / np.maximum(n, 1)
    return pa.table({k: pa.array(x[inside]) for k, x in (("key", key), ("n", n), ("weight", weight), ("place", place), ("shingle", codes))})


def _links(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, na, b, nb``) that are similar."""
    pairs = written(pairs, "pairs")
    used = bitmap_filter(found, pairs.select(F.explode(F.array("a", "b")).alias("key")), "key")
    segments = used.select("key", F.posexplode("segments").alias("fragment", "segment")).where(F.size("segment") > 0)
    at = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("segment").alias("x"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("segment").alias("y"))
    both = at.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    partial = both.select("a", "na", "b", "nb", F.size(F.array_intersect("x", "y")).alias("shared"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared"))
    return total.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; documents in one component are joined by links of at least ``percent`` % Jaccard similarity.

    Null or empty texts and texts without words have no shingles and no links: their component
    is themselves. A row with a null id is linked like others, but names no component: one of
    such rows only has a null name. Repeated rows give repeated results. Other columns are ignored.
    """
    rows = groups(df, id_col, text_col, k, percent)
    least = written(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")  # else AQE can't split a large component
    named = rows.join(least, "component", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, mark_col: str | None = None) -> DataFrame:
    """``doc_id, n, component`` (and ``mark``, the string in ``mark_col``) for every row: the number of shingles and a name of the component, null without shingles."""
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), *([df[mark_col].alias("mark")] if mark_col else []))
    sets = written(docs.mapInArrow(functools.partial(_sizes, k), "doc_id long, n long, key long" + ", mark string" * bool(mark_col)), "sets")
    docs = docs.select("doc_id", "text")

    # a set is told from another by its key, and found again by one of its rows' ids
    distinct = sets.where("n > 0").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least"), F.first("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * (100 - percent + EXTRA) // 100 // BUCKET_ROWS))
    # a shingle that many sets share is told once per megabyte
    rows = docs.mapInArrow(functools.partial(_prefixes, k, percent, buckets), "bucket int, shingle binary, owner binary, told binary, keys binary, local binary")
    counts = rows.groupBy("bucket").applyInArrow(_meet, "key long, shared long").groupBy("key").agg(F.sum("shared").alias("shared"))
    # each of the megabytes that hold a set has counted all its shared shingles
    need = F.greatest(F.lit(1), F.floor(EXTRA * F.ceil(F.col("n") * percent / 100) / 100))  # the smallest possible partner's k
    near = written(distinct.join(counts, "key").where(F.col("shared") >= need).select("key", "least"), "near")

    kept = semi_join(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID))), near.select(F.col("least").alias("doc_id")), "doc_id")
    found = kept.mapInArrow(functools.partial(_segments, k), "key long, n long, segments array<array<long>>")
    found = found.join(near.select("key"), "key", "left_semi")  # one id may stand on several texts, and rows may repeat
    found = written(found.groupBy("key").agg(F.first("n").alias("n"), F.first("segments").alias("segments")), "segments")

    buckets = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS))
    schema = ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in _DEALT)
    dealt = found.mapInArrow(functools.partial(_deal, buckets), schema)
    grade, post = functools.partial(_grade, buckets), functools.partial(_postings, percent)
    graded = dealt.groupBy("bucket").applyInArrow(lambda g: grade(g), schema.replace("shingles", "codes"))
    posts = graded.groupBy("bucket").applyInArrow(lambda g: post(g), "key long, n long, weight double, place long, shingle long")
    posts = written(posts, "postings")

    def can(other: str):
        """Whether what may follow the shared shingle suffices for the pair."""
        need = F.ceil((F.col("n") + F.col(f"{other}.n")) * percent / (100 + percent))
        return 1 + F.least(F.col("n") - F.col("place"), F.col(f"{other}.n") - F.col(f"{other}.place")) >= need

    def pairs(met: DataFrame) -> DataFrame:
        swap = F.col("key") > F.col("o.key")
        a = F.when(swap, F.struct("o.key", "o.n")).otherwise(F.struct("key", "n"))
        b = F.when(swap, F.struct("key", "n")).otherwise(F.struct("o.key", "o.n"))
        return met.select(a.alias("a"), b.alias("b")).select(F.col("a.key").alias("a"), F.col("a.n").alias("na"), F.col("b.key").alias("b"), F.col("b.n").alias("nb")).distinct()

    centre = F.max_by(F.struct("key", "n", "place"), F.struct("weight", "key")).alias("o")
    centres = posts.groupBy("shingle").agg(centre, F.count("*").alias("rows")).where("rows > 1").drop("rows")
    first = pairs(posts.join(centres, "shingle").where((F.col("key") != F.col("o.key")) & can("o")))
    links = written(_links(first, found, percent), "links")
    labels = components(links)

    named = posts.join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    named = written(named, "named")
    main = F.max_by("comp", F.struct("weight", "key")).alias("main")
    lists = named.groupBy("shingle").agg(main, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle", "main")
    rest = named.join(lists, "shingle")
    # sets more than a quarter apart in size are not similar: they never meet in one band of sizes, its neighbours included
    band = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else F.col("n").cast("int")
    outside = rest.where("comp <> main").select("shingle", F.struct("key", "n", "place", "comp").alias("o"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    met = rest.withColumn("band", band).join(outside, ["shingle", "band"])
    second = pairs(met.where((F.col("comp") != F.col("o.comp")) & can("o")))
    more = written(_links(second, found, percent), "links")
    labels = components(links.union(more)) if not more.isEmpty() else labels

    labels = written(labels.select(F.col("id").alias("key"), "comp"), "components")
    named = sets.join(labels, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("comp", "key")).alias("component")
    return written(named.select("doc_id", "n", component, *["mark"] * bool(mark_col)), "groups")
