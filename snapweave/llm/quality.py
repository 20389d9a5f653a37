"""Quality rules: counts per text, then perplexity bands of an n-gram model.

The model is an interpolated modified Kneser-Ney model over bytes, one for each
language. Spark counts all 5-grams of every text that passes the plain rules and
has at most one symbol in ten words, so that junk can't make itself likely;
lower orders, discounts and probabilities are joins and aggregates over the
distinct n-grams, and so are the back-offs of n-grams that stand only in texts
not learned from. For scoring, texts are dealt to blocks of ``BLOCK`` bytes and each
block gets the probabilities of its own distinct n-grams by a join: no n-gram is
left out, and no task holds the model.

A language's perplexity band is set from all its scored texts: the median of the
mean negative log-probability, plus or minus ``spread`` scaled median absolute
deviations, and at least ``above`` or ``below`` nats a byte.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapweave.llm._common import bucketed, chunks, give_back, written
from snapweave.llm._words import _SPACE, mix, words

ORDER = 5
#: Bytes of text in a block: bounds what one scoring task holds.
BLOCK = 32 << 20
_PAD = bytes(ORDER - 1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WINDOW = 8
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each text and ``base_failed``."""
    m = len(texts)
    h, doc = words(texts)
    n = np.bincount(doc, minlength=m)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, m))

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])
        return np.diff(sums[np.concatenate([[0], ends])])

    chars = total(~_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = total(_SYMBOL[data])
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated = np.zeros(m, np.int64)
    if len(h) >= _WINDOW:
        size = len(h) - _WINDOW + 1
        win, c = np.zeros(size, np.uint64), 1
        for i in range(_WINDOW):
            win += h[i : i + size] * np.uint64(c)
            c = c * 0xC2B2AE3D27D4EB4F % (1 << 64)
        at = np.flatnonzero(doc[:size] == doc[_WINDOW - 1 :])
        win = mix(win[at] ^ mix(doc[at].astype(np.uint64)))  # windows of different texts never meet
        order = np.argsort(win, kind="stable")
        same = win[order][1:] == win[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + _WINDOW, -1)
        repeated = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=m)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeated, "base_failed": (n < 20) | (100 * repeated > 30 * n)}


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram that ends at each byte but NUL, and the text it is in; texts start after padding."""
    data = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
    g = np.zeros(len(data), np.uint64)
    for i in range(ORDER):
        g[ORDER - 1 :] |= data[i : len(data) - ORDER + 1 + i].astype(np.uint64) << np.uint64(8 * (ORDER - 1 - i))
    doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + len(_PAD) for t in texts), np.int64, len(texts)))
    real = data != 0
    return g[real], doc[real]


def _by_language(langs: list, take: np.ndarray) -> Iterator[tuple[str, list[int]]]:
    found: dict[str, list[int]] = {}
    for i in np.flatnonzero(take).tolist():
        found.setdefault(langs[i] or "", []).append(i)
    yield from found.items()


class _Zipped(io.RawIOBase):
    """A sink that holds what is written to it compressed."""

    def __init__(self) -> None:
        self.parts, self.zip = [], zstandard.ZstdCompressor(level=6).compressobj()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.parts.append(self.zip.compress(data))
        return len(data)

    def bytes(self) -> bytes:
        return b"".join([*self.parts, self.zip.flush()])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the task in blocks of about ``BLOCK`` bytes: number and compressed Arrow stream of each."""
    number, size, sink, writer = TaskContext.get().partitionId() << 32, 0, None, None

    def out() -> pa.RecordBatch:
        writer.close()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.bytes()], pa.binary())], names=["block", "rows"])

    for part in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        if sink is None:
            sink = _Zipped()
            writer = pa.ipc.new_stream(pa.PythonFile(sink, "w"), part.schema)
        writer.write_batch(part)
        size += part.nbytes
        if size >= BLOCK:
            yield out()
            number, size, sink = number + 1, 0, None
    if sink is not None:
        yield out()
    sink = writer = None
    give_back()


def _unpacked(rows: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(pa.PythonFile(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(rows)), "r"))


def _merged(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[: len(g)])
    return g[new], np.add.reduceat(c, new) if len(new) else c


def _count(carried: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct n-grams of all texts to score, with their counts in texts that are learned from (0: in none)."""
    for b in batches:
        for block, rows in zip(*(b.column(i).to_pylist() for i in range(2))):
            held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            parts = (pa.RecordBatch.from_arrays([r.column(carried), r.column(carried + 1)], names=["text", "lang"]) for r in _unpacked(rows))
            for texts, langs in chunks(parts, 0, 1 << 20):
                raw = [(t or "").encode() for t in texts]
                found = stats(raw)
                plain = 10 * found["n_symbols"] <= found["n_words"]
                for learn in (True, False):
                    for lang, at in _by_language(langs, ~found["base_failed"] & (plain == learn)):
                        g = _grams([raw[i] for i in at])[0]
                        g, c = _merged(g, np.full(len(g), int(learn), np.int64))
                        if lang in held:
                            g, c = _merged(np.concatenate([held[lang][0], g]), np.concatenate([held[lang][1], c]))
                        held[lang] = (g, c)
            for lang, (g, c) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), block, np.int64)), pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], names=["block", "lang", "g", "c"])


def kneser_ney(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """For each order, the probabilities ``lang, g, p`` of its n-grams and the back-off weights ``lang, ctx, gamma`` of their contexts."""
    tables = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (8 * m)) - 1)
        tables[m] = written(tables[m + 1].groupBy("lang", F.col("g").bitwiseAND(mask).alias("g")).agg(F.count("*").alias("c")), "grams")
    found, weights, lower = {}, {}, None
    for m in range(1, ORDER + 1):
        t = tables[m]
        seen = t.groupBy("lang").agg(*[F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)])
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))

        def discount(i: int):
            d = i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")
            usable = (F.col(f"t{i}") > 0) & (F.col(f"t{i + 1}") > 0) & (F.col("t1") > 0)
            return F.greatest(F.least(F.when(usable, d).otherwise(F.lit(0.5 * i)), F.lit(i - 0.05)), F.lit(0.05))

        # a row per language, of a size known before the join is planned: n-grams need not be dealt by language
        discounts = written(seen.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]), "discounts")
        with_d = t.join(discounts, "lang")
        with_d = with_d.withColumns({"d": F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")), "ctx": F.shiftrightunsigned("g", 8)})
        contexts = with_d.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        contexts = written(contexts, "contexts")
        own = with_d.join(contexts, ["lang", "ctx"]).withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if lower is None:
            probs = own.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            mask = F.lit((1 << (8 * (m - 1))) - 1)
            below = lower.select("lang", F.col("g").alias("suffix"), F.col("p").alias("below"))
            probs = own.withColumn("suffix", F.col("g").bitwiseAND(mask)).join(below, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("below"))
        lower = found[m] = written(probs.select("lang", "g", "p"), "probabilities")
        weights[m] = contexts.select("lang", "ctx", "gamma")
    return found, weights


def log_probabilities(counts: DataFrame) -> DataFrame:
    """``lang, g, logp`` of every n-gram of ``counts``; those with count 0 back off, through all orders."""
    found, weights = kneser_ney(counts.where("c > 0"))
    out = [found[ORDER].select("lang", "g", "p")]
    todo = counts.where("c = 0").select("lang", "g", F.lit(1.0).alias("factor"))
    for m in range(ORDER, 0, -1):
        ctx = F.shiftrightunsigned(F.col("g").bitwiseAND(F.lit((1 << (8 * m)) - 1)), 8)
        todo = todo.withColumn("ctx", ctx).join(weights[m], ["lang", "ctx"], "left")
        todo = todo.select("lang", "g", (F.col("factor") * F.coalesce("gamma", F.lit(1.0))).alias("factor"))
        if m == 1:
            out.append(todo.select("lang", "g", (F.col("factor") / 256).alias("p")))
            break
        below = found[m - 1].select("lang", F.col("g").alias("suffix"), F.col("p").alias("below"))
        suffix = F.col("g").bitwiseAND(F.lit((1 << (8 * (m - 1))) - 1))
        todo = written(todo.withColumn("suffix", suffix).join(below, ["lang", "suffix"], "left"), "backed_off")
        out.append(todo.where("below is not null").select("lang", "g", (F.col("factor") * F.col("below")).alias("p")))
        todo = todo.where("below is null").select("lang", "g", "factor")
    return functools.reduce(DataFrame.unionByName, out).select("lang", "g", F.log("p").cast("float").alias("logp"))


class Model:
    """Log-probabilities of the n-grams of one block, in sorted arrays by language."""

    def __init__(self, langs: np.ndarray, g: np.ndarray, logs: np.ndarray) -> None:
        self.tables = {}
        for lang in set(langs.tolist()):
            own = langs == lang
            order = np.argsort(g[own], kind="stable")
            self.tables[lang] = (g[own][order].astype(np.uint64), logs[own][order])

    def logp(self, g: np.ndarray, lang: str) -> np.ndarray:
        """Log-probability of the last byte of each packed n-gram after those before it; every one of them is in the block's table."""
        keys, logs = self.tables[lang]
        i = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        if not (keys[i] == g).all():
            raise ValueError("an n-gram of the block has no probability")
        return logs[i]

    def score(self, texts: list[bytes], langs: list, take: np.ndarray) -> np.ndarray:
        """Mean negative log-probability per byte of the texts to ``take``; NaN elsewhere and where a text has no bytes."""
        out = np.full(len(texts), np.nan)
        for lang, at in _by_language(langs, take):
            g, doc = _grams([texts[i] for i in at])
            both = np.sort(g << np.uint64(24) | doc.astype(np.uint64))
            g, doc = both >> np.uint64(24), (both & np.uint64(0xFFFFFF)).astype(np.int64)
            new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
            values = self.logp(g[new], lang)[np.cumsum(new) - 1] if len(g) else np.zeros(0)
            with np.errstate(invalid="ignore"):
                out[at] = -np.bincount(doc, values, len(at)) / np.bincount(doc, minlength=len(at))
        return out


def _score(model, carried: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: the carried ones, then text and language."""
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        start = size = 0
        texts = batch.column(carried).to_pylist()
        for i, t in enumerate(texts):
            size += len(t or "")
            if size < 1 << 20 and i + 1 < len(texts):
                continue
            part = batch.slice(start, i + 1 - start)
            raw = [(t or "").encode() for t in texts[start : i + 1]]
            langs = part.column(carried + 1).to_pylist()
            found = stats(raw)
            nll = model.score(raw, langs, ~found["base_failed"])
            arrays = [part.column(k) for k in range(carried)] + [pa.array([x or "" for x in langs])] + [pa.array(found[s], pa.int64()) for s in STATS]
            arrays += [pa.array(found["base_failed"]), pa.array(nll, from_pandas=True)]
            names = [f"c{k}" for k in range(carried)] + ["lang", *STATS, "base_failed", "nll"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            start, size = i + 1, 0


def _score_block(carried: int, packed: pa.Table, values: pa.Table) -> pa.Table:
    """A block's rows with their scores."""
    langs = values["lang"].combine_chunks().dictionary_encode() if values.num_rows else None
    names = np.array(langs.dictionary.to_pylist(), object)[langs.indices.to_numpy()] if langs is not None else np.zeros(0, object)
    model = Model(names, values["g"].to_numpy(), values["logp"].to_numpy())
    out = pa.Table.from_batches([s for rows in packed["rows"].to_pylist() for s in _score(model, carried, _unpacked(rows))])
    give_back()
    return out


def judge(df: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", spread: float = 8.0, above: float = 0.5, below: float = 1.0) -> DataFrame:
    """The ``carry`` columns of every row, then the counts, ``base_failed``, ``perplexity`` (a byte; null if not scored) and ``kept``.

    Null and empty texts have no words, so they fail the plain rules; null languages count as
    one language. An empty table gives no rows. Every row is judged by itself, repeated or not.
    """
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    fields += [T.StructField("lang", T.StringType())] + [T.StructField(s, T.LongType()) for s in STATS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("nll", T.DoubleType())]
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(carry)], df[text_col].alias("text"), df[lang_col].cast("string").alias("lang_"))
    # numbers of blocks stay as they are from here on; texts are not shuffled, only probabilities are, to the buckets of their blocks
    packed = bucketed(rows.mapInArrow(_packed, "block long, rows binary"), "packed", "block")
    grams = written(packed.mapInArrow(functools.partial(_count, len(carry)), "block long, lang string, g long, c long"), "grams")
    logs = written(log_probabilities(written(grams.groupBy("lang", "g").agg(F.sum("c").alias("c")), "counts")), "logs")
    values = grams.select("block", "lang", "g").join(logs, ["lang", "g"]).select("block", "lang", "g", "logp")
    score = functools.partial(_score_block, len(carry))
    scored = written(packed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(lambda p, v: score(p, v), T.StructType(fields)), "scored")

    middle = written(scored.where("nll is not null").groupBy("lang").agg(F.percentile_approx("nll", 0.5, 10000).alias("middle")), "medians")
    away = scored.select("lang", "nll").where("nll is not null").join(middle, "lang").withColumn("away", F.abs(F.col("nll") - F.col("middle")))
    bands = away.groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx("away", 0.5, 10000).alias("mad"))
    wide = spread * 1.4826 * F.col("mad")
    bands = written(bands.select("lang", (F.col("middle") - F.greatest(F.lit(below), wide)).alias("low"), (F.col("middle") + F.greatest(F.lit(above), wide)).alias("high")), "bands")
    inside = F.col("nll").between(F.col("low"), F.col("high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return scored.join(bands, "lang", "left").select(*own, *STATS, "base_failed", F.exp("nll").alias("perplexity"), kept.alias("kept"))
