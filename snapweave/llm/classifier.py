"""Quality classifier: logistic regression on hashed word n-grams.

Features are the 1- and 2-grams of a text's words and of the words' shapes
(classes of characters, runs merged), hashed to ``2**BITS`` weights and weighted
``log(1 + count)``, scaled to unit length. Training follows the regularised
leader (FTRL-proximal): each of ``SHARDS`` tasks makes ``epochs`` passes over its
rows, and the shards' weights are averaged. A score is the sigmoid of a sparse
dot product with the weights, which are broadcast: ``2**BITS`` numbers always.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapweave.llm._common import chunks, written
from snapweave.llm._words import _SPACE, mix, prefix_sums, slice_hashes

BITS = 20
SHARDS = 4
#: Labelled rows that are learnt from at most, those of the least hash.
TRAIN_ROWS = 20_000
#: Class of each byte: lower 1, upper 2, digit 3, beyond ASCII 4, every other byte its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 1, 2, 3, 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value, sorted by text and feature; a text without words has only the constant feature 0."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(ends, start, side="right")
    word = slice_hashes(prefix_sums(data), start, end)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | space[1:] | space[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = slice_hashes(prefix_sums(kind[keep]), at[start], at[end])
    docs, hashes = [], []
    for salt, h in ((1, word), (2, shape)):
        h = mix(h ^ np.uint64(salt))
        two = mix(h[:-1] * np.uint64(3) + h[1:])
        same = doc[1:] == doc[:-1]
        docs += [doc, doc[1:][same]]
        hashes += [h, two[same]]
    docs.append(np.arange(len(texts)))
    slot = np.concatenate([(np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.zeros(len(texts), np.int64)])
    both = np.sort(np.concatenate(docs) << BITS | slot)
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(both)))
    doc, slot = both[new] >> BITS, both[new] & ((1 << BITS) - 1)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    return doc, slot, value / norm[doc]


def ftrl(texts: list[bytes], labels: np.ndarray, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal updates, one row at a time."""
    sparse = []
    for start in range(0, len(texts), 200):  # a few texts at a time: features need much more room while they are made
        part = texts[start : start + 200]
        doc, slot, value = features(part)
        cuts = np.searchsorted(doc, np.arange(len(part) + 1)).tolist()
        sparse += [(slot[a:b].astype(np.int32), value[a:b].astype(np.float32)) for a, b in zip(cuts, cuts[1:])]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for t in rng.permutation(len(texts)).tolist():
            i, x = sparse[t]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[t]) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def _train(options: dict, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["id", "label", "text"])
    w = ftrl([t.encode() for t in part["text"]], part["label"].to_numpy(float), **options)
    at = np.flatnonzero(w)
    return pd.DataFrame({"slot": at, "weight": w[at]})


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", most: int = TRAIN_ROWS, epochs: int = 10, alpha: float = 4.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001) -> np.ndarray:
    """Weights learnt from ``rows``; at most about ``most`` of them, chosen by a hash of their id. Rows with a null label or id are left out; a null text is empty."""
    ids = rows.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    options = {"epochs": epochs, "alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(SHARDS)).cast("int")
    learnt = ids.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda p: _train(options, p), "slot long, weight double")
    found = learnt.groupBy("slot").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()  # at most 2**BITS rows
    weights = np.zeros(1 << BITS)
    weights[found["slot"].to_numpy()] = found["weight"].to_numpy()
    return weights.astype(np.float32)


def bounded(labels: DataFrame, id_col: str = "doc_id", most: int = TRAIN_ROWS) -> DataFrame:
    """About ``most`` rows of ``labels`` at most: those whose id's hash is below a bound set from their number."""
    total = labels.count()
    if total <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 30)) < int(most / total * (1 << 30)))


def _scores(weights, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for ids, texts in chunks(batches, 1, 1 << 20):
        doc, slot, value = features([(t or "").encode() for t in texts])
        dot = np.bincount(doc, w[slot] * value, minlength=len(texts))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], names=["doc_id", "score"])


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1. Null texts are scored as empty ones; repeated rows and null ids are scored like others."""
    model = df.sparkSession.sparkContext.broadcast(weights)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    return rows.mapInArrow(functools.partial(_scores, model), "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train_and_score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``; learns from labelled rows that aren't held out. An id labelled more than once gets the mean label; an id that stands on several texts teaches with each."""
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.avg(label_col).alias("label"))
    known = written(bounded(known), "labels")
    taught = written(docs.select("doc_id", "text").join(known, "doc_id"), "taught")
    out = score(docs, fit(taught))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
