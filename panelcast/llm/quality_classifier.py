"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of its words: each whole word, in lower case, is hashed to one of ``TERMS`` counts, and its shape (case, digits
and symbols, runs collapsed) to one of ``DIMS``; how often words follow themselves and word pairs come again adds two counts,
each in ``LEVELS`` steps. Logarithmic counts weighted by inverse document frequency are projected on the leading singular
directions of a bounded sample of labelled documents (``sample``, the least by a hash of doc_id, of at most 64 KB each, half of
them of either label if there are as many). The sample's vectors and labels, a few hundred KB, are broadcast. Every document is
compared with all of them by exact cosines, a block of documents at a time; its score is the mean label of the ``k`` most
similar, weighted by a power of the similarity.

Defined results: a text without words has no direction and gets the sample's mean label; with fewer than two labels in the
sample every score is that mean (0.5 without labels); null text is empty; a null doc_id counts as held out and stays null;
equal rows each give a row with the same score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, batch, own_names, slices
from .labelled import fold, sampled

SAMPLE, TERMS, DIMS, RANK, K, POWER, THRESHOLD = 3_000, 2_048, 384, 64, 15, 8, 0.3
#: The count that a step of repetition stands for, as a share of the words.
REPEATS = 0.3
LEVELS = np.array([0.02, 0.1, 0.3, 0.6])
WIDTH = TERMS + DIMS + 2 * (len(LEVELS) + 1)
_RUNS = re.compile(r"(.)\1+")
_OUT = "doc_id long,held_out boolean,score double,predicted int"


def shape(word: str) -> str:
    """The word with letters as a or A, digits as 0, and runs collapsed."""
    return _RUNS.sub(r"\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


class _Codes(dict):
    """Word to its two hashed features, packed; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = code = zlib.crc32(shape(word).encode()) % DIMS * TERMS + zlib.crc32(word.lower().encode()) % TERMS
        return code


_codes = _Codes()


def counts(text: str) -> np.ndarray:
    words = WORD.findall(text)
    codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    out = np.zeros(WIDTH, np.float32)
    if n := len(words):
        out[:TERMS] = np.bincount(codes % TERMS, minlength=TERMS) / n
        out[TERMS : TERMS + DIMS] = np.bincount(codes // TERMS, minlength=DIMS) / n
        h = np.fromiter(map(hash, words), np.int64, n)
        pairs = h[1:] * 1_000_003 + h[:-1]
        again = 1 - len(np.unique(pairs)) / len(pairs) if n > 1 else 0
        same = (h[1:] == h[:-1]).mean() if n > 1 else 0
        for k, x in enumerate((same, again)):
            out[TERMS + DIMS + k * (len(LEVELS) + 1) + np.searchsorted(LEVELS, x)] = REPEATS
    return out


class Space:
    """Weights, directions, and the labelled vectors."""

    def __init__(self, rows: np.ndarray, y: np.ndarray, rank: int = RANK):
        self.mean = float(y.mean()) if len(y) else 0.5
        self.usable = len(set(y.tolist())) > 1
        if not self.usable:
            return
        self.weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
        x = self._weighted(rows)
        # subspace iteration from a fixed start: nothing as wide as the counts squared is held
        q = np.random.default_rng(3).normal(0, 1, (x.shape[1], rank + 16)).astype(np.float32)
        for _ in range(8):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.directions = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
        self.vectors, _ = self._unit(x @ self.directions)
        self.y = y.astype(np.float32)

    def _weighted(self, rows):
        return np.log1p(rows * 100) * self.weight

    @staticmethod
    def _unit(v):
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.maximum(n, 1e-12), n[:, 0] > 0

    def score(self, rows: np.ndarray, k: int = K, power: int = POWER) -> np.ndarray:
        if not self.usable:
            return np.full(len(rows), self.mean)
        v, some = self._unit(self._weighted(rows) @ self.directions)
        cos = v @ self.vectors.T
        k = min(k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 1e-6).astype(np.float64) ** power
        return np.where(some, np.clip((w * self.y[near]).sum(1) / w.sum(1), 0, 1), self.mean)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    ddl = "doc_id long,y int,at binary,value binary"
    schema = arrow_schema(ddl)

    def features(batches):
        for b in slices(batches):
            rows = [counts(t) for t in b.column(1).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield batch(schema, [b.column(0), b.column(2), [a.astype(np.uint16).tobytes() for a in at], [r[a].tobytes() for r, a in zip(rows, at, strict=True)]])

    chosen = sampled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "quality", fold(5) != 0, sample, balance=True, fill=True)
    found = sorted(chosen.select("doc_id", "text", "y").mapInArrow(features, ddl).collect(), key=lambda r: r.doc_id)
    rows = np.zeros((len(found), WIDTH), np.float32)
    for row, r in zip(rows, found, strict=True):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.value, np.float32)
    return Space(rows, np.array([r.y for r in found], int))


def _scored(docs, labels, sample, keep):
    from pyspark.sql.types import StructType

    space = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    out = StructType([*docs.select(keep).schema.fields, *StructType.fromDDL("score double").fields])

    def run(batches):
        import pyarrow as pa

        s = space.value
        for b in slices(batches):
            rows = np.array([counts(t or "") for t in b.column("text").to_pylist()], np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s.score(rows), pa.float64())], names=[*keep, "score"])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, out)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = _scored(docs.select(F.col("doc_id").cast("long"), "text"), labels, sample, ["doc_id"])
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted to be good, with their columns."""
    names = docs.columns
    inner = own_names(docs)
    return _scored(inner, labels, sample, inner.columns).where(F.col("score") >= threshold).select(inner.columns).toDF(*names)
