"""Quality rules by line sequence labelling.

A document's lines are a sequence; a linear-chain conditional random field with the states content and boilerplate scores it,
and Viterbi decoding labels each line. A document stays if content lines hold at least ``share`` of its words and no base rule
fails it.

The field is trained here: a bounded sample of labelled documents (``sample``; the least by a hash of doc_id, of at most 64 KB each) gives sequences
of line features. Lines of good documents are content; which lines of bad documents are boilerplate is estimated by turns of
decoding and training, starting from all of them. Training maximises the conditional likelihood by forward-backward gradients.
Training cuts the sample's sequences into runs of ``LINES`` lines, each starting with the last line of the one before, so that every
transition is in one of them; decoding takes whole documents.

Defined results: null or empty text has no words, so the base rule fails it; without usable labels the field calls every line
content and the base rules decide alone; a null doc_id stays null; equal rows each give a row.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, batch, own_names, slices
from .labelled import sampled

SAMPLE, LINES, SHARE = 1_500, 32, 0.5
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BARE = re.compile(r"(?<![^\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])")
_SHOUT = re.compile(r"[!?]{2,}")
#: What str.isdigit holds for: decimal digits and those like superscripts.
_DIGITS = re.compile("[" + "\\d" + "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()) + "]")
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
FEATURES = ("bias", "symbols", "upper", "shouts", "duplicate", "short", "digits", "repeated", "long words", "bare symbols")
_BASE = "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean"


def repeats(words: list[str]) -> np.ndarray:
    """For each word, whether it lies in a 3-word window that the text has twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) > 3:
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        _, back, n = np.unique(h[:-2] * _ODD[0] + h[1:-1] * _ODD[1] + h[2:] * _ODD[2], return_inverse=True, return_counts=True)
        twice = n[back] > 1
        for k in range(3):
            out[k : len(words) - 2 + k] |= twice
    return out


def analyse(text: str) -> tuple[tuple, np.ndarray, np.ndarray]:
    """The base counts, a row of features per line with a word, and the words per such line."""
    lines, words, of_line, seen, dup = [], [], [], set(), []
    for line in text.split("\n"):
        if own := WORD.findall(line):
            lines.append(line)
            words += own
            of_line.append(len(own))
            dup.append(line in seen)
            seen.add(line)
    repeated = repeats(words)
    n, again = len(words), int(repeated.sum())
    base = (n, sum(map(len, words)), len(_SYMBOLS.findall(text)), sum(dup), again, n < 50 or 100 * again > 50 * n)
    rows = np.zeros((len(lines), len(FEATURES)), np.float32)
    if lines:
        counts = np.array(of_line)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        rows[:, 0] = 1
        rows[:, 1] = np.minimum([len(_SYMBOLS.findall(x)) for x in lines] / counts, 3)
        rows[:, 2] = np.add.reduceat(np.fromiter(map(str.isupper, words), bool, n).astype(np.float32), starts) / counts
        rows[:, 3] = np.minimum([len(_SHOUT.findall(x)) for x in lines] / counts, 1)
        rows[:, 4] = dup
        rows[:, 5] = counts < 3
        rows[:, 6] = [len(_DIGITS.findall(x)) / len(x) for x in lines]
        rows[:, 7] = np.add.reduceat(repeated.astype(np.float32), starts) / counts
        rows[:, 8] = np.add.reduceat(np.fromiter(map(len, words), np.float32, n) > 25, starts, dtype=np.float32) / counts
        rows[:, 9] = [len(_BARE.findall(x)) for x in lines] / counts
        return base, rows, counts
    return base, rows, np.zeros(0, np.int64)


class Field:
    """A linear-chain conditional random field of two states: 0 content, 1 boilerplate."""

    def __init__(self):
        self.w = np.zeros((len(FEATURES), 2))
        self.w[0, 0] = 1.0
        self.t = np.zeros((2, 2))

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        e = (rows @ self.w).tolist()
        (aa, ab), (ba, bb) = self.t.tolist()
        back = []
        s0, s1 = e[0]
        for x0, x1 in e[1:]:
            p, q, r, s = s0 + aa, s1 + ba, s0 + ab, s1 + bb
            back.append((q > p, s > r))
            s0, s1 = (q if q > p else p) + x0, (s if s > r else r) + x1
        at = int(s1 > s0)
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return np.array(out[::-1])

    def fit(self, x: np.ndarray, there: np.ndarray, y: np.ndarray, steps: int = 80, rate: float = 0.7, decay: float = 1e-3):
        """x: (documents, lines, features); there: which lines exist; y: states. Gradients of the mean log-likelihood per line."""
        n, m, _ = x.shape
        hot = np.eye(2)[y] * there[..., None]
        total = there.sum()
        both = there[:, 1:] & there[:, :-1]
        seen = np.einsum("nia,nib->ab", hot[:, :-1] * both[..., None], hot[:, 1:])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for _ in range(steps):
            e = x @ self.w
            a, b = np.zeros((n, m, 2)), np.zeros((n, m, 2))
            a[:, 0] = e[:, 0]
            t = self.t
            for i in range(1, m):
                for k in (0, 1):
                    a[:, i, k] = np.where(there[:, i], np.logaddexp(a[:, i - 1, 0] + t[0, k], a[:, i - 1, 1] + t[1, k]) + e[:, i, k], a[:, i - 1, k])
            for i in range(m - 2, -1, -1):
                f0, f1 = e[:, i + 1, 0] + b[:, i + 1, 0], e[:, i + 1, 1] + b[:, i + 1, 1]
                for k in (0, 1):
                    b[:, i, k] = np.where(there[:, i + 1], np.logaddexp(t[k, 0] + f0, t[k, 1] + f1), 0)
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            p = np.exp(a + b - z[:, None, None]) * there[..., None]
            pair = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            gw = 0.8 * gw + np.einsum("nif,nis->fs", x, hot - p) / total - decay * self.w
            gt = 0.8 * gt + (seen - pair.sum((0, 1))) / total - decay * self.t
            self.w += rate * gw
            self.t += rate * gt


def runs(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All lines in runs of LINES at most: (runs, lines, features), which lines exist, and (sequence, first line) of each run."""
    of = [(i, a) for i, r in enumerate(sequences) for a in range(0, max(len(r) - 1, 1), LINES - 1)]
    x, there = np.zeros((len(of), LINES, len(FEATURES))), np.zeros((len(of), LINES), bool)
    for k, (i, a) in enumerate(of):
        own = sequences[i][a : a + LINES]
        x[k, : len(own)], there[k, : len(own)] = own, True
    return x, there, of


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, turns: int = 3) -> Field:
    """The field from the documents of ``labels`` (doc_id, quality)."""
    chosen = sampled(docs.select(F.col("doc_id").cast("long"), "text"), labels, "quality", F.lit(True), sample)
    rows_ddl = "quality int,rows binary"
    schema = arrow_schema(rows_ddl)

    def features(batches):
        for b in slices(batches):
            rows = [analyse(t)[1].tobytes() for t in b.column(1).to_pylist()]
            yield batch(schema, [b.column(0), rows])

    found = chosen.select(F.col("y").alias("quality"), "text").mapInArrow(features, rows_ddl).collect()
    found = sorted((bytes(r.rows), int(r.quality)) for r in found if r.rows)
    field = Field()
    if len({q for _, q in found}) < 2:
        return field
    rows_ = [np.frombuffer(r, np.float32).reshape(-1, len(FEATURES)) for r, _ in found]
    x, there, of = runs(rows_)
    bad = np.array([q == 0 for _, q in found])
    states = [np.full(len(r), int(b)) for r, b in zip(rows_, bad, strict=True)]
    for turn in range(turns):
        y = np.zeros(there.shape, int)
        y[there] = np.concatenate([states[i][a : a + LINES] for i, a in of])
        field.fit(x, there, y)
        if turn < turns - 1:
            for i in np.flatnonzero(bad):
                new = field.viterbi(rows_[i])
                if new.any():
                    states[i] = new
    return field


def label_lines(field: Field, text: str) -> list[tuple[str, int]]:
    """Each line with a word, and its state."""
    _, rows, _ = analyse(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return list(zip(lines, field.viterbi(rows).tolist(), strict=True)) if lines else []


def judge(docs: DataFrame, labels: DataFrame, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the content share of each document."""
    return _judged(docs, labels, share, sample, ["doc_id"])


def _judged(docs, labels, share, sample, keep):
    from pyspark.sql.types import StructType

    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    out = StructType([*docs.select(keep).schema.fields, *StructType.fromDDL(_BASE + ",kept boolean,content_share double").fields])
    own = arrow_schema(_BASE + ",kept boolean,content_share double")

    def run(batches):
        import pyarrow as pa

        f = field.value
        for b in slices(batches):
            results = []
            for t in b.column("text").to_pylist():
                base, rows, counts = analyse(t or "")
                content = float(counts[f.viterbi(rows) == 0].sum() / counts.sum()) if len(counts) else 0.0
                results.append((*base, not base[-1] and content >= share, content))
            cols = [pa.array(c, t) for c, t in zip(zip(*results, strict=True), own.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], names=[*keep, *own.names])

    inputs = docs.select(*keep, *([] if "text" in keep else ["text"]))
    return inputs.mapInArrow(run, out)


def keep_good(docs: DataFrame, labels: DataFrame, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    names = docs.columns
    inner = own_names(docs)
    return _judged(inner, labels, share, sample, inner.columns).where("kept").select(inner.columns).toDF(*names)
