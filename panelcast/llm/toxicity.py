"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as the sum of a hashed word embedding and the mean embedding of its hashed character n-grams. Windows of
``WINDOW`` words that overlap by half cover the whole text; each is read in both directions, its states are pooled by learnt
attention, and one output unit gives its logit. A document's score is the sigmoid of its largest window logit.

Labels belong to documents, not to windows: training pools the window logits of a document by a log-mean-exp, so the gradient
finds the windows that make a document toxic. It uses a bounded sample of labelled documents (``sample``, of at most 64 KB each,
half of them toxic if there are as many) and at most ``DRAWN`` windows of each toxic one and ``DRAWN_CLEAN`` of each other one per pass, drawn anew. Scoring reads all windows of all documents.

A worker keeps the gate inputs of the words that it has met in a bounded table, so a step costs a look-up and one small matrix
product for many windows at once.

Defined results: null and empty texts have no words and score 0; without both labels in the sample every other score is the
mean label (0 without labels); equal rows each give a row; a null doc_id counts as not held out unless the checksum of the empty text says so, and stays null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_schema, batch, slices
from .labelled import fold, sampled

SAMPLE, DRAWN, DRAWN_CLEAN, STEPS, RATE = 2_400, 20, 14, 420, 0.025
WINDOW, STRIDE, HIDDEN, DIMS, BUCKETS, GRAMS = 32, 16, 8, 16, 1 << 14, (3, 4, 6)
POOL, THRESHOLD = 2.0, 0.7
#: Characters of a token.
LONGEST = 200
#: Words whose gate inputs a worker keeps.
KEPT = 150_000
_OUT = "doc_id long,held_out boolean,score double,predicted int"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def words_of(text: str) -> list[str]:
    """The words; one over ``LONGEST`` characters as consecutive pieces, so that all of it is read."""
    words = WORD.findall(text)
    if not words or len(max(words, key=len)) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of words: (rows, word of each row, weight). Rows below BUCKETS are of words, the others of n-grams."""
    lower = ["\x02" + w.lower() + "\x03" for w in words]
    codes = np.frombuffer("".join(lower).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    whole = np.add.reduceat(codes * (np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64) + np.uint64(7)) ** np.uint64(5), starts)
    rows, owners = [_mix(whole)], [np.arange(len(words))]
    for n in GRAMS:
        count = max(len(codes) - n + 1, 0)
        h = np.full(count, n, np.uint64)
        for j in range(n):
            h += codes[j : count + j] * _MULTIPLIERS[j]
        ok = left[: len(h)] >= n
        rows.append(_mix(h[ok]) + BUCKETS)
        owners.append(owner[: len(h)][ok])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    grams = np.maximum(np.bincount(owners, minlength=len(words)) - 1, 1)
    weight = np.where(np.arange(len(rows)) < len(words), 1.0, 1.0 / grams[owners]).astype(np.float32)
    order = np.argsort(owners, kind="stable")
    return rows[order], owners[order], weight[order]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """e: embeddings; wx, bx: gate inputs of both directions; u: recurrent weights; q: attention; w, b: output."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *s: g.normal(0, 1, s).astype(np.float32)
        self.p = {"e": 0.1 * f(2 * BUCKETS, DIMS), "wx": f(DIMS, 6 * HIDDEN) / np.float32(DIMS**0.5), "bx": np.zeros(6 * HIDDEN, np.float32), "u": f(2, HIDDEN, 3 * HIDDEN) / np.float32(HIDDEN**0.5), "q": 0.1 * f(2 * HIDDEN), "w": 0.3 * f(2 * HIDDEN), "b": np.full(1, -1, np.float32)}
        self.constant: float | None = None

    def embed(self, words: list[str]) -> np.ndarray:
        rows, owners, weight = features(words)
        return self.summed(rows, owners, weight, len(words))

    def summed(self, rows, owners, weight, n: int) -> np.ndarray:
        return np.add.reduceat(self.p["e"][rows] * weight[:, None], np.searchsorted(owners, np.arange(n)))

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["wx"] + self.p["bx"]

    def windows(self, g: np.ndarray, length: np.ndarray | None = None, keep: bool = False):
        """Logits of windows from gate inputs (steps, windows, 6 * HIDDEN); length: steps used, where not all are."""
        steps, n, _ = g.shape
        g = g.reshape(steps, n, 2, 3 * HIDDEN)
        u, h = self.p["u"], np.zeros((2, n, HIDDEN), np.float32)
        states, saved = np.empty((steps, 2, n, HIDDEN), np.float32), []
        for t in range(steps):
            x = np.stack([g[t, :, 0], g[steps - 1 - t, :, 1]])
            a = h @ u
            zr = _sigmoid(x[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            if length is not None:
                there = np.stack([t < length, steps - 1 - t < length])[..., None]
                new = np.where(there, new, h)
            if keep:
                saved.append((h, a[..., 2 * HIDDEN :], zr, c))
            states[t] = h = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        s = both @ self.p["q"]
        if length is not None:
            s = np.where(np.arange(steps)[:, None] < length, s, -1e9)
        s = np.exp(s - s.max(0))
        alpha = s / s.sum(0)
        pooled = np.einsum("tn,tnh->nh", alpha, both)
        logit = pooled @ self.p["w"] + self.p["b"][0]
        return logit if not keep else (logit, (saved, both, alpha, pooled))

    def back(self, dlogit: np.ndarray, kept, length: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of parameters and of the gate inputs."""
        saved, both, alpha, pooled = kept
        steps, n, _ = both.shape
        d = {"w": dlogit @ pooled, "b": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * self.p["w"]
        dalpha = np.einsum("nh,tnh->tn", dpooled, both)
        ds = alpha * (dalpha - (alpha * dalpha).sum(0))
        d["q"] = np.einsum("tn,tnh->h", ds, both)
        dboth = alpha[..., None] * dpooled + ds[..., None] * self.p["q"]
        dg = np.zeros((steps, n, 2, 3 * HIDDEN), np.float32)
        du, dh = np.zeros_like(self.p["u"]), np.zeros((2, n, HIDDEN), np.float32)
        back_u = np.swapaxes(self.p["u"], 1, 2)
        for t in range(steps - 1, -1, -1):
            h, an, zr, c = saved[t]
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            there = np.stack([t < length, steps - 1 - t < length])[..., None]
            dnew = dh + np.stack([dboth[t, :, :HIDDEN], dboth[steps - 1 - t, :, HIDDEN:]])
            dc = np.where(there, dnew, 0) * (1 - z) * (1 - c * c)
            dz = np.where(there, dnew, 0) * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], axis=2)
            du += np.swapaxes(h, 1, 2) @ da
            dh = np.where(there, dnew * z, dnew) + da @ back_u
            gx = np.concatenate([dz, dr, dc], axis=2)
            dg[t, :, 0] += gx[0]
            dg[steps - 1 - t, :, 1] += gx[1]
        d["u"] = du
        return d, dg.reshape(steps, n, 6 * HIDDEN)

    def fit(self, texts: list[list[str]], y: np.ndarray, steps: int = STEPS, drawn: int = DRAWN, rate: float = RATE, seed: int = 11):
        g = np.random.default_rng(seed)
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t]) for t in texts]
        all_rows, all_owners, all_weights = features(list(vocabulary))
        first = np.searchsorted(all_owners, np.arange(len(vocabulary) + 1))
        m1, m2, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        share = y.mean()
        # small samples learn from small batches
        parts = max(1, len(texts) // min(48, max(16, len(texts) // 50)))
        passes = min(40, max(6, round(steps / parts)))
        for turn in range(passes):
            for part in np.array_split(g.permutation(len(texts)), parts):
                rows, lengths, of = [], [], []
                for at, i in enumerate(part):
                    starts = starts_of(len(ids[i]))
                    most = drawn if y[i] else DRAWN_CLEAN
                    for s in starts if len(starts) <= most else g.choice(starts, most, replace=False):
                        own = ids[i][s : s + WINDOW]
                        rows.append(np.pad(own, (0, WINDOW - len(own))))
                        lengths.append(len(own))
                        of.append(at)
                used, back = np.unique(np.array(rows), return_inverse=True)
                index, lengths, of = back.reshape(len(rows), WINDOW), np.array(lengths), np.array(of)
                size = first[used + 1] - first[used]
                fown = np.repeat(np.arange(len(used)), size)
                at = np.arange(len(fown)) + np.repeat(first[used] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                frow, fw = all_rows[at], all_weights[at]
                x = self.summed(frow, fown, fw, len(used))
                logit, kept = self.windows(self.gates(x)[index.T], lengths, keep=True)
                heads = np.flatnonzero(np.diff(of, prepend=-1))
                top = np.maximum.reduceat(logit, heads)
                e = np.exp(POOL * (logit - top[np.cumsum(np.diff(of, prepend=-1) > 0) - 1]))
                group = np.cumsum(np.diff(of, prepend=-1) > 0) - 1
                total, size = np.add.reduceat(e, heads), np.bincount(group)
                pooled = top + np.log(total / size) / POOL
                target = y[part][of[heads]]
                balance = np.where(target == 1, 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02))
                dlogit = ((_sigmoid(pooled) - target) * balance / len(heads))[group] * e / total[group]
                d, dg = self.back(dlogit.astype(np.float32), kept, lengths)
                flat, order = dg.reshape(-1, 6 * HIDDEN), np.argsort(index.T.ravel(), kind="stable")
                dgate = np.add.reduceat(flat[order], np.searchsorted(index.T.ravel()[order], np.arange(len(used))))
                d["wx"], d["bx"] = x.T @ dgate, dgate.sum(0)
                dx = dgate @ self.p["wx"].T
                d["e"] = np.zeros_like(self.p["e"])
                order = np.argsort(frow, kind="stable")
                heads = np.flatnonzero(np.diff(frow[order], prepend=-1))
                d["e"][frow[order][heads]] = np.add.reduceat((dx[fown] * fw[:, None])[order], heads)
                step += 1
                for k, v in d.items():
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.01 * (v * v - m2[k])
                    self.p[k] -= np.float32(rate * min(1, 2 * (1 - turn / passes))) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)


def starts_of(n: int) -> np.ndarray:
    """Where the windows of a text of n words start: every STRIDE words, and once so that the last ends with it."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


class Scorer:
    """A network with a bounded table of the gate inputs of words."""

    def __init__(self, network: Network, kept: int = KEPT):
        self.network, self.kept = network, kept
        self.clear()

    def clear(self):
        fresh: list[str] = []

        class Index(dict):
            def __missing__(self, word):
                self[word] = i = len(self)
                fresh.append(word)
                return i

        self.index, self.fresh = Index(), fresh
        self.table = np.zeros((4096, 6 * HIDDEN), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _fill(self):
        for at in range(0, len(self.fresh), 4096):
            some = self.fresh[at : at + 4096]
            first = self.index[some[0]]
            if first + len(some) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(some)), 6 * HIDDEN), np.float32)])
            self.table[first : first + len(some)] = self.network.gates(self.network.embed(some))
        self.fresh.clear()

    def score(self, texts: list[str], many: int = 2048) -> list[float]:
        if self.network.constant is not None:
            return [self.network.constant if WORD.search(t) else 0.0 for t in texts]
        if len(self.index) > self.kept:
            self.clear()
        docs = [self._ids(words_of(t)) for t in texts]
        self._fill()
        best = np.full(len(texts), -np.inf)
        full, owner = [], []
        short = [i for i, d in enumerate(docs) if 0 < len(d) <= WINDOW]
        for i, d in enumerate(docs):
            if len(d) > WINDOW:
                starts = starts_of(len(d))
                full.append(np.lib.stride_tricks.sliding_window_view(d, WINDOW)[starts])
                owner.append(np.full(len(starts), i))
        if full:
            owner = np.concatenate(owner)
            full = np.concatenate(full)
            for at in range(0, len(full), many):
                np.maximum.at(best, owner[at : at + many], self.network.windows(self.table[full[at : at + many].T]))
        for at in range(0, len(short), many):
            own = short[at : at + many]
            rows = np.array([np.pad(docs[i], (0, WINDOW - len(docs[i]))) for i in own])
            best[own] = self.network.windows(self.table[rows.T], np.array([len(docs[i]) for i in own]))
        return np.where(np.isinf(best), 0.0, _sigmoid(np.clip(best, -30, 30))).tolist()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    chosen = sampled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, "toxic", fold(3) != 1, sample, balance=True)
    # a text at a time reaches the driver, and what stays of it are references to words that all texts share
    shared: dict[str, str] = {}
    rows = [(r.doc_id, [shared.setdefault(w, w) for w in words_of(r.text)], r.y) for r in chosen.select("doc_id", "text", "y").coalesce(8).toLocalIterator()]
    rows = [(w, y) for _, w, y in sorted(rows, key=lambda r: r[0]) if w]
    network, y = Network(), np.array([y for _, y in rows], np.float32)
    if len(set(y.tolist())) < 2:
        network.constant = float(y.mean()) if len(y) else 0.0
    else:
        network.fit([w for w, _ in rows], y)
    return network


@lru_cache(maxsize=1)
def _scorer(key: str, network: Network) -> Scorer:
    return Scorer(network)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    network = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    ddl = "doc_id long,score double"
    schema = arrow_schema(ddl)

    def run(batches):
        scorer = _scorer("", network.value)
        for b in slices(batches, 128):
            yield batch(schema, [b.column(0), scorer.score([t or "" for t in b.column(1).to_pylist()])])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
