"""Packing documents into windows of bounded length by Karmarkar-Karp multiway differencing.

A document's ids end with a separator id. Whole windows are cut off its front. The rest stays whole, but every ``cut_every``-th
one is halved again and again down to about ``grain`` ids: these pieces of many sizes let the differencing come out nearly
even. The rests, a few numbers each, are dealt by the hash of their own number into groups that fill about ``group`` windows;
how many groups there are follows from the sum of all rests, not from the tasks that cut them. Each group is partitioned: every
piece starts as a partial partition into k windows; the two partial partitions with the largest imbalance (largest minus
smallest window) are merged again and again, the fullest windows of one with the emptiest of the other, until one is left. k is
the least count that could hold all; whenever a window exceeds the capacity, k rises by one and the differencing is repeated.
Groups are as large at any input size, whatever document or source the pieces are of, and no piece is left out.

Defined results: null text is empty (the separator alone); a null doc_id stays null; equal rows are packed separately;
further columns are dropped.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices, stored
from .pretokens import coder

CAPACITY, GROUP, GRAIN, CUT_EVERY, SEPARATOR = 2048, 256, 16, 4, 1
#: Pieces of a group, whatever they fill.
PIECES = 16_384
#: Windows of a group have numbers of their own from here on, so that they never meet those that a task numbered.
_GROUPS = 1 << 62
_OUT = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in k windows of nearly equal sums.

    A partial partition is kept as its non-empty windows in descending order of sum, (sum, tree of members)."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            c = a + b
        else:
            # the fullest windows of one meet the empty ones of the other; only the smallest of both share a window
            c = a[: len(a) - over] + b[: len(b) - over] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
        c.sort(key=_sum, reverse=True)
        n += 1
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == k else 0)), n, c))
    windows = []
    for _, tree in heap[0][2] if heap else ():
        members, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                members.append(x)
        windows.append(members)
    return windows


def _sum(window):
    return window[0]


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest windows, counting up from the least possible, that differencing keeps within the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        k += 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, cut_every: int = CUT_EVERY, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a number, unique among the pieces, of each piece."""
    ddl = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,piece long"
    out = arrow_schema(ddl)
    end = separator.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        c, made, rests = coder(path), TaskContext.get().partitionId() << 40, 0
        for b in slices(batches):
            done = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = c.ids(t) + end
                n = len(ids) // 4
                cuts = list(range(0, n - n % capacity + 1, capacity))
                rest = n - cuts[-1]
                if rest:
                    rests += 1
                    while rests % cut_every == 0 and rest > 2 * grain:
                        cuts.append(cuts[-1] + rest - rest // 2)
                        rest //= 2
                    cuts.append(n)
                for a, z in zip(cuts, cuts[1:], strict=False):
                    done.append((d, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), n, made))
                    made += 1
            yield batch(out, list(zip(*done, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP, grain: int = GRAIN, cut_every: int = CUT_EVERY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(docs, path, capacity, grain, cut_every, separator), "pieces")
    full = F.col("length") == capacity
    rests = cut.where(~full)
    sums = rests.agg(F.sum("length").alias("ids"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, round((sums.ids or 0) / (group * capacity)), sums.n // PIECES)
    names = [x.split()[0] for x in _OUT.split(",")]

    def fill(pdf):
        # in the order of their numbers, so that a group comes out the same when it is done again
        pdf = pdf.sort_values("piece", ignore_index=True)
        base = _GROUPS + (int(pdf.group.iloc[0]) << 24)
        sizes = pdf.length.tolist()
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for k, members in enumerate(windows_of(sizes, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + k, at
                at += sizes[i]
        return pdf.assign(sequence_id=sequence, offset=offset, doc_id=pdf.doc_id.astype("Int64"))[names]

    dealt = rests.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    filled = dealt.repartition(groups, "group").groupBy("group").applyInPandas(fill, _OUT)
    return cut.where(full).select(*names[:-2], F.col("piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(filled)
