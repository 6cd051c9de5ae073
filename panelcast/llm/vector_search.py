"""Approximate nearest neighbours by robust-pruned directed graphs.

The rows are dealt into shards by a hash of their id; a shard holds about ``bytes`` bytes of vectors, so larger tables have more
shards, not larger ones. Each shard's graph is built by batches of insertions: a greedy beam search over the graph so far proposes
neighbours; pruning keeps the nearest one and drops those that are closer to it, by the factor ``alpha``, than to the point, and
so on, so that the kept edges are few and diverse; the edges' reverses are added and pruned alike. Every query goes to every
shard. A task reads a shard's graph once and then streams up to ``block`` queries past it, a few hundred at a time, so it holds
one graph and one Arrow batch of queries, however many there are; a beam search finds candidates, whose cosines are then computed
in double precision on the original vectors; the best of all shards are the answer.

Equal vectors are one node, so a vector that is very common cannot clog the graph; all ids of a node are answers.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no
part; of rows of equal id the shortest vector counts, of equally long ones the least by its components; only vectors of equal
length are compared; fewer candidates than ``k`` give them all; a table without queries gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch, stored

BYTES, BLOCK, DEGREE, BUILD_BEAM, BEAM, ALPHA, K = 16 << 20, 262_144, 32, 64, 192, 1.2, 5
#: Queries that walk a graph at a time, and nodes that each of them expands in a step.
WALK, EXPAND = 256, 4


def beam_search(x: np.ndarray, links: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nodes nearest to each query that a greedy walk from ``start`` meets: (nodes, squared distances), nearest first; -1 and inf where there are fewer."""
    n = len(q)
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 2 - 2 * q @ x[start], False
    met = np.zeros((n, len(x) + 1), bool)
    met[:, [start, -1]] = True
    live = np.arange(n)
    while len(live):
        # the nearest nodes that are not yet expanded: those of a beam are in order
        wait = ~done[live]
        chosen = wait & (np.cumsum(wait, axis=1) <= EXPAND)
        row, col = np.nonzero(chosen)
        done[live[row], col] = True
        found = links[ids[live[row], col]]
        owner = np.repeat(live[row], found.shape[1])
        found = found.ravel()
        new = ~met[owner, found]
        owner, found = owner[new], found[new]
        # a node that two expanded ones link to comes once
        _, first = np.unique(owner * len(x) + found, return_index=True)
        owner, found = owner[first], found[first]
        met[owner, found] = True
        d = 2 - 2 * np.einsum("nd,nd->n", x[found], q[owner])
        # only what beats the last of its beam, at most a beam's worth
        better = d < dist[owner, -1]
        owner, found, d = owner[better], found[better], d[better]
        if len(owner):
            heads, size = np.unique(owner, return_counts=True)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(np.arange(len(heads)), size)
            more, more_d = np.full((len(heads), size.max()), -1), np.full((len(heads), size.max()), np.inf, np.float32)
            more[place, at], more_d[place, at] = found, d
            all_d = np.concatenate([dist[heads], more_d], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[heads] = np.take_along_axis(all_d, best, 1)
            ids[heads] = np.take_along_axis(np.concatenate([ids[heads], more], 1), best, 1)
            done[heads] = np.take_along_axis(np.concatenate([done[heads], more < 0], 1), best, 1)
        live = live[~done[live].all(1)]
    ids[np.isinf(dist)] = -1
    return ids, dist


def prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate rows (-1: none) of the points p: at most ``degree`` diverse neighbours, -1 filled."""
    v = x[cand]
    d = 2 - 2 * np.einsum("ncd,nd->nc", v, x[p])
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    d[(cand < 0) | (cand == p[:, None])] = np.inf
    out = np.full((len(p), degree), -1)
    rows = np.arange(len(p))
    for j in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, j] = cand[rows, best][ok]
        d[(alpha * alpha * between[rows, best] <= d) & ok[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Links and the start node of the graph over unit vectors.

    A node takes the reverses of others' edges as long as it has half as many more than ``degree``; then its edges are pruned."""
    n = len(x)
    room = degree + degree // 2
    links, many = np.full((n, room), -1, np.int32), np.zeros(n, np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        new = order[done : done + min(max(done, 1), 256)]
        found, _ = beam_search(x, links, start, x[new], beam)
        # points of one batch do not see each other in the graph yet
        peers = new[np.argsort(-(x[new] @ x[new].T), axis=1)[:, : degree // 2]]
        links[new, :degree] = prune(x, new, _distinct(np.concatenate([found, peers], 1)), degree, alpha)
        many[new] = (links[new] >= 0).sum(1)
        source, target = np.repeat(new, room), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        while len(target):
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, size = np.unique(target, return_index=True, return_counts=True)
            rank = np.arange(len(target)) - np.repeat(first, size)
            fits = many[target] + rank < room
            at = many[target[fits]] + rank[fits]
            links[target[fits], at] = source[fits]
            many[nodes] = np.minimum(many[nodes] + size, room)
            source, target = source[~fits], target[~fits]
            full = nodes[many[nodes] == room]
            if len(full):
                kept = prune(x, full, _distinct(links[full]), degree, alpha)
                links[full] = -1
                links[full, :degree] = kept
                many[full] = (kept >= 0).sum(1)
        done += len(new)
    return links, start


def _distinct(c: np.ndarray) -> np.ndarray:
    """Candidate rows with repeats turned to -1."""
    c = np.sort(c, axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    return c


def _unit(v: np.ndarray) -> np.ndarray:
    # large components are scaled first, so that norms stay finite
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def make_shard(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """A shard's graph: original distinct vectors, ids of each, links and start."""
    distinct, back = np.unique(vectors, axis=0, return_inverse=True)
    order = np.argsort(back.ravel(), kind="stable")
    links, start = build(_unit(distinct).astype(np.float32))
    return {"vectors": distinct, "ids": ids[order], "ends": np.cumsum(np.bincount(back.ravel(), minlength=len(distinct))), "links": links, "start": start}


def opened(graph: bytes) -> dict:
    """A stored shard, with its unit vectors in double and single precision."""
    shard = pickle.loads(graph)
    unit = _unit(shard["vectors"])
    return shard | {"unit": unit, "small": unit.astype(np.float32)}


def search_shard(shard: dict, qids: np.ndarray, q: np.ndarray, k: int, beam: int) -> list[tuple]:
    """(query_id, vec_id, score) of the k nearest found in this shard for each query."""
    unit, uq, out = shard["unit"], _unit(q), []
    found = beam_search(shard["small"], shard["links"], shard["start"], uq.astype(np.float32), beam)[0]
    for i in range(len(q)):
        nodes = found[i][found[i] >= 0]
        own = []
        for node, s in zip(nodes, unit[nodes] @ uq[i], strict=True):
            end = shard["ends"][node]
            begin = shard["ends"][node - 1] if node else 0
            own += [(-s, v) for v in shard["ids"][begin : min(end, begin + k + 1)] if v != qids[i]]
        out += [(int(qids[i]), int(v), float(-s)) for s, v in sorted(own)[:k]]
    return out


def one_each(ids: list, vectors: list) -> list[int]:
    """Which rows count: of each id the one of the shortest, then least, vector."""
    best: dict = {}
    for k, (i, v) in enumerate(zip(ids, vectors, strict=True)):
        if i not in best or (len(v), tuple(v)) < (len(vectors[best[i]]), tuple(vectors[best[i]])):
            best[i] = k
    return list(best.values())


def nearest(embeddings: DataFrame, is_query, k: int = K, bytes: int = BYTES, block: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that the column ``is_query``, a condition on vec_id, selects."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    usable = embeddings.select(F.col("vec_id").cast("long"), v.alias("v"), is_query.alias("asks")).where("vec_id is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(v, c -> c != 0)")
    sizes = usable.agg(F.sum(8 * F.size("v")).alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, math.ceil((sizes.n or 0) / bytes)), max(1, math.ceil(sizes.q / block))
    graph_ddl = "shard int,dim int,graph binary"

    def make(pdf):
        import pandas as pd

        rows = []
        pdf = pdf.iloc[one_each(pdf.vec_id.tolist(), pdf.v.tolist())].sort_values("vec_id")
        dims = pdf.v.map(len)
        for dim in sorted(set(dims)):
            own = pdf[dims == dim]
            rows.append((int(pdf.shard.iloc[0]), dim, pickle.dumps(make_shard(own.vec_id.to_numpy(), np.stack(own.v.to_numpy())), 5)))
        return pd.DataFrame(rows, columns=["shard", "dim", "graph"])

    dealt = usable.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    graphs = stored(dealt.repartitionById(shards, "shard").groupBy("shard").applyInPandas(make, graph_ddl), "graphs")
    asked = usable.where("asks").groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("dim"), "v")).alias("s")).select("vec_id", "s.*")
    # a task for each shard and share of the queries; the graph comes first, then the queries, one row each
    task = lambda share: (F.col("shard") * blocks + share).cast("int").alias("task")
    shares = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("share")
    first = graphs.select("shard", "dim", "graph", shares).select(task(F.col("share")), "dim", "graph", F.lit(None).cast("long").alias("q_id"), F.lit(None).cast("array<double>").alias("q"))
    sent = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    sent = sent.select(task(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))), "dim", F.lit(None).cast("binary").alias("graph"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    work = first.unionByName(sent).repartitionById(shards * blocks, "task").sortWithinPartitions("task", "dim", F.col("graph").isNull())
    out_ddl = "query_id long,vec_id long,score double"
    schema = arrow_schema(out_ddl)

    def search(batches):
        at, shard = None, None
        for b in batches:
            place = np.stack([b.column(c).to_numpy() for c in (0, 1)], 1)
            heads = np.flatnonzero(np.asarray(b.column(2).is_valid())).tolist()
            # stretches of the batch that a graph opens; the first may go on with the graph before
            starts = heads if heads[:1] == [0] else [0, *heads]
            for low, high in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if low in heads:
                    at, shard = place[low].copy(), opened(b.column(2)[low].as_py())
                    low += 1
                # queries of a length that no vector of the shard has come without a graph
                many = int((place[low:high] == at).all(1).sum()) if shard else 0
                for j in range(low, low + many, WALK):
                    part = b.slice(j, min(WALK, low + many - j))
                    q = part.column(4).flatten().to_numpy().reshape(part.num_rows, -1)
                    if rows := search_shard(shard, part.column(3).to_numpy(), q, k, beam):
                        yield batch(schema, list(zip(*rows, strict=True)))

    found = work.mapInArrow(search, out_ddl).select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
