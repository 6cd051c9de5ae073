"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

Turns are numbered within their conversation by one range sort of the whole table, so that even a conversation with a third of all
rows is spread over tasks; texts stay behind, a digest and a length of each go on. A prefix is identified by its depth and two sums
of hashes of (depth, turn), which are running totals in blocks (``operators.blocks``). A node is a distinct prefix.

At each node the child with most members is heavy, so that every light edge at least halves the members, and a path from the root
has at most log2(conversations) light edges. Nodes linked by heavy edges form a path; its top is found by a running maximum along
the conversations. Then, for paths by falling number of light edges above them: sums from the bottom of each path upwards, again
in blocks, and the total of each path's top added to the node that it hangs from. The rounds are as many as the light edges.

Joins on a node that many rows share (the root, a common first turn) broadcast the few hot nodes (``common.joined``).

Defined results: rows without conv_id take no part; a null turn comes first, equal turns are ordered by role, then by the digest of
role and text; null roles and texts are empty; equal rows each count; an empty table gives an empty trie; further columns are not
read. Two different prefixes are taken for one only if both 64-bit sums of their turns' SHA-256 digests collide."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import running
from .common import joined, remove, stored

#: A base of a family of conversations has conv_id divisible by this; at most ``SHARED`` - 1 turns of it begin the others.
FAMILY, SHARED = 100, 6
#: conv_ids per piece of the list of those that end at a node.
PIECE = 4096


def numbered(conversations: DataFrame, made: list) -> tuple[DataFrame, DataFrame]:
    """(conv_id, run, at, digest, size): each turn's place ``at`` in its run, the part of its conversation that one task sorted; and
    (conv_id, run, first, n, turns): the turns before each run, in it, and in the conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    order = ["conv_id", "turn", "role", "digest"]
    # the identifier counts the sorted rows of a partition; stored, so that every reader sees the same
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    turns = stored(turns.select("conv_id", "digest", "size", "id", F.shiftright("id", 33).alias("run")), "turns", made)
    runs = turns.groupBy("conv_id", "run").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id")
    before = own.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", "n", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(own).alias("turns"))
    return turns, stored(runs, "runs", made)


def rebuilt(conversations: DataFrame, made: list) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id, turns) and (conv_id, depth, digest, size), depth from 1.

    Each begins with the first h turns of its family's base, h being its checksum modulo ``SHARED``, and goes on behind its own first h."""
    turns, runs = numbered(conversations, made)
    base, h = F.col("conv_id") - F.col("conv_id") % FAMILY, (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("long")
    convs = runs.where("first = 0").select("conv_id", "turns", base.alias("base"), h.alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("turns").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("turns")), "convs", made)
    placed = turns.join(runs.drop("n", "turns").join(convs.select("conv_id", "h", "taken"), "conv_id"), ["conv_id", "run"])
    placed = placed.withColumn("depth", F.col("id") - F.col("least") + F.col("first") + 1)
    heads = placed.where((F.col("depth") < SHARED) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "depth", "digest", "size")
    shared = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("depth <= taken")
    own = placed.where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "depth", "digest", "size"]
    return convs.select("conv_id", "turns"), stored(shared.select(columns).unionByName(own.select(columns)), "rebuilt", made)


def paths(convs: DataFrame, turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, depth, node, parent, size, ends): a row for every prefix of every conversation, the empty one included."""
    name = lambda depth, x, y: F.md5(F.concat_ws(".", depth, x, y))
    number = lambda c: c.cast("decimal(38,0)")
    own = turns.withColumns({"x": number(F.xxhash64("depth", "digest")), "y": number(F.xxhash64("digest", "depth"))})
    sums = running(own, ["conv_id"], "depth", {"xs": ("sum", "x"), "ys": ("sum", "y")}, block)
    node = name(F.col("depth"), number(F.col("xs")), number(F.col("ys")))
    parent = name(F.col("depth") - 1, number(F.col("xs") - F.col("x")), number(F.col("ys") - F.col("y")))
    below = sums.select("conv_id", "depth", node.alias("node"), parent.alias("parent"), "size").join(convs, "conv_id")
    zero = number(F.lit(0))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), name(F.lit(0).cast("long"), zero, zero).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("size"), "turns")
    return root.unionByName(below).select("conv_id", "depth", "node", "parent", "size", (F.col("depth") == F.col("turns")).alias("ends"))


def _decomposed(rows: DataFrame, n: int, block: int, made: list) -> DataFrame:
    """(node, parent, depth, conv_id, n_convs, n_children, size, top, level): the nodes, the top of the path of each, and the light edges above that."""
    nodes = rows.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("member"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"))
    nodes = stored(nodes, "nodes", made)
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", "node")).getField("node").alias("heavy"))
    kids = stored(kids, "kids", made)
    heavy = kids.select(F.col("heavy").alias("node"), F.lit(False).alias("light"))
    nodes = nodes.join(kids.select("node", "n_children"), "node", "left").join(heavy, "node", "left").na.fill({"n_children": 0, "light": True})
    nodes = stored(nodes, "marked", made)
    marked = joined(rows.select("conv_id", "depth", "node"), nodes.select("node", "member", "n_convs", "light"), ["node"], "n_convs", n)
    tops = F.when(F.col("light"), F.struct("depth", "node"))
    marked = stored(marked.select("conv_id", "depth", "node", "member", tops.alias("top"), F.col("light").cast("long").alias("one")), "marks", made)
    marked = running(marked, ["conv_id"], "depth", {"on": ("max", "top"), "edges": ("sum", "one")}, block)
    marked = marked.where("conv_id = member").select("node", F.col("on.node").alias("top"), (F.col("edges") - 1).alias("level"))
    return stored(nodes.join(marked, "node").withColumnRenamed("member", "conv_id"), "placed", made)


def subtree_sums(nodes: DataFrame, values: list[str], block: int, made: list) -> DataFrame:
    """node and ``values`` summed over its subtree, from (node, parent, depth, top, level) and ``values`` of the node alone."""
    deepest = nodes.agg(F.max("level")).first()[0]
    found, hanging = None, None
    for level in range(deepest if deepest is not None else 0, -1, -1):
        own = nodes.where(F.col("level") == level).select("node", "parent", "top", (-F.col("depth")).alias("up"), *values)
        if hanging is not None:
            own = own.join(hanging, "node", "left")
            own = own.select("node", "parent", "top", "up", *(F.expr(f"{v} + coalesce(_{v}, 0)").alias(v) for v in values))
            own = stored(own, "level", made)
        total = running(own, ["top"], "up", {f"t_{v}": ("sum", v) for v in values}, block)
        total = stored(total.select("node", "parent", "top", *(F.col(f"t_{v}").alias(v) for v in values)), "sums", made)
        hanging = total.where("node = top AND parent is not null").groupBy(F.col("parent").alias("node")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        found = total.select("node", *values) if found is None else found.unionByName(total.select("node", *values))
    return found


def trie(convs: DataFrame, turns: DataFrame, block: int = 4096, made: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations (conv_id, turns) with turns (conv_id, depth, digest, size), depth from 1 without gaps: nodes, and (node, conv_id) of the
    conversations that end there. Node: node, conv_id (least member), depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (size saved by
    keeping each node of its subtree once). Role and text of a node are those of turn ``depth`` of its conv_id. ``made`` gets the paths of stored tables."""
    made = [] if made is None else made
    rows = stored(paths(convs, turns, block), "paths", made)
    n = rows.count()
    nodes = _decomposed(rows, n, block, made)
    own = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")})
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"], block, made)
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = joined(nodes.select("node", "conv_id", "depth", "parent", "n_convs", F.col("n_children").alias("children")), above, ["parent"], "n_children", n)
    out = out.join(sums, "node").select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens")
    return out, rows.where("ends").select("node", "conv_id")


def _digests(batches):
    node, h = None, None
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for b in batches:
        done = []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != node:
                if h:
                    done.append((node, h.hexdigest()))
                node, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([h.hexdigest()])], schema=schema)


def listed(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the conv_ids of each node in ascending order, as text. A digest is a sequence: the lists are put together in pieces of
    at most ``PIECE`` ids, and the pieces of a node, few and short, stream in order through the digest."""
    pieces = ends.groupBy("node", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    pieces = pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "text")
    return pieces.mapInArrow(_digests, "node string, ends_sha256 string")


def digest(conversations: DataFrame, block: int = 4096) -> DataFrame:
    """The nodes of the trie of the contract's conversations."""
    made: list = []
    convs, turns = rebuilt(conversations, made)
    nodes, ends = trie(convs, turns, block, made)
    nodes = nodes.join(listed(ends), "node", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = stored(nodes.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")
    remove(conversations.sparkSession, made)
    return out


def oracle_sql() -> str:
    """``digest`` over the table conversations in DuckDB's SQL, every prefix being a list of turns."""
    byte = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "list_reduce(range(8), lambda k, i: xor(k >> 1, (k & 1) * 3988292384), xor(c, b))"
    h = f"xor(list_reduce({byte}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295) % {SHARED}"
    return f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT *, sha256(length(role) || ':' || role || text) AS x FROM t),
c AS MATERIALIZED (SELECT conv_id, list({{'x': x, 'n': length(text)}} ORDER BY turn NULLS FIRST, role, x) AS own, {h} AS h FROM s GROUP BY conv_id),
r AS MATERIALIZED (SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS own FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY}),
p AS MATERIALIZED (SELECT conv_id, d AS depth, list_transform(own[1:d], lambda z: z.x) AS node, CASE WHEN d > 0 THEN list_transform(own[1:d - 1], lambda z: z.x) END AS parent, own[d].n AS size, d = len(own) AS stops FROM r, unnest(range(len(own) + 1)) u(d)),
n AS MATERIALIZED (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(size), 0) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM p GROUP BY node, depth),
k AS MATERIALIZED (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
-- each node with all that are above it: the prefixes of its least member
a AS (SELECT p.node, m.node AS low, (m.n_convs - 1) * m.size AS saved, CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END AS leaf FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth),
q AS (SELECT node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY node)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN q ON q.node = m.node LEFT JOIN n o ON o.node = m.parent AND m.depth > 0"""
