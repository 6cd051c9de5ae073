"""Edit-distance joins of names by anagram keys.

A name's letters, sorted, are its multiset; an exchange of two adjacent letters leaves it as it is, an insertion or deletion
changes it by one letter, a substitution by one letter on either side. So two names within ``most`` edits have a common multiset
from which each lacks at most ``most`` letters. Every distinct name gives the keys of its multiset with up to ``most`` letters
deleted; an equi-join on the keys finds the candidates, each once: the letters that the two names deleted must not overlap, which
only holds for the largest common multiset. What the keys ignore, the order, is then verified by the bit-parallel form of the
optimal string alignment distance.

A key is the sum of 64-bit hashes of the letters that are left, so it is as short for long names as for short ones; a chance
collision only gives a candidate that the verification drops, or a pair twice, and pairs are made distinct.

Names of more than ``WIDE`` different letters would give thousands of keys. For pairs with such a name there is another exact
way: an edit touches at most two of ``2 * most + 1`` equal segments, so one segment is in the other name unchanged, moved by at
most ``most``. Segment keys are the length, the number and the letters of a segment.

Only distinct names are paired, so a name that a third of all rows has costs as much as any other; what its rows add up to is
joined afterwards. No side is broadcast by this module, and nothing is gathered in one task.

Defined results: names null or empty take no part; equal rows count each on the side that is summed up."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices

#: Edits.
MOST = 2
#: Different letters from which a name is paired by segments.
WIDE = 64
_MASK = (1 << 64) - 1
_KEYS = arrow_schema("key long,d1 int,d2 int,name string")
_PAIRS = arrow_schema("a string,b string,distance int")


@functools.lru_cache(1 << 16)
def _mixed(c: int) -> int:
    """A 64-bit hash of a code point."""
    x = (c + 1) * 0x9E3779B97F4A7C15 & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


@functools.lru_cache(4 * WIDE)
def _two(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d, 1)


def anagram_keys(name: str, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a name, and the letters deleted for each as code points plus one (0: none), the lesser first."""
    counts = Counter(map(ord, name))
    letters = sorted(counts)
    own = np.array([_mixed(c) for c in letters], np.uint64)
    whole = np.uint64(sum(_mixed(c) * n for c, n in counts.items()) & _MASK)
    cps, none = np.array(letters, np.int32) + 1, np.zeros(1, np.int32)
    keys, d1, d2 = [np.array([whole]), whole - own], [none, np.zeros(len(cps), np.int32)], [none, cps]
    if most == 2:
        i, j = _two(len(letters))
        again = np.array([k for k, c in enumerate(letters) if counts[c] > 1], np.int64)
        keys += [whole - own[i] - own[j], whole - own[again] * np.uint64(2)]
        d1 += [cps[i], cps[again]]
        d2 += [cps[j], cps[again]]
    return np.concatenate(keys).view(np.int64), np.concatenate(d1), np.concatenate(d2)


def segment_keys(name: str, most: int, right: bool) -> list[int]:
    """Keys of the segments of a name, or on the right of all places at which segments of a name of similar length can be."""
    n, parts = len(name), 2 * most + 1
    out = set()
    for length in range(max(n - most, parts), n + most + 1) if right else [n]:
        for k in range(parts):
            lo, hi = k * length // parts, (k + 1) * length // parts
            for at in range(max(lo - most, 0), min(lo + most, n - hi + lo) + 1) if right else [lo]:
                out.add(int.from_bytes(hashlib.blake2b(f"{length}:{k}:{name[at : at + hi - lo]}".encode(), digest_size=8).digest(), "little", signed=True))
    return list(out)


def _emit(most: int, wide: int, right: bool):
    def run(batches):
        for b in slices(batches, 256):
            keys, d1, d2, names = [], [], [], []
            for name in b.column(0).to_pylist():
                kinds = len(set(name))
                if kinds <= wide:
                    k, x, y = anagram_keys(name, most)
                    keys.append(k), d1.append(x), d2.append(y), names.append((name, len(k)))
                if kinds > wide - most:
                    k = np.array(segment_keys(name, most, right), np.int64)
                    # a mark that differs between the sides, so that the letters never overlap
                    keys.append(k), d1.append(np.full(len(k), -1 - right, np.int32)), d2.append(np.zeros(len(k), np.int32)), names.append((name, len(k)))
            if keys:
                at = np.repeat(np.arange(len(names)), [n for _, n in names])
                yield batch(_KEYS, [pa.array(np.concatenate(keys)), pa.array(np.concatenate(d1)), pa.array(np.concatenate(d2)), pa.array([n for n, _ in names]).take(pa.array(at))])

    return run


def alignment(a: str, b: str) -> int:
    """Optimal string alignment distance, bit-parallel: a column of the table is a pair of integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down, diagonal, before = full, 0, 0, 0
    for c in b:
        here = where.get(c, 0)
        swapped = (~diagonal & here) << 1 & before
        diagonal = ((here & up) + up ^ up) | here | down | swapped
        right, left = down | ~(diagonal | up), diagonal & up
        distance += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down, before = (left | ~(diagonal | right)) & full, diagonal & right & full, here
    return distance


def _verify(most: int):
    def run(batches):
        for b in slices(batches, 4096):
            found = [(x, y, d) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (d := alignment(x, y)) <= most]
            if found:
                yield batch(_PAIRS, list(zip(*found, strict=True)))

    return run


def candidates(left: DataFrame, right: DataFrame, most: int = MOST, wide: int = WIDE) -> DataFrame:
    """(a, b): distinct names of ``left`` and ``right`` (both with a column ``name``) that may be within ``most`` edits, 1 or 2."""
    if most not in (1, 2) or wide < 2 * most + 1:
        raise ValueError("one or two edits, and more letters than segments")
    ddl = "key long, d1 int, d2 int, name string"
    keys = lambda df, right: df.select("name").where("name != ''").distinct().mapInArrow(_emit(most, wide, right), ddl)
    a, b = keys(left, False).alias("a"), keys(right, True).alias("b")
    apart = F.expr("NOT (a.d1 != 0 AND (a.d1 = b.d1 OR a.d1 = b.d2) OR a.d2 != 0 AND (a.d2 = b.d1 OR a.d2 = b.d2))")
    # what a name's keys come to is many times its size, which the planner does not see: no side is to be broadcast
    return a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & apart).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))


def pairs(left: DataFrame, right: DataFrame, most: int = MOST, wide: int = WIDE) -> DataFrame:
    """(a, b, distance): the distinct names of ``left`` and ``right`` within ``most`` edits of each other, each pair once."""
    return candidates(left, right, most, wide).mapInArrow(_verify(most), "a string, b string, distance int").dropDuplicates(["a", "b"])


def lowered(name: str | Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(vendors: DataFrame) -> DataFrame:
    """(vendor_id, name) of ``vendors``, distinct, the name misspelt as the contract says and then lower-cased."""
    h, size = F.crc32(F.col("vendor_id").cast("string")), F.length("name")
    at = (h % F.greatest(size - 1, F.lit(1))).cast("int")
    part = lambda start, n: F.substring(F.col("name"), start, n)
    swapped = F.concat(part(F.lit(1), at), part(at + 2, F.lit(1)), part(at + 1, F.lit(1)), part(at + 3, size))
    name = F.when((h % 2 == 0) & (size >= 2), swapped).otherwise(F.col("name"))
    return vendors.select(F.col("vendor_id").cast("long").alias("vendor_id"), lowered(name).alias("name")).where("name != ''").distinct()


def count_matches(clients: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per vendor, spelling (``name``, as compared) and distance: how many rows of clients match, the least client_id, and the sum of their checksums."""
    ids = F.col("client_id").cast("long")
    named = clients.select(ids.alias("client_id"), lowered("name").alias("b")).where("b != ''")
    named = named.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("client_id").alias("least"), F.sum(F.crc32(F.col("client_id").cast("string"))).alias("crc"))
    spelt = misspelt(vendors)
    found = pairs(spelt, named.withColumnRenamed("b", "name")).join(named.hint("merge"), "b")
    found = found.groupBy(F.col("a").alias("name"), "distance").agg(F.sum("n").alias("n_clients"), F.min("least").alias("first_client_id"), F.sum("crc").alias("clients_crc"))
    return spelt.join(found.hint("merge"), "name").select("vendor_id", "distance", "n_clients", "first_client_id", "clients_crc", "name")


def sql_crc32(text: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of a short ASCII text."""
    byte = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "list_reduce(range(8), lambda k, i: xor(k >> 1, (k & 1) * 3988292384), xor(c, b))"
    return f"xor(list_reduce({byte}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def oracle_sql() -> str:
    """``count_matches`` over the tables clients and vendors in DuckDB's SQL: every pair of names of similar length, by the table of distances."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    swapped = "substr(name, 1, k) || substr(name, k + 2, 1) || substr(name, k + 1, 1) || substr(name, k + 3)"
    exchanged = "CASE WHEN i > 1 AND j > 1 AND x[i] = y[j - 1] AND x[i - 1] = y[j] THEN s.p[j - 1] + 1 ELSE 1000000 END"
    cell = f"least(r[j] + 1, s.q[j + 1] + 1, s.q[j] + CASE WHEN x[i] = y[j] THEN 0 ELSE 1 END, {exchanged})"
    row = f"list_reduce(range(1, len(y) + 1), lambda r, j: list_append(r, {cell}), [i])"
    table = f"list_reduce(range(1, len(x) + 1), lambda s, i: {{'p': s.q, 'q': {row}}}, {{'p': range(len(y) + 1), 'q': range(len(y) + 1)}})"
    return f"""WITH h AS (SELECT *, {sql_crc32("CAST(vendor_id AS VARCHAR)")} AS h FROM vendors),
m AS (SELECT vendor_id, CASE WHEN h % 2 = 0 AND length(name) >= 2 THEN {swapped} ELSE name END AS name FROM (SELECT *, CAST(h % greatest(length(name) - 1, 1) AS BIGINT) AS k FROM h)),
v AS MATERIALIZED (SELECT DISTINCT CAST(vendor_id AS BIGINT) AS vendor_id, {lower.format("name")} AS name FROM m WHERE name <> ''),
c AS MATERIALIZED (SELECT {lower.format("name")} AS b, count(*) AS n, min(client_id) AS least, sum({sql_crc32("CAST(client_id AS VARCHAR)")}) AS crc FROM clients WHERE name <> '' GROUP BY 1),
p AS (SELECT a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM (SELECT DISTINCT name AS a FROM v) JOIN c ON abs(length(a) - length(b)) <= {MOST}),
d AS MATERIALIZED (SELECT a, b, {table}.q[-1] AS distance FROM p)
SELECT vendor_id, CAST(distance AS INTEGER) AS distance, CAST(sum(n) AS BIGINT) AS n_clients, min(least) AS first_client_id, CAST(sum(crc) AS BIGINT) AS clients_crc, name
FROM v JOIN d ON d.a = name JOIN c USING (b) WHERE distance <= {MOST} GROUP BY ALL"""
