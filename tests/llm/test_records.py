"""Name joins, conversation tries and shards against brute force, SQL and odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from panelcast.llm import name_join, prefix_trie, sharding
from panelcast.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_name_join", "op12_prefix_trie", "op13_sharding"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("clients", "vendors", "conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


# --- names


def distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def spoilt(rng, name, letters, edits):
    for _ in range(edits):
        at, kind = rng.randrange(len(name) + 1), rng.randrange(4)
        c = rng.choice(letters)
        name = [name[:at] + c + name[at:], name[:at] + name[at + 1 :], name[:at] + c + name[at + 1 :], name[:at] + name[at + 1 : at + 2] + name[at : at + 1] + name[at + 2 :]][kind]
    return name


def test_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abé𝒳", k=rng.randrange(9))) for _ in range(2))
        assert name_join.alignment(a, b) == distance(a, b)
    long = "xy" * 500
    assert name_join.alignment(long, long[:300] + "yx" + long[302:]) == 1


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("wide", [5, 64])
def test_pairs_are_whole(spark, most, wide):
    rng = random.Random(most)
    letters = "abcdeé "
    base = ["".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(60)]
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 90)))  # more different letters than the anagram keys take
    base += [many, many[:63], many[:65], "aa", "a"]
    right = base[::2] + [spoilt(rng, x, letters, rng.randrange(4)) for x in base for _ in range(3)]
    frame = lambda names: spark.createDataFrame([(x, "further") for x in names], "name string, key string")
    got = [tuple(r) for r in name_join.pairs(frame(base + base[:9] + [None, ""]), frame(right + [None, ""]), most, wide).collect()]
    want = {(a, b, d) for a in base for b in right if a and b and (d := distance(a, b)) <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_matches_are_counted(spark):
    clients = [(1, "Ann Lee"), (2, "ann lee"), (2, "ann lee"), (7, "nan lee"), (None, "Ann Lee"), (8, None), (9, ""), (10, "ÄNN LEE")]
    vendors = [(k, "Ann Lee") for k in range(6)] + [(0, "Ann Lee"), (None, "ann le"), (50, None), (51, ""), (52, "x")]
    got = name_join.count_matches(spark.createDataFrame(clients, "client_id long, name string"), spark.createDataFrame(vendors, "vendor_id long, name string")).collect()
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    want = {}
    for v, name in set(vendors):
        h = zlib.crc32(str(v).encode()) if v is not None else 1
        if name and h % 2 == 0 and len(name) >= 2:
            i = h % (len(name) - 1)
            name = name[:i] + name[i + 1] + name[i] + name[i + 2 :]
        for d in range(3):
            met = [c for c, n in clients if name and n and distance(lower(name), lower(n)) == d]
            if met:
                ids = [c for c in met if c is not None]
                want[v, d, lower(name)] = (len(met), min(ids, default=None), sum(zlib.crc32(str(c).encode()) for c in ids) if ids else None)
    assert {(r.vendor_id, r.distance, r.name): (r.n_clients, r.first_client_id, r.clients_crc) for r in got} == want and len(got) == len(want)
    empty = spark.createDataFrame([], "client_id long, name string")
    assert name_join.count_matches(empty, spark.createDataFrame(vendors, "vendor_id long, name string")).count() == 0


def test_no_task_or_broadcast_takes_a_side(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    frame = spark.createDataFrame([(1, "abc")], "client_id long, name string")
    with redirect_stdout(StringIO()) as out:
        name_join.count_matches(frame, frame.withColumnRenamed("client_id", "vendor_id")).explain("formatted")
    assert "SinglePartition" not in out.getvalue() and "Broadcast" not in out.getvalue()


# --- conversations


def brute_trie(rows):
    own = defaultdict(list)
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    out = set()
    for node, cs in members.items():
        inside = [x for x in members if x[: len(node)] == node]
        children = lambda x: [y for y in members if len(y) == len(x) + 1 and y[:-1] == x]
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in inside)
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children(node)), sum(not children(x) for x in inside), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


@pytest.mark.parametrize("block", [2, 4096])
def test_trie(spark, block):
    rng = random.Random(block)
    rows = [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc", None, ""])) for c in list(range(40)) + [100, 101, 102, 205, 300] for k in range(rng.randrange(1, 9))]
    rows += [(1, None, "user", "first"), (1, None, "user", "first"), (1, 0, "user", "tie"), (None, 0, "user", "lost")]
    rows += [(103, k, "user", "same") for k in range(30)] + [(104, k, "user", "same") for k in range(60)] + [(300, 9, "user", "x" * 100_000)]
    rows += [(c, k, "user", f"copy {k}") for c in range(400, 480) for k in range(4)]
    rng.shuffle(rows)
    want, n = brute_trie(rows)
    frame = spark.createDataFrame([(*r, "further") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(5)
    got = [tuple(r) for r in prefix_trie.digest(frame, block).collect()]
    assert len(got) == n and set(got) == want


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.digest(empty).count() == 0
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "a", "b")], empty.schema)).count() == 0


# --- shards


def test_odd_documents(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, None), (3, ""), (4, "é" * 50_000)] + [(k, "copy") for k in range(100, 400)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, shard int, virtual_slot string")
    got = sharding.shard(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.shard(docs.limit(0)).count() == 0


def test_shards_are_even(spark, sf):
    got = QUERIES["op13_sharding"](spark, sf).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)


def test_versions_of_the_map(spark, tmp_path):
    rng = random.Random(3)
    loads = lambda f: spark.createDataFrame([(k, f(k), 1) for k in range(0, 4096, 3)], "virtual_slot int, bytes long, rows long")
    old = {k: rng.randrange(1, 1000) for k in range(4096)}
    path = str(tmp_path)
    sharding.save_map(sharding.assign(loads(old.get), 4), path, 0)
    first = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert len(first) == 4096
    # bytes change: what was the first shard's grows
    new = {k: old[k] * (3 if first[k] == 0 else 1) for k in old}
    sharding.save_map(sharding.rebalance(sharding.load_map(spark, path), loads(new.get), 4), path, 1)
    second = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    weight = lambda m, f: [sum(f[k] for k in range(0, 4096, 3) if m[k] == s) for s in sorted(set(m.values()))]
    assert max(weight(second, new)) < 1.03 * sum(weight(second, new)) / 4
    assert {first[k] for k in first if first[k] != second[k]} == {0}  # only the heavy shard gave slots up
    sharding.save_map(sharding.grow(sharding.load_map(spark, path), loads(new.get), 4), path, 2)
    third = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert len(third) == 4096 and {third[k] for k in third if third[k] != second[k]} == {4}
    assert max(weight(third, new)) < 1.05 * sum(weight(third, new)) / 5
    assert {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 0).collect()} == first


def test_sharding_is_native(spark, sf):
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as out:
        QUERIES["op13_sharding"](spark, sf).explain("formatted")
        sharding.assign(sharding.loads(sharding.records(spark.read.parquet(f"{sf}/documents.parquet")))).explain("formatted")
    assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
