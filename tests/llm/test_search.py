"""Vector search, similarity join, components and the pipeline, against brute force."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import common, components, jaccard_join, vector_search

BAD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [None] + [1.0] * 7), (9006, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (9100, [1.0, 2.0])]


def brute(rows, queries, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    out = {}
    for q in queries:
        if q in good:
            s = u @ u[np.searchsorted(ids, q)]
            order = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_search(spark):
    g = np.random.default_rng(2)
    x = g.normal(0, 1, (1200, 8))
    x[300:700] = x[300]  # a very common vector
    x[700] = 2 * x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(5, x[5].tolist()), (50, [9e9] * 8), (50, [1e9] * 9)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = defaultdict(list)
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0, bytes=400 * 64, block=10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute(rows, [i for i in range(0, 1200, 50)])
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] and (a[2] > b[2] or a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        hit += len({v for _, v, _ in mine} & {v for v, _ in w})
        if 300 < q < 700:
            assert mine[0][2] == pytest.approx(1)
    assert hit / (5 * len(want)) >= 0.9


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (50, [3.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 2, 0.707106781), (0, 2, 1, 0.0)]
    assert vector_search.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_search.nearest(df, F.lit(False)).count() == 0


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    got = defaultdict(set)
    for r in vector_search.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for j in np.flatnonzero(ids % 50 == 0):
        s = u @ u[j]
        s[j] = -9
        hit += len(set(ids[np.argsort(-s)[:5]].tolist()) & got[ids[j]])
        total += 5
    assert hit / total >= 0.9


# --- similarity join --------------------------------------------------------------------------------------------------


def sets_of(t, width=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def join_by_pairs(rows):
    """doc_id, n_shingles, component_id and n_links of each row, by comparing all pairs of rows."""
    sets = [sets_of(t) if i is not None else None for i, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets_of(t)), str(least[find(k)] if i is not None else None), links[k]) for k, (i, t) in enumerate(rows))


def corpus(seed, n=90):
    """Random texts, exact and near copies in groups, drifting chains, shared passages, and edge cases."""
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefgh") for _ in range(g.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    rows = [(None, passage), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "é É x y z w")]
    at = 10
    for _ in range(n // 15):
        text = [word() for _ in range(g.randint(8, 120))]
        for _ in range(g.randint(1, 22)):
            own = list(text)
            for _ in range(g.choice([0, 0, 1, 1, 2, 3, 6])):
                own[g.randrange(len(own))] = word()
            rows.append((at, " ".join(own)))
            at += 1
            if g.random() < 0.3:
                text = own
        rows.append((at, passage + " " + " ".join(word() for _ in range(g.randint(5, 60)))))
        at += 1
    g.shuffle(rows)
    return rows


def rows_of(found):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in found)


@pytest.mark.parametrize("seed,long,block", [(1, 24, 1 << 20), (2, 3, 600), (3, 1, 1500), (4, 0, 100)])
def test_join(spark, monkeypatch, seed, long, block):
    """Also with long lists from the first entries on, and blocks of few sets."""
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join.candidates, "__defaults__", (long,))
    for name, value in (("ENTRIES", 200), ("BLOCK", block), ("SET", 50), ("FREQUENT", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(common, "HOT", 2)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    assert rows_of(jaccard_join.join(df).collect()) == join_by_pairs(rows)


def test_answers_of_similar_sets():
    """Answers derived from those of other sets are the ones that every pair's own comparison gives."""
    g = np.random.default_rng(5)
    for same in (True, False):
        pool = np.sort(g.integers(1, 1 << 60, 300).astype(np.uint64))
        some = lambda: [np.sort(g.choice(pool[a : a + 60], g.integers(1, 60), False)) for a in g.integers(0, 240, 40)]
        left = some()
        left += [np.unique(np.append(np.delete(x, g.integers(0, len(x), 2)), g.integers(1, 99, 1).astype(np.uint64))) for x in left]
        right = left if same else some() + left[::3]
        got = {(y, int(z)) for y, zs in jaccard_join.linked_rows(left, right, same) for z in zs}
        want = {(y, z) for y, a in enumerate(left) for z, b in enumerate(right) if (z > y or not same) and 4 * (n := len(np.intersect1d(a, b))) >= 3 * (len(a) + len(b) - n)}
        assert got == want and want


def test_blocks_of_near_copies_are_small():
    """A block goes to each of its meetings; before, it went as its sets' hashes, eight bytes each."""
    g = np.random.default_rng(6)
    some = lambda n: np.unique(g.integers(0, 1 << 64, n, np.uint64))
    base = some(400)
    near = [np.unique(np.append(np.delete(base, g.integers(0, len(base), 10)), some(10))) for _ in range(300)]
    for sets, most in ((near, 0.1), ([some(n) for n in (1, 30, 500)] + [base], 1.1)):
        found = jaccard_join.pack_sets(sets)
        assert all(np.array_equal(x, y) for x, y in zip(jaccard_join.unpack_sets(*found), sets, strict=True))
        assert sum(map(len, found)) < most * 8 * sum(map(len, sets))


def test_sql_of_the_join(spark, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in corpus(9) if i is not None] + [(None, "a b c d e f g")] * 2 + [(500, "x y")] * 2
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((str(a), b, str(c), d) for a, b, c, d in db.execute(jaccard_join.oracle_sql()).fetchall())
    assert rows_of(jaccard_join.join(spark.read.parquet(str(tmp_path / "d"))).collect()) == want


def test_long_words_do_not_collide():
    """Two words whose letters alternate so that polynomial hashes of any odd base agree modulo 2^64."""
    for size in (256, 512, 2048, 4096):
        s = "a"
        while len(s) < size:
            s += s.translate(str.maketrans("ab", "ba"))
        t = s.translate(str.maketrans("ab", "ba"))
        assert jaccard_join.set_id(jaccard_join.shingles(s)) != jaccard_join.set_id(jaccard_join.shingles(t))
    words = {bytes([97 + i % 3, 97 + i // 3 % 3, 97 + i // 9 % 3]) * k for i in range(27) for k in range(1, 60)}
    assert len({int(jaccard_join.word_hashes(w)[0]) for w in words}) == len(words)
    # only the far end differs
    assert jaccard_join.word_hashes(b"x" * 300 + b"a")[0] != jaccard_join.word_hashes(b"x" * 300 + b"b")[0]


def test_heavy_order_changes_nothing(spark, monkeypatch):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = join_by_pairs(rows)
    for heavy, frequent, bloom in ((4, 2, 64), (1 << 20, 2, 0)):
        monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
        monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard_join, "BLOOM", bloom)
        assert rows_of(jaccard_join.join(df).collect()) == want


def test_keep_one(spark):
    t = "a b c d e f g h i j"
    d = spark.createDataFrame([(3, t, "x"), (1, t, "y"), (2, "q", "z"), (None, t, "n"), (None, t, "n"), (7, "", "e"), (8, "", "e"), (9, "k l", "r"), (9, "k l", "r")], "doc_id long, text string, _rank string")
    got = sorted((str(r.doc_id), r["_rank"]) for r in jaccard_join.keep_one(d).collect())
    assert got == [("1", "y"), ("2", "z"), ("7", "e"), ("8", "e"), ("9", "r"), ("None", "n"), ("None", "n")]
    assert jaccard_join.join(d.limit(0)).count() == 0


def test_keep_one_loses_no_document(spark):
    """Rows of one doc_id with different texts are different documents; every component keeps one, and nothing else goes."""
    t = "a b c d e f g h i j k l m n o p q r s t"
    u = t.replace("a b", "x y")
    rows = [(3, t), (4, t), (3, u + " v w"), (1, u + " v w"), (8, t + " z"), (8, "other text here"), (8, "yet another text"), (8, "yet another text"), (9, "!" * 70_000 + " b c"), (None, t), (5, None), (5, ""), (5, "  ")]
    rows += [(k, "copied words in a row of them") for k in (40, 30, 50)] + [(30, "copied words in a row of more")]
    d = spark.createDataFrame([(i, x, f"row {k}", "m") for k, (i, x) in enumerate(rows)], "doc_id long, text string, component string, mark string")
    got = jaccard_join.keep_one(d)
    assert got.columns == d.columns
    shingles = lambda x: {tuple(x.lower().split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))}
    linked = [k for k, (i, x) in enumerate(rows) if i is not None and x and x.split()]
    parent = {k: k for k in linked}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in linked:
        for b in linked:
            x, y = shingles(rows[a][1]), shingles(rows[b][1])
            if 100 * len(x & y) >= 75 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for k in linked:
        best.setdefault(find(k), []).append(rows[k])
    md5 = lambda x: __import__("hashlib").md5(x.encode()).hexdigest()
    want = Counter(min(v, key=lambda r: (r[0], md5(r[1]))) for v in best.values()) + Counter(r for k, r in enumerate(rows) if k not in parent)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want and sum(want.values()) == 11


def test_words_are_those_of_the_definition():
    t = "A\u00a0b\u2003c \x1cd\x0be\x0cf\x85g É"
    assert len(jaccard_join.word_hashes(t.encode().lower())) == len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t))


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    g = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(g.randint(200, 260), g.randint(200, 260)) for _ in range(50)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_numbers_in_few_bytes():
    g = np.random.default_rng(7)
    for x in (np.zeros(0, np.uint32), g.integers(0, 1 << 64, 999, np.uint64), g.integers(-(1 << 62), 1 << 62, 999), np.array([1 << 32, -1])):
        assert np.array_equal(common.unpacked(common.packed(x), x.dtype), x)
    h = np.sort(g.integers(0, 1 << 32, 1 << 21, np.uint32))
    assert len(common.packed(np.diff(h, prepend=np.uint32(0)))) < 0.45 * h.nbytes


def test_stored_tables_leave_no_shuffle_files(spark):
    """Before, they stayed until the driver's JVM collected its garbage."""
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    for own in (None, "false"):
        spark.conf.unset(common.FREED) if own is None else spark.conf.set(common.FREED, own)
        before, made = files(), []
        found = common.stored(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts", made)
        end = time.time() + 5
        while files() - before and time.time() < end:
            time.sleep(0.2)
        assert not files() - before
        assert found.count() == 100 and spark.conf.get(common.FREED, None) == own
        common.remove(spark, made)
    spark.conf.unset(common.FREED)


def test_pipeline(spark):
    """Every stage on its predecessor's rows, held against what the stage should keep, and packed tokens against the texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from panelcast.llm import quality_classifier, quality_rules, secrets
    from panelcast.llm.common import read, stored

    sf = "/root/testdata/sf0.001"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], sf), "t"))
        assert kept[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert ids[2] == {r.doc_id for r in quality_classifier.score(kept[1], labels).where("predicted = 1").collect()}
    least = {i: int(c) for i, _, c, _ in join_by_pairs([(r.doc_id, r.text) for r in kept[2].collect()])}
    assert ids[3] == {c for c in least.values()} and ids[4] == ids[3]
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert all(not r.spans for r in secrets.digest(kept[4]).collect())
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want
