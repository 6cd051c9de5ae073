"""Addresses against brute force: the index of names, the nearest name, and texts without commas."""

import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from panelcast.operators import address


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def spoilt(rng, s, n):
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        s = rng.choice([s[:at] + rng.choice("abc ") + s[at:], s[:at] + s[at + 1 :], s[:at] + rng.choice("abc") + s[at + 1 :]])
    return s


def test_index_finds_all_pairs(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abc ", k=rng.randrange(0, 14))) for _ in range(80)] + ["", "a", "ab"]
    parts = [(spoilt(rng, x, rng.randrange(5)), k) for x in names for k in range(4)] + [("", 0), ("", 3), ("aaa", 1)]
    left = spark.createDataFrame([(kind, p, k) for p, k in parts for kind in "xy"], "kind string, part string, k int")
    right = spark.createDataFrame([(kind, f"{kind}{i}", n) for i, n in enumerate(names) for kind in "xy"], "kind string, name string, norm string")
    got = {tuple(r) for r in address.near(left, right).select("kind", "part", "name", "distance").distinct().collect()}
    assert got == {(kind, p, f"{kind}{i}", d) for p, k in parts for i, n in enumerate(names) if (d := lev(p, n)) <= k for kind in "xy"}


@pytest.mark.parametrize("block", [7, 5000])
def test_nearest_name_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(address, "BLOCK", block)
    rng = random.Random(block)
    names = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(120)})
    parts = [spoilt(rng, rng.choice(names), rng.randrange(7)) for _ in range(150)] + ["", "zzzzzzzzzzzz"]
    left = spark.createDataFrame([("k", p) for p in parts] + [("none", "abc")], "kind string, part string")
    right = spark.createDataFrame([("k", n.upper(), n) for n in names], "kind string, name string, norm string")
    got = {r.part: r.name for r in address.best_names(left, right).collect()}
    assert got == {p: min(names, key=lambda n: (lev(p, n), -len(n), n)).upper() for p in parts}


def test_few_pairs_meet(spark):
    """Of 20,000 names and 500 texts, ten million pairs, one in a thousand meets within one edit, which settles most texts; one in thirty within three."""
    rng = random.Random(1)
    syllables = ["".join(x) for x in itertools.product("bcdghklmnpqrstvx", "aeiouy", ["", "n", "ng", "t"])]
    names = sorted({" ".join("".join(rng.choices(syllables, k=2)) for _ in range(2)) for _ in range(20_000)})
    parts = [spoilt(rng, rng.choice(names), 2) for _ in range(500)]
    right = spark.createDataFrame([("street", n, n) for n in names], "kind string, name string, norm string")
    for k, share in ((1, 0.001), (3, 0.03)):
        left = spark.createDataFrame([("street", p, k) for p in parts], "kind string, part string, k int")
        assert address.met(left, right).count() < share * len(names) * len(parts)
    assert address.near(left, right).select("part").distinct().count() == len(set(parts))


LISTS = {"province": ["Lào Cai", "Phú Thọ", "An Giang"], "ward": ["Lào Cai", "Hoàn Kiếm", "Quang Trung"], "street": ["Phú Thọ", "Hoàn Kiếm", "Quang Trung", "3 Tháng 2", "Lê Lợi"]}


def gazetteer(spark):
    return spark.createDataFrame([(k, n) for k, v in LISTS.items() for n in v] + [("street", None)], "kind string, name string")


def plain(s):
    s = unicodedata.normalize("NFD", s.lower().replace("đ", "d"))
    s = "".join(c if c.isascii() and c.isalnum() else " " if not unicodedata.combining(c) else "" for c in s)
    return " ".join(s.split())


def cheapest(text):
    """All choices of three runs, or none, in order."""
    words = plain(text).split() if text else []
    weight = lambda ws: sum(0 if w.isdigit() else len(w) for w in ws)
    options = {k: [(None, None, "", address.MISSING, 0)] for k in LISTS}
    for lo in range(len(words)):
        for hi in range(lo + 1, min(len(words), lo + 4) + 1):
            run = " ".join(words[lo:hi])
            for k, names in LISTS.items():
                near = [(d, -len(plain(n)), n) for n in names if (d := lev(run, plain(n))) <= min(len(run) // 4, address.EDITS)]
                if near:
                    d, less, n = min(near)
                    options[k].append((lo, hi, n, d - weight(words[lo:hi]), -less))
    best = None
    for s, w, p in itertools.product(options["street"], options["ward"], options["province"]):
        placed = [x for x in (s, w, p) if x[0] is not None]
        if all(a[1] <= b[0] for a, b in zip(placed, placed[1:])):
            way = (s[3] + w[3] + p[3], -(s[4] + w[4] + p[4]), s[2], w[2], p[2])
            best = way if best is None or way < best else best
    return tuple(x or None for x in (best[4], best[3], best[2]))


def test_texts_without_commas(spark):
    rng = random.Random(8)
    texts = ["12 Lê Lợi Hoàn Kiếm Phú Thọ", "Hoàn Kiếm Hoàn Kiếm An Giang", "Phú Thọ Lào Cai Lào Cai", "Phú Thọ", "Lào Cai", "12/4 3 Tháng 2 Quang Trung An Gang", "nothing here", "", None, "5", "Quang Trung", "le loi quang trung lao cai extra", "Hoàn Kiếm An Giang " * 40]
    for _ in range(60):
        texts.append(" ".join([str(rng.randrange(99))] * rng.randrange(2) + [spoilt(rng, rng.choice(LISTS[k]), rng.randrange(3)) for k in ("street", "ward", "province") if rng.random() < 0.9] + ["xy"] * rng.randrange(2)))
    cases = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.province, r.ward, r.street) for r in address.segmented(cases, gazetteer(spark)).collect()}
    for k, t in enumerate(texts):
        if t is None or len(t) < 200:
            assert got[k] == cheapest(t), t
    assert got[0] == ("Phú Thọ", "Hoàn Kiếm", "Lê Lợi") and got[1] == ("An Giang", "Hoàn Kiếm", "Hoàn Kiếm") and got[2] == ("Lào Cai", "Lào Cai", "Phú Thọ") and got[6] == (None, None, None)
    assert len(got) == len(texts)


def test_marks_of_any_form(spark):
    words = ["Điện Biên Phủ", "Ngã Bảy", "Ệ ộ ữ"]
    df = spark.createDataFrame([(unicodedata.normalize(f, w),) for w in words for f in ("NFC", "NFD")], "s string").select(address.normalised(F.col("s")).alias("n"))
    assert [r.n for r in df.collect()] == [x for w in ("dien bien phu", "nga bay", "e o u") for x in (w, w)]


def test_index_finds_all_pairs_of_long_lists(spark, monkeypatch):
    """The existing test's lists are short enough to be compared without the index; here the index has to find the same."""
    monkeypatch.setattr(address, "FEW", 0)
    test_index_finds_all_pairs(spark)


def test_numbered_texts_make_few_rows(spark):
    """Runs of words with a number in them differ from case to case: what such a part costs decides the cost of all. Up to 196 keys each before."""
    parts = spark.createDataFrame([(k, f"{n} machinery france", 3) for k in LISTS for n in range(100)], "kind string, part string, k int")
    assert address._keys(parts.withColumn("most", F.col("k")), "part", True).count() <= 44 * parts.count()
    # of few names nothing is cut into keys at all
    names = spark.createDataFrame([(k, n, n) for k in LISTS for n in ("machinery", "france")], "kind string, name string, norm string")
    plan = address.near(parts, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Generate" not in plan


def test_levels_share_their_rows(spark):
    """Each level has one running minimum, and runs of words are made twice: distinct ones, and those of the texts. Before, each level made them anew for both of its ways."""
    cases = spark.createDataFrame([(1, "12 Lê Lợi Hoàn Kiếm Phú Thọ")], "id int, text string")
    answers = address.segmented(cases, gazetteer(spark))
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Generate explode(sequence((lo") == 2
    assert answers.collect() == [(1, "Phú Thọ", "Hoàn Kiếm", "Lê Lợi")]


def test_runs_of_any_length_of_name(spark):
    """Runs that are too short or too long for every name are left out; the lengths next to these are not."""
    names = spark.createDataFrame([("province", "abcdefghijkl"), ("ward", "mnopqrstuvwx"), ("street", "yz01234yz5ab")], "kind string, name string")
    texts = ["abcdefghi", "abcdefghijklabc", "mnopqrstuvwxmno", "mnopqrstu abcdefghijklabc", "abcdefgh", "abcdefghijklabcd"]
    cases = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.province, r.ward, r.street) for r in address.segmented(cases, names).collect()}
    p, w = "abcdefghijkl", "mnopqrstuvwx"
    # of nine letters two edits are allowed, of fifteen three
    assert got == {0: (None,) * 3, 1: (p, None, None), 2: (None, w, None), 3: (p, None, None), 4: (None,) * 3, 5: (None,) * 3}
    none = address.segmented(cases, names.limit(0)).collect()
    assert len(none) == len(texts) and all(r[1:] == (None, None, None) for r in none)
