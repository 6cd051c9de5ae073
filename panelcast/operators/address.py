"""Matching free-text addresses with reference lists, and judging the result field by field.

A matcher maps cases (id, text) to (id, province, ward, street). Names are compared through an index of their segments
(``near``): two texts within k edits, one of them cut into k + 1 segments, have a segment in common, at places at most k apart. So
names and texts meet in an equi-join on such segments, whatever the length of the lists, and only pairs that meet are compared.
Of lists of few names all of similar length are compared, which moves nothing.
``nearest`` takes texts whose levels stand between commas, ``segmented`` texts without."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from . import windows as W

FIELDS = ("province", "ward", "street")
#: Names that a broadcast list may have.
MOST = 100_000
#: Latin letters with marks and their plain forms, by plain letter.
MARKS = {"a": "àáảãạăằắẳẵặâầấẩẫậäåā", "e": "èéẻẽẹêềếểễệëē", "i": "ìíỉĩịïî", "o": "òóỏõọôồốổỗộơờớởỡợöø", "u": "ùúủũụưừứửữựüû", "y": "ỳýỷỹỵÿ", "d": "đ", "c": "ç", "n": "ñ"}


def normalised(c):
    """Lower case, marks stripped (of composed letters and combining ones), punctuation and blanks as single blanks."""
    marked, plain = "".join(MARKS.values()), "".join(k * len(v) for k, v in MARKS.items())
    bare = F.regexp_replace(F.translate(F.lower(c), marked, plain), r"\p{M}+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


#: Most edits that the index covers.
EDITS = 3
#: Names up to which all of similar length are compared, without the index.
FEW = 200
#: Names in a block of the comparison of all.
BLOCK = 5_000


def _keys(df: DataFrame, text: str, right: bool) -> DataFrame:
    """df with ``key``s: of names the segments for each number of edits, of texts, which have a column k, places of segments of names of similar length.

    The first segment before which, and in which, there are fewer edits than segments is whole: the j segments before it have j edits
    and those behind it k - j at most. So it is moved by j at most, and against the ends of the texts by k - j."""
    size = f"length({text})"
    at = "cast(floor(j * n / (k + 1)) as int)"
    to = "cast(floor((j + 1) * n / (k + 1)) as int)"
    if right:
        moved = f"filter(sequence(-j, j), d -> abs(d - ({size} - n)) <= k - j)"
        spots = f"filter(transform({moved}, d -> {at} + d), a -> a >= 0 AND a + {to} - {at} <= {size})"
        each = f"transform({spots}, a -> concat_ws(':', k, n, j, substring({text}, a + 1, {to} - {at})))"
        df = df.withColumn("n", F.expr(f"explode(sequence(greatest({size} - k, 0), {size} + k))"))
        whole = f"array_distinct(flatten(transform(sequence(0, k), j -> {each})))"
    else:
        df = df.withColumn("n", F.length(text)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(EDITS))))
        whole = f"transform(sequence(0, k), j -> concat_ws(':', k, n, j, substring({text}, {at} + 1, {to} - {at})))"
    return df.withColumn("key", F.explode(F.expr(whole))).drop("n", "k")


def met(parts: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs that meet in the index, each once for every segment in which it does: of parts (kind, part, k) and names (kind, name, norm)."""
    left = _keys(parts.select("kind", "part", "k", F.col("k").alias("most")), "part", True)
    return left.join(_keys(names.select("kind", "name", "norm"), "norm", False), ["kind", "key"])


def near(parts: DataFrame, names: DataFrame) -> DataFrame:
    """kind, part, name, norm and distance of all pairs within k edits, k being a column of ``parts`` (kind, part, k) from 0 to EDITS; pairs come at least once.

    ``names`` is read several times: keep it first."""
    if names.limit(FEW + 1).count() <= FEW:
        some = F.broadcast(names.select("kind", "name", "norm", F.length("norm").alias("n")))
        pairs = parts.select("kind", "part", F.col("k").alias("most"), F.length("part").alias("size")).join(some, "kind").where(F.abs(F.col("size") - F.col("n")) <= F.col("most"))
    else:
        pairs = met(parts, names)
    found = pairs.select("kind", "part", "name", "norm", F.levenshtein("part", "norm", EDITS).alias("distance"), "most")
    return found.where("distance >= 0 AND distance <= most").drop("most")


def best_names(parts: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, part, name): for each distinct part the name of least edit distance, ties to the longer, then the smaller name. Kinds without names give nothing.

    Where the index finds a name within some edits, it has all that are as near. Most parts have one within one edit, for which few
    pairs meet; only the others are looked up with up to EDITS. What is left is compared with all names of its kind, a block of
    names in a task."""
    order = F.struct("distance", -F.length("norm"), "name")
    far, found = parts.select("kind", "part").distinct(), None
    for most in (1, EDITS):
        asked = far.withColumn("k", F.least(F.greatest((F.length("part") / 4).cast("int"), F.lit(1)), F.lit(most)))
        if found is not None:
            asked = asked.where("k > 1")
        own = near(asked, names).groupBy("kind", "part").agg(F.min_by("name", order).alias("name"))
        far = far.join(own, ["kind", "part"], "left_anti")
        found = own if found is None else found.unionByName(own)
    # names in blocks of about BLOCK; a part goes to each block of its kind
    many = names.groupBy("kind").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    split = names.join(many, "kind").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")).drop("blocks")
    each = far.join(many, "kind").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    rest = each.join(split, ["kind", "block"]).withColumn("distance", F.levenshtein("part", "norm")).groupBy("kind", "part").agg(F.min_by("name", order).alias("name"))
    return found.unionByName(rest)


def checked(gazetteer: DataFrame) -> DataFrame:
    if gazetteer.limit(MOST + 1).count() > MOST:
        raise ValueError(f"a reference list of more than {MOST} names is not broadcast")
    return F.broadcast(gazetteer)


def stub(cases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The first name of each list for every case."""
    first = gazetteer.groupBy().agg(*(F.min(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in FIELDS))
    return cases.select("id").join(F.broadcast(first))


def nearest(cases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Segments between commas, from the right: province, ward, street; for each the name of least edit distance, ties to the longer, then the smaller name.

    A leading house number is dropped from the street unless the segment is a number alone."""
    names = kept(gazetteer.where("name is not null").select("kind", "name", normalised(F.col("name")).alias("norm")).distinct())
    parts = F.reverse(F.split("text", ","))
    raw = {k: F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i, k in enumerate(FIELDS)}
    raw["street"] = F.regexp_replace(raw["street"], r"^\s*[0-9]+[A-Za-z]?(/[0-9]+)*\s+", "")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), normalised(v).alias("part")) for k, v in raw.items()))).alias("s")
    # an equal name is the nearest one; only what is left is compared, each distinct segment once
    same = names.groupBy("kind", F.col("norm").alias("part")).agg(F.min("name").alias("name"))
    known = cases.select("id", each).select("id", "s.*").join(same, ["kind", "part"], "left")
    rest = known.where("name is null").drop("name")
    found = known.where("name is not null").unionByName(rest.join(best_names(rest, names), ["kind", "part"], "left"))
    return found.groupBy("id").agg(*(F.min(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in FIELDS))


#: What a level without a name costs, in edits.
MISSING = 4


def segmented(cases: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Texts in which nothing marks the levels: street, ward and province in this order, found together.

    The words of a normalised text may be left out, at the cost of their letters (numbers for nothing); a run of words may stand
    for a name of a level, at the cost of their edit distance, which may be a quarter of the run's letters, rounded down, and EDITS at
    most; a level may have no name, for MISSING. The answer is the cheapest way, ties to more letters in its names, then to the
    smaller street, ward and province. So a name that stands on two lists falls to the level that the rest of the text leaves it.

    Runs have as many words as the longest name and one more at most. Distinct runs meet the lists in the index; what of a run depends on
    its words alone is found there, once for each. The cheapest way is found level by level: for each run of a level the best way of
    the levels before that ends no later, by a running minimum over the places of the text, so the work grows with the runs that match
    and not with their combinations. All levels go through the same rows, which are dealt by text once."""
    # the test of norm stays behind what is stored: before, it would be made on every row that the lists are drawn from
    names = kept(gazetteer.where("name is not null").select("kind", "name").distinct().withColumn("norm", normalised(F.col("name")))).where("norm != ''")
    size = F.length("norm")
    longest, short, long = names.agg(F.max(F.size(F.split("norm", " "))), F.min(size) - EDITS, F.max(size) + EDITS).first()
    # few bytes, much work: dealt anew, as a file of many cases may be one split
    words = cases.select("id", "text").repartition("id").select("id", F.split(normalised(F.col("text")), " ").alias("w"))
    each = words.select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("lo"))
    runs = each.select("id", "w", "lo", F.explode(F.sequence(F.col("lo") + 1, F.least(F.size("w"), F.col("lo") + (longest or 1) + 1))).alias("hi"))
    runs = runs.select("id", "lo", "hi", F.array_join(F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo")), " ").alias("part"))
    # others are too short or too long for any name
    runs = runs.where(F.length("part").between(short or 0, long or 0))
    distinct = runs.select("part").distinct().withColumn("k", F.least((F.length("part") / 4).cast("int"), F.lit(EDITS)))
    distinct = distinct.select(F.explode(F.array(*map(F.lit, FIELDS))).alias("kind"), "part", "k")
    order = F.struct("distance", -F.length("norm"), "name")
    hits = near(distinct, names).groupBy("kind", "part").agg(F.min(order).alias("o"))
    saved = F.aggregate(F.split("part", " "), F.lit(0), lambda n, x: n + F.when(x.rlike("^[0-9]+$"), 0).otherwise(F.length(x)))
    hits = hits.select("kind", "part", (F.col("o.distance") - saved).alias("cost"), F.col("o.col2").alias("less"), F.col("o.name").alias("name"))
    found = runs.join(hits, "part").drop("part")
    # a way: what it costs against leaving all words out, the letters of its names (below 0), and these
    levels = ("street", "ward", "province")
    way = lambda cost, less, *found: F.struct(cost.cast("int").alias("cost"), less.cast("int").alias("less"), *(n.cast("string").alias(k) for k, n in zip(levels, found, strict=False)))
    blank = lambda n: way(F.lit(MISSING * n), F.lit(0), *[F.lit("")] * n)
    cost, less, name = F.col("cost"), F.col("less"), F.col("name")
    found = found.withColumn("way", F.when(F.col("kind") == levels[0], way(cost, less, name)))
    for n, level in enumerate(levels[1:], 1):
        own = F.col("kind") == level
        # of the ways that end no later; the one without names can begin anywhere
        at, turn = F.when(own, F.col("lo")).otherwise(F.col("hi")), own.cast("int")
        so_far = W.Window.partitionBy("id").orderBy(at, turn).rowsBetween(W.Window.unboundedPreceding, 0)
        found = found.withColumn("before", F.least(F.min("way").over(so_far), blank(n)))
        taken = way(F.col("before.cost") + cost, F.col("before.less") + less, *(F.col(f"before.{k}") for k in levels[:n]), name)
        # or the level has no name
        left = way(F.col("way.cost") + MISSING, F.col("way.less"), *(F.col(f"way.{k}") for k in levels[:n]), F.lit(""))
        found = found.withColumn("way", F.when(own, taken).when(F.col("way").isNotNull(), left)).drop("before")
    answers = found.groupBy("id").agg(F.min("way").alias("way"))
    answers = cases.select("id").join(answers, "id", "left").withColumn("way", F.least("way", blank(len(levels))))
    return answers.select("id", *(F.nullif(F.col(f"way.{k}"), F.lit("")).alias(k) for k in FIELDS))


class FirstNames:
    """The first name of each list, whatever the text: the least that a class for ``solved`` has to do."""

    def __init__(self, province: list[str], ward: list[str], street: list[str]):
        self.answer = {k: names[0] for k, names in zip(FIELDS, (province, ward, street), strict=True)}

    def process(self, text: str) -> dict[str, str]:
        return self.answer


def solved(cases: DataFrame, gazetteer: DataFrame, make: Callable) -> DataFrame:
    """id, province, ward, street, time_sec by a Python object of one's own: ``make(province, ward, street)``, lists of names in
    order, gives one per task, and its ``process(text)`` a mapping with the three fields.

    Where ``process`` raises, or its answer is no such mapping, the fields and the time are null; it never stops the batch."""
    rows = gazetteer.where("name is not null").select("kind", "name").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a reference list of more than {MOST} names is not broadcast")
    lists = cases.sparkSession.sparkContext.broadcast([sorted(r.name for r in rows if r.kind == k) for k in FIELDS])

    def run(batches):
        solution = make(*lists.value)
        for pdf in batches:
            out = []
            for text in pdf.text:
                try:
                    began = time.perf_counter_ns()
                    answer = solution.process(text)
                    seconds = (time.perf_counter_ns() - began) / 1e9
                    out.append((*(str(answer[k]) for k in FIELDS), seconds))
                except Exception:
                    out.append((None, None, None, None))
            yield pd.DataFrame(out, columns=[*FIELDS, "time_sec"]).assign(id=pdf.id.to_numpy())[["id", *FIELDS, "time_sec"]]

    return cases.select("id", "text").mapInPandas(run, f"id {cases.schema['id'].dataType.simpleString()}, province string, ward string, street string, time_sec double")


def edit_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each name of a with its distance to each of the few names of b."""
    return a.select(F.col("name").alias("a")).join(checked(b.select(F.col("name").alias("b")))).select("a", "b", F.levenshtein("a", "b").alias("distance"))


def judge(cases: DataFrame, answers: DataFrame, normalise: Callable = lambda c: c) -> DataFrame:
    """Details per case: truth, answer, both normalised, correct per field, and their sum.

    A case without an answer, or with a null field, has EXCEPTION there and is not correct; it never stops the batch. Answers
    with a time give a further column time_sec, 0 for exceptions."""
    times = [F.coalesce("time_sec", F.lit(0.0)).alias("time_sec")] if "time_sec" in answers.columns else []
    given = answers.select("id", *(F.col(f).alias(f"{f}_student") for f in FIELDS), *(["time_sec"] if times else []))
    df = cases.join(given, "id", "left").withColumns({f"{f}_student": F.coalesce(f"{f}_student", F.lit("EXCEPTION")) for f in FIELDS})
    for f in FIELDS:
        df = df.withColumns({f"{f}_normalized": normalise(F.col(f)), f"{f}_student_normalized": normalise(F.col(f"{f}_student"))})
        df = df.withColumn(f"{f}_correct", F.coalesce((F.col(f"{f}_normalized") == F.col(f"{f}_student_normalized")).cast("int"), F.lit(0)))
    total = sum((F.col(f"{f}_correct") for f in FIELDS), F.lit(0))
    cols = [c for f in FIELDS for c in (f, f"{f}_student", f"{f}_normalized", f"{f}_student_normalized", f"{f}_correct")]
    return df.select("id", "text", *cols, total.alias("total_correct"), *times)


def total(details: DataFrame) -> DataFrame:
    """correct, total and the score of ten, rounded to two digits; 0 without cases. With times also the longest and the mean one of
    the cases that were answered, rounded to four digits."""
    n, good = 3 * F.count(F.lit(1)), F.coalesce(F.sum("total_correct"), F.lit(0))
    out = [good.cast("long").alias("correct"), n.alias("total"), F.round(F.coalesce(F.try_divide(good * 10, n), F.lit(0.0)), 2).alias("score")]
    if "time_sec" in details.columns:
        taken = F.when(F.col("time_sec") > 0, F.col("time_sec"))
        out += [F.bround(F.coalesce(f(taken), F.lit(0.0)), 4).alias(f"{k}_time_sec") for k, f in (("max", F.max), ("avg", F.avg))]
    return details.agg(*out)


def cases_of(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases and reference lists made from customers: street = segment, ward = nation, province = region, with noise by customer number."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    small = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    c = t("customer").join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    ward = F.when(k % 3 == 0, F.expr("concat(substring(n_name, 1, cast(c_custkey % length(n_name) as int)), substring(n_name, cast(c_custkey % length(n_name) as int) + 2))")).otherwise(F.col("n_name"))
    street = F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.translate("c_mktsegment", "AEIO", "ÀÉÌÒ"))
    text = F.concat(k.cast("string"), F.lit(" "), street, F.lit(", "), ward, F.lit(", "), F.col("r_name"))
    cases = c.select(k.alias("id"), text.alias("text"), F.col("r_name").alias("province"), F.col("n_name").alias("ward"), F.col("c_mktsegment").alias("street"))
    kinds = [t("region").select(F.lit("province").alias("kind"), F.col("r_name").alias("name")), t("nation").select(F.lit("ward"), "n_name"), t("customer").select(F.lit("street"), "c_mktsegment").distinct()]
    return cases, kinds[0].union(kinds[1]).union(kinds[2])
