"""Secret scans by multipart credential linking, with DataFrame functions only.

Strong parts are reported wherever they stand: assignments, access identifiers and long hexadecimal strings. Weak parts - an
upper-case identifier, a mixed-case token of 32 or more characters, an endpoint - are reported only when they overlap no strong
one and a complementary part starts within ``scope`` code points: an identifier and a secret complete each other, and so do a
secret and an endpoint. The parts of a document are joined on (document, block of ``scope`` code points) with each part repeated
in the neighbouring blocks, so a join never compares parts that are far apart.

Positions come from marking the matches in the text and adding up the lengths between the marks, in runs of ``RUN`` matches, so
the work grows with the text and hardly with the square of its matches.

Defined results: null text is empty and has no spans; a null doc_id stays null; equal rows each give a row; ``scan`` keeps the
further columns of documents but replaces those named like its own; ``redact`` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_names, stored

SCOPE = 200
#: Matches that are added up one by one.
RUN = 256
#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: The strong patterns of the contract; in ``assign`` the last group is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The weak patterns.
WEAK_ID = r"(?<![A-Za-z0-9])(?=[A-Z][A-Z0-9]{15})(?=[A-Z]*[0-9])[A-Z0-9]{16,32}(?![A-Za-z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s"'<>]*)?"""
_OPEN, _MID, _SHUT, _OTHER = "\u0001", "\u0003", "\u0002", "\u0004"
_SPAN = "array<struct<start:int,k:int,end:int>>"
#: Roles that complete each other, as (kind, kind).
_PAIRS = ((1, 0), (1, 2), (1, 4), (3, 0), (3, 2), (3, 4), (4, 5))


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` is ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _runs(array: str) -> str:
    """The elements of an array in arrays of RUN at most."""
    return f"transform(sequence(0, cast((size({array}) - 1) / {RUN} as int)), c -> slice({array}, c * {RUN} + 1, {RUN}))"


def _spans(marked: str, kind: int, grouped: bool = False) -> str:
    """SQL for the spans that ``marked`` holds between its marks."""
    inner = f"length(substring_index(x, '{_SHUT}', 1))" + (" - 1" if grouped else "")
    span = f"named_struct('start', a.at, 'k', {kind}, 'end', a.at + {inner})"
    keep = f"if(length(substring_index(substring_index(x, '{_SHUT}', 1), '{_MID}', -1)) >= 6, array({span}), array())" if grouped else f"array({span})"
    marks = 2 if grouped else 1
    # where each run starts, then the spans of each run from there
    begins = f"aggregate(runs, array(length(substring_index({marked}, '{_OPEN}', 1))), (b, r) -> concat(b, array(element_at(b, -1) + aggregate(r, 0, (n, x) -> n + length(x) - {marks}))))"
    of_run = f"aggregate(r, named_struct('at', element_at(begins, i + 1), 's', cast(array() as {_SPAN})), (a, x) -> named_struct('at', a.at + length(x) - {marks}, 's', concat(a.s, cast({keep} as {_SPAN}))), a -> a.s)"
    parts = f"filter(split({marked}, '{_OPEN}'), (x, i) -> i > 0)"
    whole = _let(parts, "parts", _let(_runs("parts"), "runs", _let(begins, "begins", f"flatten(transform(runs, (r, i) -> {of_run}))")))
    return f"if(instr({marked}, '{_OPEN}') > 0, {whole}, cast(array() as {_SPAN}))"


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with _base (strong spans) and _weak (weak spans, also such as overlap strong ones)."""
    t = F.coalesce("text", F.lit(""))
    out = docs.withColumn("_t", F.when(t.rlike(f"[{_OPEN}-{_MID}]"), F.translate(t, _OPEN + _MID + _SHUT, _OTHER * 3)).otherwise(t))
    marks = {"_m0": (ASSIGN, f"{_OPEN}$1{_MID}$2{_SHUT}")} | {f"_m{i + 1}": (p, f"{_OPEN}$0{_SHUT}") for i, p in enumerate((ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT))}
    out = out.withColumns({k: F.regexp_replace("_t", F.lit(p), F.lit(r)) for k, (p, r) in marks.items()})
    out = out.withColumn("_base", F.expr("array_sort(concat(" + ", ".join(_spans(f"_m{i}", i, i == 0) for i in range(3)) + "))"))
    out = out.withColumn("_weak", F.expr("concat(" + ", ".join(_spans(f"_m{i}", i) for i in range(3, 6)) + ")"))
    return out.drop("_t", *marks)


def _links(cand: DataFrame, scope: int) -> DataFrame:
    """_h and _linked: the weak spans of each candidate document that overlap no strong one and that a complementary part completes."""
    parts = cand.select("_h", "_base", "_weak").dropDuplicates(["_h"]).select("_h", F.explode(F.concat("_base", "_weak")).alias("p"))
    parts = parts.select("_h", F.col("p.start").alias("start"), F.col("p.k").alias("k"), F.col("p.end").alias("end"), F.floor(F.col("p.start") / scope).alias("block"))
    # the furthest end of the strong parts that start no later, and the nearest start of those that start no earlier
    order, strong = Window.partitionBy("_h").rangeBetween(Window.unboundedPreceding, 0), F.col("k") < 3
    parts = parts.withColumn("_until", F.max(F.when(strong, F.col("end"))).over(order.orderBy("start")))
    parts = parts.withColumn("_from", F.min(F.when(strong, F.col("start"))).over(order.orderBy(F.desc("start"))))
    apart = (F.coalesce("_until", F.lit(0)) <= F.col("start")) & (F.col("_from").isNull() | (F.col("_from") >= F.col("end")))
    parts = parts.where(strong | apart).drop("_until", "_from")
    other = parts.select("_h", F.col("start").alias("start2"), F.col("k").alias("k2"), F.explode(F.array(*(F.col("block") + i for i in (-1, 0, 1)))).alias("block"))
    completes = F.lit(False)
    for a, b in _PAIRS:
        completes = completes | ((F.col("k") == a) & (F.col("k2") == b)) | ((F.col("k") == b) & (F.col("k2") == a))
    near = parts.where("k >= 3").join(other, ["_h", "block"]).where((F.abs(F.col("start") - F.col("start2")) <= scope) & completes)
    return near.groupBy("_h").agg(F.collect_set(F.struct("start", "k", "end")).alias("_linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (start, k, end), k an index of KINDS, sorted by start and kind."""
    docs = docs.drop("base", "spans")
    inner = own_names(docs)
    return _linked(stored(_with_spans(inner), "spans"), inner.columns, scope).toDF(*docs.columns, "base", "spans")


def _linked(found: DataFrame, keep: list[str], scope: int) -> DataFrame:
    roles = F.array_distinct(F.transform(F.concat("_base", "_weak"), lambda s: F.when(s.k.isin(1, 3), 0).when(s.k == 5, 2).otherwise(1)))
    maybe = (F.size("_weak") > 0) & (F.size(roles) > 1)
    plain = found.where(~maybe).withColumn("spans", F.col("_base"))
    cand = found.where(maybe).withColumn("_h", F.sha2(F.to_json(F.struct("doc_id", "_base", "_weak")), 256))
    linked = cand.join(_links(cand, scope), "_h", "left").withColumn("spans", F.expr(f"array_sort(concat(_base, coalesce(_linked, cast(array() as {_SPAN}))))"))
    keep = [*keep, "_base", "spans"]
    return plain.select(keep).unionByName(linked.select(keep)).withColumnRenamed("_base", "base")


def as_text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.k], s.start.cast("string"), s.end.cast("string"))), ",")


def _masked(mask: str) -> str:
    """SQL for ``text`` with its ``spans`` masked, a run of spans at a time."""
    # how far the spans of all runs before reach; a run's own text goes from there to where it reaches itself
    reach = "aggregate(runs, array(0), (b, r) -> concat(b, array(greatest(element_at(b, -1), array_max(transform(r, s -> s.end))))))"
    fold = f"aggregate(r, named_struct('at', low, 'out', ''), (a, s) -> if(s.end <= a.at, a, named_struct('at', s.end, 'out', concat(a.out, if(s.start < a.at, '', concat(substring(t, a.at - low + 1, s.start - a.at), '{mask}'))))), a -> a.out)"
    own = "substring(text, element_at(reach, i + 1) + 1, element_at(reach, i + 2) - element_at(reach, i + 1))"
    runs = f"transform(runs, (r, i) -> {_let('element_at(reach, i + 1)', 'low', _let(own, 't', fold))})"
    return _let(_runs("spans"), "runs", _let(reach, "reach", f"concat(array_join({runs}, ''), substring(text, element_at(reach, -1) + 1))"))


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs, each found span of the text replaced by ``mask`` (overlapping spans by one mask); other texts are unchanged."""
    names = docs.columns
    inner = own_names(docs)
    return scan(inner, scope).withColumn("text", F.expr(f"if(size(spans) > 0, {_masked(mask)}, text)")).select(inner.columns).toDF(*names)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of strong spans per kind, a digest of them, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s.k == k)).cast("long")
    found = stored(_with_spans(docs.select(F.col("doc_id").cast("long"), "text")).drop("text"), "spans")
    return _linked(found, ["doc_id"], SCOPE).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def oracle_sql(scope: int = SCOPE) -> str:
    """``digest`` over the table documents in DuckDB's SQL; its expressions have no look-around, so weak parts are whole runs that pass further tests."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""(({word})["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)"""
    run = r"[A-Za-z0-9+/_-]"
    plain = {1: ACCESS, 2: HEX, 3: "[A-Za-z0-9]{16,}", 4: run + "{32,}", 5: r"""https?://[A-Za-z0-9.-]+(:[0-9]+)?(/[^\x20\x09-\x0D"''<>]*)?"""}
    marked = " UNION ALL ".join([f"SELECT r, 0 AS k, regexp_replace(t, '{assign}', chr(1) || '\\1' || chr(3) || '\\3' || chr(2), 'g') AS m FROM d", *(f"SELECT r, {k}, regexp_replace(t, '({x})', chr(1) || '\\1' || chr(2), 'g') FROM d" for k, x in plain.items())])
    text = f"{list(KINDS)}[k + 1] || ':' || start || ':' || stop"
    completes = " OR ".join(f"(a.k = {x} AND b.k = {y}) OR (a.k = {y} AND b.k = {x})" for x, y in _PAIRS)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), repeat(chr(4), 3)) AS t FROM documents),
m AS ({marked}),
p AS (SELECT r, k, unnest(string_split(m, chr(1))) AS x, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m WHERE contains(m, chr(1))),
q AS (SELECT r, k, i, split_part(x, chr(2), 1) AS own, CAST(sum(length(x) - CASE WHEN i = 1 THEN 0 WHEN k = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY r, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS start FROM p),
f AS MATERIALIZED (SELECT r, k, start, start + length(own) - CASE WHEN k = 0 THEN 1 ELSE 0 END AS stop FROM q WHERE i > 1 AND (k <> 0 OR length(split_part(own, chr(3), 2)) >= 6)
  AND (k <> 3 OR regexp_full_match(own, '[A-Z][A-Z0-9]{{15,31}}') AND regexp_matches(own, '[0-9]')) AND (k <> 4 OR regexp_matches(own, '[0-9]') AND regexp_matches(own, '[a-z]') AND regexp_matches(own, '[A-Z]'))),
g AS (SELECT * FROM f WHERE k < 3 OR NOT EXISTS (FROM f AS s WHERE s.r = f.r AND s.k < 3 AND s.start < f.stop AND f.start < s.stop)),
l AS (SELECT DISTINCT a.* FROM g a JOIN g b ON a.r = b.r WHERE a.k >= 3 AND abs(a.start - b.start) <= {scope} AND ({completes})),
o AS (SELECT * FROM g WHERE k < 3 UNION ALL SELECT * FROM l),
n AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({text}, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base, string_agg({text}, ',' ORDER BY start, k, stop) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n ON n.r = d.r"""
