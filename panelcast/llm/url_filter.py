"""URL filters by rules and by a path-template tree per host.

A url that a rule fits has the rule's verdict; the longest fitting rule wins. These urls are also the labels from which the
method judges the others. Per host, paths become templates, level by level from the root:

- segments that are variable by their look (numbers, hexadecimal strings) become wildcards;
- of a node's branches, one stays literal if it has ``support`` labels and its share of blocked ones differs significantly from
  that of its labelled siblings together, or if these have no labels to compare; rare branches and those that are statistically
  alike are merged into one wildcard;
- segments below ``depth`` levels count as one.

The same tree is grown once more over the urls of all hosts. A template is judged by its labelled purity, smoothed towards the
share of blocked urls among all labelled ones (one half at most); one of fewer than ``support`` labels is judged by the
template that the url has in the tree of all hosts (its name starts with ``*``). It is rejected if the purity reaches ``purity``.
All statistics are sums over all urls, first summed map-side per distinct template. Each key that is joined carries the number of
rows that have it, and the hot ones (a host's template with many urls, the root page that every host has) are broadcast
(``common.joined``), so none is gathered in one task. Segments of any length are keyed by their SHA-256.

Defined results: a null url, or one without ``://``, has empty host and path, which no rule fits and the method allows; equal rows each give a row;
urls of any length are read whole; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, remove, stored

#: The rules of the contract, as (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEPTH, SUPPORT, Z2, PURITY, STRENGTH = 4, 5, 3.841, 0.8, 4.0
#: The host of the tree over all hosts; no host holds a slash.
ALL = "/"
_NUMBER, _HEX = r"^[0-9]+([.][a-z]+)?$", r"^[0-9a-f]{8,}(-[0-9a-f]+)*$"


def _parse(pages: DataFrame) -> DataFrame:
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    lower = F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest")).select("page_id", lower.alias("host"), path.alias("path"))


def _ruled(parsed: DataFrame, rules) -> DataFrame:
    """With ``rule`` and ``given`` (its verdict), null where no rule fits."""
    rule = given = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, given = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(given)
    return parsed.withColumns({"rule": rule, "given": given})


def _segments(depth: int):
    """The first ``depth`` segments, variable ones as wildcards; what follows counts as one."""
    return F.expr(f"transform(slice(filter(split(path, '/'), (s, i) -> i > 0 and s != ''), 1, {depth + 1}), (s, i) -> case when i = {depth} then '**' when s rlike '{_NUMBER}' then '{{n}}' when s rlike '{_HEX}' then '{{x}}' else s end)")


def judge(pages: DataFrame, rules=RULES, depth: int = DEPTH, support: int = SUPPORT, purity: float = PURITY, hidden=None) -> DataFrame:
    """page_id, host, path, rule, verdict, the template that judges each url, its smoothed purity, and the method's own verdict.

    ``hidden``: a condition on host and path; urls that meet it give no labels, so that the method can be held against their rules."""
    made: list = []
    ruled = _ruled(_parse(pages), rules).withColumn("segs", _segments(depth)).withColumn("label", F.col("given") if hidden is None else F.when(~hidden, F.col("given")))
    ruled = ruled.withColumn("id", F.sha2(F.to_json("segs"), 256))
    each = ruled.groupBy("host", "id").agg(F.first("segs").alias("segs"), F.count(F.lit(1)).alias("n"), F.count("label").alias("lab"), F.count_if(F.col("label") == "block").alias("blk"))
    sums, rows = [F.sum(c).alias(c) for c in ("n", "lab", "blk")], F.count(F.lit(1)).alias("rows")
    each = stored(each, "urls", made)
    over = each.groupBy("id").agg(F.first("segs").alias("segs"), *sums, F.count(F.lit(1)).alias("hosts")).withColumn("host", F.lit(ALL))
    tree = stored(each.withColumn("hosts", F.lit(1).cast("long")).unionByName(over).withColumn("template", F.lit("")), "urls", made)
    total = tree.count()
    for level in range(depth + 1):
        own = tree.withColumn("seg", F.get("segs", F.lit(level)))
        child = own.where("seg is not null").groupBy("host", "template", "seg").agg(*sums, rows)
        whole = child.groupBy("host", "template").agg(F.sum("lab").alias("lab_all"), F.sum("blk").alias("blk_all"), F.count(F.lit(1)).alias("children"))
        rest, p = F.col("lab_all") - F.col("lab"), F.col("blk_all") / F.greatest(F.col("lab_all"), F.lit(1))
        gap = F.col("blk") / F.greatest(F.col("lab"), F.lit(1)) - (F.col("blk_all") - F.col("blk")) / F.greatest(rest, F.lit(1))
        apart = (rest == 0) | (gap * gap > Z2 * p * (1 - p) * (1 / F.greatest(F.col("lab"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        literal = joined(child.where(F.col("lab") >= support), whole, ["host", "template"], "children", total).where(apart)
        literal = stored(literal.select("host", "template", "seg", "rows", F.lit(True).alias("literal")), "literal", made)
        step = F.when(F.col("seg").isNull(), "").when(F.col("literal") | F.col("seg").isin("{n}", "{x}", "**"), F.concat(F.lit("/"), "seg")).otherwise("/*")
        tree = joined(own, literal, ["host", "template", "seg"], "rows", total).withColumn("template", F.concat("template", step)).select("host", "id", "segs", "n", "lab", "blk", "hosts", "template")
        tree = stored(tree, "urls", made)
    mine = F.col("host") != ALL
    share = tree.where(mine).agg((F.sum("blk") / F.greatest(F.sum("lab"), F.lit(1))).alias("p"), F.sum("n").alias("n")).first()
    prior = min(0.5, share.p or 0.0)
    score = ((F.sum("blk") + STRENGTH * prior) / (F.sum("lab") + STRENGTH)).alias("purity")
    pure = stored(tree.groupBy("host", "template").agg(score, F.sum("lab").alias("known"), rows), "pure", made)
    judged = stored(joined(tree.select("host", "id", "n", "hosts", "template"), pure, ["host", "template"], "rows", total).drop("rows"), "rated", made)
    over = judged.where(~mine).select("id", "hosts", F.concat(F.lit("*"), "template").alias("template2"), F.col("purity").alias("purity2"))
    enough = F.col("known") >= support
    judged = joined(judged.where(mine).drop("hosts"), over, ["id"], "hosts", total)
    judged = stored(judged.select("host", "id", "n", F.when(enough, F.col("template")).otherwise(F.col("template2")).alias("template"), F.when(enough, F.col("purity")).otherwise(F.col("purity2")).alias("purity")), "judged")
    remove(pages.sparkSession, made)
    out = joined(ruled, judged, ["host", "id"], "n", share.n or 0)
    method = F.when((F.col("purity") >= purity) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"), method.alias("method"))


def oracle_sql(rules=RULES, depth: int = DEPTH, support: int = SUPPORT, purity: float = PURITY) -> str:
    """The same in DuckDB's SQL."""
    rule = given = "NULL"
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}'))"
        rule, given = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {given} END"
    sql = rf"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule, {given} AS given, list_filter(string_split(path, '/')[2:], lambda s: s <> '') AS raw FROM b),
ruled AS (SELECT *, list_transform(raw[1:{depth + 1}], lambda s, i: CASE WHEN i = {depth + 1} THEN '**' WHEN regexp_matches(s, '{_NUMBER}') THEN '{{n}}' WHEN regexp_matches(s, '{_HEX}') THEN '{{x}}' ELSE s END) AS segs FROM c),
u AS (SELECT host, segs, count(given) AS lab, count(*) FILTER (given = 'block') AS blk FROM ruled GROUP BY host, segs),
t0 AS (SELECT *, '' AS template FROM u UNION ALL SELECT '{ALL}', segs, sum(lab), sum(blk), '' FROM u GROUP BY segs)"""
    for k in range(depth + 1):
        sql += f""",
o{k} AS (SELECT *, segs[{k + 1}] AS seg FROM t{k}),
k{k} AS (SELECT host, template, seg, sum(lab) AS lab, sum(blk) AS blk FROM o{k} WHERE seg IS NOT NULL GROUP BY ALL),
w{k} AS (SELECT host, template, sum(lab) AS lab_all, sum(blk) AS blk_all FROM k{k} GROUP BY ALL),
l{k} AS (SELECT host, template, seg FROM k{k} JOIN w{k} USING (host, template) WHERE lab >= {support} AND (lab_all = lab
  OR pow(blk / lab - (blk_all - blk) / greatest(lab_all - lab, 1), 2) > {Z2} * (blk_all / lab_all) * (1 - blk_all / lab_all) * (1 / lab + 1 / greatest(lab_all - lab, 1)))),
t{k + 1} AS (SELECT o.host, segs, lab, blk, o.template || CASE WHEN o.seg IS NULL THEN '' WHEN l.seg IS NOT NULL OR o.seg IN ('{{n}}', '{{x}}', '**') THEN '/' || o.seg ELSE '/*' END AS template
  FROM o{k} o LEFT JOIN l{k} l ON o.host = l.host AND o.template = l.template AND o.seg = l.seg)"""
    last = f"t{depth + 1}"
    return sql + f""",
pr AS (SELECT least(0.5, coalesce(sum(blk) / greatest(sum(lab), 1), 0)) AS prior FROM u),
pure AS (SELECT host, template, sum(lab) AS known, (sum(blk) + {STRENGTH}::DOUBLE * any_value(prior)) / (sum(lab) + {STRENGTH}::DOUBLE) AS purity FROM {last}, pr GROUP BY host, template),
j AS (SELECT t.host, segs, t.template, known, purity FROM {last} t JOIN pure p ON p.host = t.host AND p.template = t.template),
v AS (SELECT j.host, j.segs, CASE WHEN j.known >= {support} THEN j.template ELSE '*' || o.template END AS template, CASE WHEN j.known >= {support} THEN j.purity ELSE o.purity END AS purity
  FROM j JOIN j o ON o.host = '{ALL}' AND o.segs = j.segs WHERE j.host <> '{ALL}')
SELECT page_id, r.host, path, rule, coalesce(given, CASE WHEN purity >= {purity} AND r.host <> '' THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity, CASE WHEN purity >= {purity} AND r.host <> '' THEN 'block' ELSE 'allow' END AS method
FROM ruled r JOIN v ON r.host = v.host AND r.segs = v.segs"""
