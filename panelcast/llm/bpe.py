"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that share ``overlap`` characters with the next; one no longer than ``chunk`` is a single chunk.
Chunks are pre-tokenised in parallel; each reports its pre-token boundaries inside the shared zones. Where a boundary of a
chunk is also one of the next chunk, both split the text alike from there on (the pattern looks back at nothing), so the
text is cut there. The pieces are encoded in parallel and their ids joined in order; decoding joins the tokens' bytes.

A zone has no cut if its chunks share no boundary there (a pre-token longer than the overlap), or if one of them holds
characters whose class the libraries see differently. The two chunks of such a zone stay in one piece; the others are cut as
before. A chunk that does not begin at a cut is in step with the whole text from its first blank after a letter or digit, as no
pre-token holds such a pair; its later boundaries count from there only.

Defined results: null text is an empty one; an empty text has no ids; equal rows each give a row; a null doc_id stays null;
further columns are dropped.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, batch, slices
from .pretokens import coder, splitter

CHUNK, OVERLAP = 32_768, 1_024
#: A boundary this close to a cut-off end can still change: the longest fixed match of the pattern, and one character.
_MARGIN = 4
#: Whatever stands before: a pre-token ends between these two.
_IN_STEP = re.compile("[A-Za-z0-9](?= )")
_OUT = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string,n_pieces long"


def _digest(doc_ids, parts: list[tuple[bytes, bytes]], pieces: int):
    ids, text = hashlib.sha256(), hashlib.sha256()
    n = 0
    for a, b in parts:
        ids.update(a)
        text.update(b)
        n += len(a) // 4
    return doc_ids, n, ids.hexdigest(), text.hexdigest(), pieces


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids and decoded bytes of each document, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    out = arrow_schema(_OUT)

    def whole(batches):
        c = coder(path)
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = c.ids(t)
                rows.append(_digest(d, [(ids, c.decode(ids))], 1))
            yield batch(out, list(zip(*rows, strict=True)))

    short = docs.where(~is_long).mapInArrow(whole, _OUT)
    return short.unionByName(_long(docs.where(is_long), path, chunk, overlap))


def _long(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    cut_ddl = "doc_id long,h string,n long,k int,last boolean,part string"
    cut_schema = arrow_schema(cut_ddl)

    def cut(batches):
        for b in slices(batches, 16):
            for d, h, n, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                starts = range(0, len(t), chunk)
                for k, at in enumerate(starts):
                    yield batch(cut_schema, [[d], [h], [n], [k], [k == len(starts) - 1], [t[at : at + chunk + overlap]]])

    zone_ddl = cut_ddl + ",sure int,head array<int>,tail array<int>"
    zone_schema = arrow_schema(zone_ddl)

    def pretokenise(batches):
        for b in slices(batches, 16):
            for i in range(b.num_rows):
                row = [b.column(j)[i].as_py() for j in range(6)]
                k, last, t = row[3:]
                pattern, head, tail = splitter(t), [], []
                for m in pattern.finditer(t) if pattern else ():
                    p = m.start()
                    if 0 < p <= overlap:
                        head.append(p)
                    if p >= chunk and not last and p <= len(t) - _MARGIN:
                        tail.append(p - chunk)
                step = _IN_STEP.search(t)
                sure = 0 if k == 0 else step.end() if step else None
                yield batch(zone_schema, [[x] for x in (*row, sure, head, tail)])

    order = Window.partitionBy("doc_id", "h").orderBy("k")
    # equal rows are encoded once and given back as often as they came
    once = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.sha2("text", 256).alias("h"), "n", "text")
    zones = once.mapInArrow(cut, cut_ddl).repartition("doc_id", "h", "k").mapInArrow(pretokenise, zone_ddl)
    zones = zones.withColumn("common", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    # a cut is good if its chunk is in step there: by its own text, or by an unbroken row of cuts since a chunk that is
    own = F.col("common").isNotNull() & (F.col("sure") <= F.col("common") + chunk)
    since = lambda c: F.coalesce(F.max(F.when(c, F.col("k"))).over(order), F.lit(-1))
    in_step = F.col("common").isNotNull() & (since(F.coalesce(own, F.lit(False))) > since(F.col("common").isNull()))
    zones = zones.withColumn("cut", F.when(in_step, F.col("common"))).withColumn("start", F.lag("cut").over(order))
    zones = zones.withColumn("piece", F.count("start").over(order))
    part = F.expr(f"substring(part, coalesce(start, 0) + 1, if(last, length(part), {chunk} + coalesce(cut, 0)) - coalesce(start, 0))")
    pieces = zones.select("doc_id", "h", "n", "piece", F.struct("k", part.alias("part")).alias("x"))
    # a piece of several chunks is put together where it is encoded
    pieces = pieces.groupBy("doc_id", "h", "n", "piece").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("part"), "").alias("part"))
    coded_ddl = "doc_id long,h string,n long,piece long,ids binary,raw binary"
    coded_schema = arrow_schema(coded_ddl)

    def encode_pieces(batches):
        c = coder(path)
        for b in slices(batches, 16):
            for i in range(b.num_rows):
                *key, part = (b.column(j)[i].as_py() for j in range(5))
                ids = c.ids(part)
                yield batch(coded_schema, [[x] for x in (*key, ids, c.decode(ids))])

    def joined(pdf):
        import pandas as pd

        pdf = pdf.sort_values("piece")
        parts = list(zip(pdf.ids, pdf.raw, strict=True))
        d = None if pd.isna(pdf.doc_id.iloc[0]) else int(pdf.doc_id.iloc[0])
        return pd.DataFrame([_digest(d, parts, len(parts))] * int(pdf.n.iloc[0]), columns=[x.split()[0] for x in _OUT.split(",")]).astype({"doc_id": "Int64"})

    return pieces.mapInArrow(encode_pieces, coded_ddl).groupBy("doc_id", "h").applyInPandas(joined, _OUT)
