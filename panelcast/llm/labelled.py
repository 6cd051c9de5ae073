"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a text that a sample may hold.
MOST = 1 << 16


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int, balance: bool = False, fill: bool = False, most: int = MOST) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` of the documents with a text of at most ``most`` bytes and a usable label, one row per doc_id (that of the least text).

    They are the least by a hash of doc_id, with ``balance`` half of them positive if there are as many; with ``fill`` a class
    short of its half leaves its places to the other. A doc_id with several labels counts as its largest. So no more than
    ``sample`` rows and ``sample`` times ``most`` bytes are gathered, whatever the table holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).where(usable)
    # only labels of documents that are there take places
    texts = docs.where(F.octet_length("text") <= most).select("doc_id", "text")
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    if balance:
        half = {1: sample // 2, 0: sample - sample // 2}
        parts = [known.where(F.col("y") == y).orderBy(*order).limit(sample if fill else n).withColumn("_more", F.row_number().over(Window.partitionBy("y").orderBy(*order)) > n) for y, n in half.items()]
        chosen = parts[0].unionByName(parts[1]).orderBy("_more", *order).limit(sample).drop("_more")
    else:
        chosen = known.orderBy(*order).limit(sample)
    # the sample is a documented bound, so broadcasting it is one too; rows of one doc_id are reduced before they are sent
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
