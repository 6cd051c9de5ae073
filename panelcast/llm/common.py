"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where that is unset in a local session, a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark, "_panelcast_dir", None)
    if own is None:
        own = spark._panelcast_dir = "file://" + tempfile.mkdtemp(prefix="panelcast-")
    return own


#: With it, what a query has shuffled is deleted when it ends, not when the driver's JVM happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, made: list | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there, so a lost executor costs no earlier stage, and what was shuffled for it is deleted. ``made`` gets the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelcast-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, made: list) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    made.clear()


#: Keys of no more rows than this are always joined by a shuffle.
HOT = 1_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int) -> DataFrame:
    """Left join of ``left``, of ``rows`` rows, with ``right``, which has one row per key; ``weight``: rows of ``left`` with that key.

    Keys of more than a 65,536th of all rows, at most 65,536 of them, are broadcast, so no hot key meets in one task."""
    hot = F.col(weight) > max(HOT, rows >> 16)
    often = F.broadcast(right.where(hot).withColumn("_often", F.lit(True)))
    split = left.join(often, keys, "left")
    rare = split.where("_often is null").select(left.columns).join(right.where(~hot), keys, "left")
    return split.where("_often").drop("_often").unionByName(rare)


def own_names(docs: DataFrame) -> DataFrame:
    """docs, every column but doc_id and text renamed, so that none clashes with an operator's own."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"in__{k}" for k, c in enumerate(docs.columns)])


def arrow_schema(ddl: str) -> pa.Schema:
    """A pyarrow schema from ``name type`` pairs; types: long, int, double, string, binary, boolean and lists of long."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def packed(x: np.ndarray) -> bytes:
    """An array in few bytes: its numbers' first bytes, then their second bytes and so on, compressed. Small numbers, such as steps of a sorted array, take little room."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def slices(batches, rows: int = 256):
    """Small slices of Arrow batches, so that the Python objects made from a batch stay few."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
