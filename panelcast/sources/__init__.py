"""Readers of price and volume bars, result tables, address cases and reference lists.

Bars are one long table (stk, i, date or ts, p, v): i numbers a key's rows in time order from 0, and every window orders by it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.utils import AnalysisException

from ..session import kept

#: The positional columns of a bar matrix.
BAR_COLUMNS = ("date", "opn", "cls", "low", "high", "nsh", "vol", "adj")
BAR_SCHEMA = "stk string, i int, " + ", ".join(f"{c} double" for c in BAR_COLUMNS)
#: Step of the synthetic price walk.
WALK = 0.005


def opened(path: str):
    """The file system of a path or URI, as Arrow opens it, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Rows(InputPartition):
    """Rows low .. high - 1 of a file."""

    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))


class NpyReader(DataSourceReader):
    """Bounds on ``i`` choose the rows that are read, equality on ``stk`` the files; other comparisons of columns with numbers are tested on
    Arrow batches before rows are made. With the option ``sorted`` (dates do not fall), bounds on ``date`` choose rows too, by bisection."""

    def __init__(self, path: str, chunk: int, ordered: bool):
        self.path, self.chunk, self.ordered, self.tests, self.key = path, chunk, ordered, [], None

    def pushFilters(self, filters):
        kinds = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if type(f) in kinds and len(f.attribute) == 1 else None
            if column == "stk" and isinstance(f, EqualTo):
                self.key = f.value
                yield f  # two names would both have to hold
            elif column in ("i", *BAR_COLUMNS) and isinstance(f.value, (int, float)):
                self.tests.append((column, kinds[type(f)], float(f.value)))
            else:
                yield f

    def _files(self) -> list[str]:
        from pyarrow import fs

        where, at = opened(self.path)
        info = where.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".npy")]
        else:
            found = [at] if info.type == fs.FileType.File else []
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else self.path.split("://")[0] + "://"
        return sorted(head + f for f in found if self.key in (None, self._key(f)))

    @staticmethod
    def _key(path: str) -> str:
        return path.rsplit("/", 1)[-1].removesuffix(".npy")

    def partitions(self):
        out = []
        for path in self._files():
            with Matrix(path) as m:
                low, high = 0, m.rows
                for column, op, v in self.tests:
                    if column == "i":
                        a, z = _range(op, v, lambda x, right: min(max(math.floor(x) + 1 if right else math.ceil(x), 0), m.rows), m.rows)
                    elif column == "date" and self.ordered:
                        a, z = _range(op, v, m.bisected, m.rows)
                    else:
                        continue
                    low, high = max(low, a), min(high, z)
                out += [Rows(path, a, min(a + self.chunk, high)) for a in range(low, high, self.chunk)]
        return out

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        if partition is None:  # there are no partitions
            return
        path, low, high = partition.value
        compare = {"==": np.equal, ">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}
        with Matrix(path) as m:
            for at in range(low, high, 65_536):
                x = m.read(at, min(at + 65_536, high))[:, : len(BAR_COLUMNS)]
                i = np.arange(at, at + len(x), dtype=np.int32)
                ok = np.ones(len(x), bool)
                for column, op, v in self.tests:
                    own = i if column == "i" else x[:, BAR_COLUMNS.index(column)]
                    # Spark takes NaN for the largest value
                    ok &= compare[op](own, v) | (np.isnan(own) if op in (">", ">=") else False)
                x, i = x[ok], i[ok]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([self._key(path)] * len(x)), pa.array(i), *(pa.array(x[:, c]) for c in range(len(BAR_COLUMNS)))], names=["stk", "i", *BAR_COLUMNS])


def _range(op: str, v: float, place, rows: int) -> tuple[int, int]:
    """Rows for which the comparison may hold; place(v, right): the first row not below v, or beyond it."""
    return (place(v, False) if op in ("==", ">=") else place(v, True) if op == ">" else 0, place(v, True) if op in ("==", "<=") else place(v, False) if op == "<" else rows)


class Matrix:
    """Row ranges of a ``.npy`` file of numbers, in any file system that Arrow opens. Pickled arrays can run code when read, so they are refused."""

    def __init__(self, path: str):
        where, at = opened(path)
        self.file = where.open_input_file(at)

    def __enter__(self):
        from numpy.lib import format as npy

        version = npy.read_magic(self.file)
        (self.rows, self.width), self.columns_first, self.kind = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(self.file)
        if self.kind.hasobject:
            raise ValueError("pickled arrays are not read")
        self.start = self.file.tell()
        return self

    def __exit__(self, *_):
        self.file.close()

    def _at(self, first: int, n: int):
        import numpy as np

        self.file.seek(self.start + first * self.kind.itemsize)
        return np.frombuffer(self.file.read(n * self.kind.itemsize), self.kind).astype(float)

    def read(self, low: int, high: int):
        import numpy as np

        if self.columns_first:
            return np.stack([self._at(c * self.rows + low, high - low) for c in range(self.width)], 1)
        return self._at(low * self.width, (high - low) * self.width).reshape(-1, self.width)

    def bisected(self, v: float, right: bool) -> int:
        """The first row whose date is not below v, or with ``right`` beyond it."""
        low, high = 0, self.rows
        while low < high:
            mid = (low + high) // 2
            date = self._at(mid if self.columns_first else mid * self.width, 1)[0]
            low, high = (mid + 1, high) if date < v or (right and date == v) else (low, mid)
        return low


class NpySource(DataSource):
    """``spark.read.format("npy").load(path)``: a bar matrix per file of a folder, or one file; the file's name is the key. Options: ``rows``, those of a
    partition; ``sorted``, true if dates do not fall. The session needs spark.sql.python.filterPushdown.enabled, which ``read_npy`` sets."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return BAR_SCHEMA

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rows", 1 << 20)), self.options.get("sorted", "false").lower() == "true")


def read_npy(spark: SparkSession, *folders: str) -> DataFrame:
    """Bars of all ``.npy`` files; a key that an earlier folder has is not read from a later one. Absent keys yield no rows."""
    spark.dataSource.register(NpySource)
    # a reader that takes filters is refused where this is off
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = None
    for folder in folders:
        own = spark.read.format("npy").load(folder)
        out = own if out is None else out.unionByName(own.join(out.select("stk").distinct(), "stk", "left_anti"))
    return out


def read_csv(spark: SparkSession, paths: Sequence[str], schema: str, least: int = 100) -> DataFrame | None:
    """The first of several CSV sources that exists and has more than ``least`` rows; None if none has."""
    for path in paths:
        try:
            df = spark.read.schema(schema).csv(path, header=True)
            if df.limit(least + 1).count() > least:
                return df
        except AnalysisException:
            continue
    return None


def read_csv_cached(spark: SparkSession, cache: str, paths: Sequence[str], schema: str, least: int = 100) -> DataFrame | None:
    """The table that ``cache`` holds if it has more than ``least`` rows, else the first source that has, which is then written
    there; None if none has. A source that is too short never gets into the cache."""
    if (held := read_csv(spark, [cache], schema, least)) is not None:
        return held
    if (df := read_csv(spark, paths, schema, least)) is None:
        return None
    df.write.mode("overwrite").csv(cache, header=True)
    return spark.read.schema(schema).csv(cache, header=True)


def flattened(df: DataFrame, levels: int = 2, index: str = "Date") -> DataFrame:
    """A table read without header from a CSV file whose header has several lines (field, ticker, ...) and whose first column is the row's name: the
    columns take the first line's names, repeated ones the first occurrence, and the header's lines are left out of the rows."""
    first = df.columns[0]
    top = df.limit(levels + 1).collect()
    names, keep = [index, *(str(v) for v in top[0][1:])] if top else df.columns, {}
    for old, new in zip(df.columns, names, strict=True):
        keep.setdefault(new, old)
    # a header's lines have no date in the first column; the file's order is not needed
    return df.where(F.try_to_timestamp(F.col(first)).isNotNull()).select(*(F.col(old).alias(new) for new, old in keep.items()))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A wide table of results."""
    return spark.read.schema(schema).csv(path, header=True)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Address cases of a JSON array: id (its position), text, and the true parts."""
    case = "array<struct<address: string, result: struct<province: string, ward: string, street: string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", case).alias("cases"))
    return whole.select(F.posexplode("cases").alias("id", "c")).select("id", F.col("c.address").alias("text"), "c.result.province", "c.result.ward", "c.result.street")


def read_large_cases(spark: SparkSession, path: str) -> DataFrame:
    """``read_cases`` for one large file, read in splits: the same rows with the same ids.

    The file is read in pieces that end at a brace. Whether a piece begins inside a string follows from the quotes before it, and how deep it
    ends from the braces outside strings: both are running totals, kept per split and then over the splits of the file. A record ends
    where the depth falls to that of the array."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"))
    # escaped characters count for nothing; what stands between an even and the next odd quote is outside
    apart = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    opened_ = lambda rest: F.aggregate(F.filter(apart, lambda x, i: i % 2 == rest), F.lit(0), lambda n, x: n + count(x, "{") + count(x, "[") - count(x, "]"))
    own = pieces.withColumns({"quotes": F.size(apart) - 1, "d0": opened_(0), "d1": opened_(1)})
    quoted = _over_splits(own, {"q": "quotes"})
    inside = (F.col("q") - F.col("quotes")) % 2
    closes = F.col("q") % 2 == 0  # the brace that ends the piece is outside
    turns = quoted.withColumn("deep", F.when(inside == 0, F.col("d0")).otherwise(F.col("d1")) - closes.cast("int")).withColumn("closes", closes)
    deep = _over_splits(turns.select("value", "split", "k", "deep", "closes"), {"depth": "deep"})
    ends = (F.col("closes") & (F.col("depth") == 1)).cast("int")
    records = _over_splits(deep.withColumn("ends", ends).select("value", "split", "k", "ends"), {"id": "ends"}).withColumn("id", F.col("id") - F.col("ends"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "k", "value"))), lambda p: p.value), "}"), F.lit("}"))
    whole = records.groupBy("id").agg(text.alias("text"), F.max("ends").alias("ends")).where("ends = 1").select("id", F.regexp_replace("text", r"^[\s\x{FEFF}]*[\[,]", "").alias("text"))
    case = F.from_json("text", "address string, result struct<province: string, ward: string, street: string>")
    return whole.select(F.col("id").cast("int").alias("id"), case.alias("c")).select("id", F.col("c.address").alias("text"), "c.result.province", "c.result.ward", "c.result.street")


def _over_splits(df: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Running sums in the file's order; of a split's rows by themselves, and of the splits, a row for each."""
    upto = Window.partitionBy("split").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy("split").agg(*(F.sum(c).alias(f"_{out}") for out, c in totals.items()))
    before = whole.select("split", *(F.coalesce(F.sum(f"_{out}").over(earlier), F.lit(0)).alias(f"_{out}") for out in totals))
    own = df.withColumns({out: F.sum(c).over(upto) for out, c in totals.items()}).join(before, "split")
    return own.withColumns({out: F.col(out) + F.col(f"_{out}") for out in totals}).drop(*(f"_{out}" for out in totals))


def read_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The non-empty lines of a text file as (kind, name)."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.lit(kind).alias("kind"), F.trim("value").alias("name"))


def numbered(df: DataFrame, order: str, key: str = "stk") -> DataFrame:
    """With ``i``, the position of a row in its key; keys of any length.

    The rows are sorted in ranges of (key, order); each range numbers its part of a key, and what the ranges before it have of that
    key, one row per range and key, is added. Only rows that are equal in both meet in one range however many they are."""
    parts = kept(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))
    runs = parts.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = parts.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1)
    found = own.join(runs.select("_key", "_run", before.alias("_before")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_run")))
    return found.select(*(c for c in df.columns if c != "i"), (F.col("_at") + F.col("_before")).alias("i"))


def prices(bars: DataFrame, price: str = "adj", volume: str = "vol") -> DataFrame:
    """stk, i, p, v: which column is the price is the caller's choice."""
    return bars.select("stk", "i", F.col(price).cast("double").alias("p"), F.col(volume).cast("double").alias("v"))


def date_range(bars: DataFrame, low: int, high: int) -> DataFrame:
    """Rows of low <= date < high; the bounds reach the scan where date is one of its columns."""
    return bars.where((F.col("date") >= low) & (F.col("date") < high))


def long_enough(bars: DataFrame, least: int = 300) -> DataFrame:
    """Only keys with at least ``least`` rows."""
    long = bars.groupBy(F.col("stk").alias("_stk")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return bars.join(long, F.col("stk").eqNullSafe(F.col("_stk")), "left_semi")


def with_ends(bars: DataFrame) -> DataFrame:
    """bars with ``_first`` and ``_last``, the first and the last ``i`` of its key."""
    ends = bars.groupBy(F.col("stk").alias("_stk")).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    return bars.join(ends, F.col("stk").eqNullSafe(F.col("_stk"))).drop("_stk")


def tail(bars: DataFrame, n: int | None) -> DataFrame:
    """The last n rows of each key, numbered anew; all if n is None. ``i`` has no gaps. Features of the result start cold."""
    if n is None:
        return bars
    start = F.greatest(F.col("_last") + 1 - n, F.col("_first"))
    return with_ends(bars).where(F.col("i") >= start).withColumn("i", F.col("i") - start).drop("_first", "_last")


def market(spark: SparkSession, sf_dir: str, walk: float = WALK) -> DataFrame:
    """Bars made from order lines: a key per brand, a row per shipping day; the price is a geometric walk by discounts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_discount", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("stk"))
    step = F.sum(F.round(F.col("l_discount") * 100).cast("int") - 5).alias("dx")
    days = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("stk", F.col("l_shipdate").alias("ts")).agg(step, F.sum("l_quantity").alias("v"), F.count(F.lit(1)).alias("nsh"))
    w = Window.partitionBy("stk").orderBy("ts")
    p = 100 * F.exp(walk * F.sum("dx").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    date = F.date_format("ts", "yyyyMMdd").cast("int")
    return days.select("stk", "ts", date.alias("date"), (F.row_number().over(w) - 1).alias("i"), p.alias("p"), "v", "nsh")


def short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars made from events: a key per user, about as long as the warm-up; the volume is constant."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("stk"), "ts", F.col("value").alias("p"))
    return numbered(e, "ts").select("stk", "ts", "i", "p", F.lit(1.0).alias("v"))


def column_or_none(df: DataFrame, *names: str) -> Column | None:
    """The first of several columns that a table has."""
    return next((F.col(n) for n in names if n in df.columns), None)
