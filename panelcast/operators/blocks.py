"""Keys of any length.

A plain window needs a whole key in one task. Here the rows of a key, which have a dense position, fall into blocks:

* ``in_blocks`` runs windows of bounded reach in each block alone; the rows before it that the windows reach, the halo, are given
  to the block too and dropped from its result;
* ``running`` adds up from the first row: each block is summed by itself, the block totals (one row per block) are summed per key,
  and each row adds what the blocks before its own have.

No task holds more than a block of rows, its halo, and one row per block of a key. A key of less than a block is one block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block of running totals.
BLOCK = 4096
#: Rows in a block of windows; a multiple of the refit intervals in use.
ROWS = 65_520


def _later(own: Column, before: Column) -> Column:
    return own + F.coalesce(before, own - own)


_SUM = (F.sum, lambda c, pos: F.sum(c), F.sum, lambda own, before: F.when(own.isNull(), before).otherwise(_later(own, before)))
_MAX = (F.max, lambda c, pos: F.max(c), F.max, lambda own, before: F.greatest(own, before))
_FIRST = (lambda c: F.first(c, True), lambda c, pos: F.min_by(c, F.when(c.isNotNull(), pos)), lambda c: F.first(c, True), lambda own, before: F.coalesce(before, own))
#: Over the rows of a block, of a whole block, over blocks, and both together.
_WAYS = {"sum": _SUM, "max": _MAX, "first": _FIRST}


def running(df: DataFrame, keys: list[str], pos: str, totals: dict[str, tuple[str, str]], block: int = BLOCK) -> DataFrame:
    """df with further columns: ``totals`` names each as (way, column), way being sum, max or first (the first value that is not null), over the rows of equal ``keys`` up to ``pos``.

    ``df`` is read twice: store it first where it is costly. Keys are never null; rows of equal key and position come in any order."""
    at = [*keys, "_block"]
    rows = df.withColumn("_block", F.floor(F.col(pos) / block))
    upto = Window.partitionBy(*at).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*at).agg(*(_WAYS[way][1](F.col(c), F.col(pos)).alias(f"_t_{out}") for out, (way, c) in totals.items()))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_block")) > 1
    before = whole.select(*at, nth.alias("_nth"), *(_WAYS[way][2](f"_t_{out}").over(earlier).alias(f"_b_{out}") for out, (way, _) in totals.items()))
    own = rows.withColumns({out: _WAYS[way][0](c).over(upto) for out, (way, c) in totals.items()})
    found = own.join(before, at, "left")
    return found.select(*df.columns, *(F.when(F.col("_nth"), _WAYS[way][3](F.col(out), F.col(f"_b_{out}"))).otherwise(F.col(out)).alias(out) for out, (way, _) in totals.items()))


def number(pos: Column, block: int, offset: int = 0) -> Column:
    """The block of a position: ``offset`` + ``block`` positions in the first, ``block`` in each further one."""
    return F.greatest(F.floor((pos - offset) / block), F.lit(0)).cast("long")


def spread(df: DataFrame, pos: str, before: int, after: int = 0, block: int = ROWS, offset: int = 0) -> DataFrame:
    """df with ``_b``: each row in its own block and in those whose halo it is in, ``before`` rows ahead of a block and ``after`` behind it."""
    at = F.col(pos)
    return df.withColumn("_b", F.explode(F.sequence(number(at - after, block, offset), number(at + before, block, offset))))


def own_rows(df: DataFrame, pos: str, block: int = ROWS, offset: int = 0) -> DataFrame:
    """What ``spread`` made, without halos."""
    return df.where(number(F.col(pos), block, offset) == F.col("_b")).drop("_b")


def in_blocks(df: DataFrame, f: Callable[[DataFrame, list[str]], DataFrame], keys: list[str], pos: str, before: int, after: int = 0, block: int = ROWS) -> DataFrame:
    """f(rows, keys) applied to each block of each key; the keys that f gets include the block, and its result has them and ``pos``."""
    return own_rows(f(spread(df, pos, before, after, block), [*keys, "_b"]), pos, block)
