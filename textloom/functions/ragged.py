"""Functions of arrays: truncation, segments, padding, sparse and dense forms. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES, PAIR_MODES = ("left", "right"), ("only_first", "only_second", "longest_first")


def _take(ids: Column, n: Column, side: str) -> Column:
    """The first n, or with side 'left' the last n: the side is the one that is cut."""
    if side not in SIDES:
        raise ValueError("side is left or right")
    n = F.least(F.greatest(n, F.lit(0)), F.size(ids))
    return F.slice(ids, F.lit(1), n) if side == "right" else F.slice(ids, F.size(ids) - n + 1, n)


def truncate(ids: Column, most: int | Column, side: str = "right") -> Column:
    return _take(ids, F.lit(most) if isinstance(most, int) else most, side)


def truncate_pair(a: Column, b: Column, most: int | Column, side: str = "right", mode: str = "longest_first") -> tuple[Column, Column]:
    """Cut a pair that is longer than `most` in total.

    only_first and only_second cut that one to `most`. longest_first keeps a side that fits half the room whole and gives
    the other the rest; if neither does, each gets half, and an odd unit goes to the longer (of equals the first)."""
    if mode not in PAIR_MODES:
        raise ValueError(f"mode is one of {', '.join(PAIR_MODES)}")
    n = F.lit(most) if isinstance(most, int) else most
    la, lb = F.size(a), F.size(b)
    over = la + lb > n
    if mode == "only_first":
        na, nb = n, lb
    elif mode == "only_second":
        na, nb = la, n
    else:
        half = F.floor(n / 2).cast("int")
        odd = n - 2 * half
        first = (la >= half + odd) & (lb <= half)
        second = (la < half + odd) & (lb > half)
        na = F.when(first, n - lb).when(second, la).otherwise(half + F.when(la >= lb, odd).otherwise(0))
        nb = F.when(first, lb).when(second, n - la).otherwise(half + F.when(la >= lb, 0).otherwise(odd))
    return _take(a, F.when(over, na).otherwise(la), side), _take(b, F.when(over, nb).otherwise(lb), side)


def combine(segments: Sequence[Column | Sequence[int]], numbers: Sequence[int]) -> tuple[Column, Column]:
    """The segments one after another, and for each item its segment's number. A plain list is the same for every row."""
    cols = [s if isinstance(s, Column) else F.array(*map(F.lit, s)).cast("array<int>") for s in segments]
    return F.concat(*cols), F.concat(*[F.array_repeat(F.lit(n), F.size(c)) for c, n in zip(cols, numbers, strict=True)])


def pad(x: Column, width: int | Column, value, side: str = "right") -> Column:
    """Exactly `width` items: longer arrays lose their tail, shorter ones get `value` at the side."""
    w = F.lit(width) if isinstance(width, int) else width
    kept = F.slice(x, F.lit(1), F.least(w, F.size(x)))
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(w - F.size(x), F.lit(0)))
    return F.concat(kept, fill) if side == "right" else F.concat(fill, kept)


def mask(x: Column, width: int | Column, side: str = "right") -> Column:
    """1 for an item, 0 for padding."""
    return pad(F.transform(x, lambda _: F.lit(1)), width, 0, side)


def longest(df: DataFrame, ids: str, batch: str | None = None, least: int = 0, name: str = "width") -> DataFrame:
    """With the batch's greatest length (at least `least`) in a column; a batch is a value of a column, or all rows."""
    widths = df.groupBy(*([batch] if batch else [])).agg(F.greatest(F.coalesce(F.max(F.size(ids)), F.lit(0)), F.lit(least)).alias(name))
    if batch is None:
        return df.crossJoin(F.broadcast(widths))  # one row
    return df.join(widths, df[batch].eqNullSafe(widths[batch])).drop(widths[batch])


def to_sparse(df: DataFrame, key: str, x: str, name: str = "value") -> DataFrame:
    """(key, pos, value): one row for each item."""
    return df.select(key, F.posexplode(x).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


def dense_shape(df: DataFrame, x: str) -> DataFrame:
    """(rows, cols): the number of arrays and the greatest length."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size(x)), F.lit(0)).cast("long").alias("cols"))


def from_sparse(df: DataFrame, key: str, pos: str, value: str, name: str = "values") -> DataFrame:
    """(key, values): the items of each key in the order of their positions."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias(name))


def row_offsets(df: DataFrame, key: str, size: Column, each: int = 1_000_000) -> DataFrame:
    """(key, begin, end): where each row lies if the rows are stored one after another in the order of `key` (a number).

    Rows that share a key follow each other, the shorter first; rows with a null key come last, and a null size is 0.
    A running sum over all rows is one task's work, so keys are cut into ranges, about one for `each` rows: sums of
    ranges, a running sum over those, and running sums within each."""
    x = df.select(F.col(key), F.coalesce(size.cast("long"), F.lit(0)).alias("_n"))
    ends = x.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), (F.count(F.lit(1)) / each + 64).cast("long").alias("parts"))
    part = F.floor((F.col(key) - F.col("lo")) * F.col("parts") / (F.col("hi") - F.col("lo") + 1)).cast("long")
    x = x.crossJoin(F.broadcast(ends)).select(key, "_n", F.coalesce(part, F.col("parts")).alias("_part"))  # one row
    sums = x.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last(), "_n").rowsBetween(Window.unboundedPreceding, 0))
    x = x.join(before, "_part").withColumn("end", F.col("_before") + run)
    return x.select(key, (F.col("end") - F.col("_n")).alias("begin"), "end")


def from_row_ids(spark, ids: DataFrame, row_id: str, rows: int | None = None) -> DataFrame:
    """(row_id, begin, end) of rows 0 to rows - 1 from row ids of values; rows without values are empty.

    Without `rows` there are as many as the greatest id asks for. Ids beyond the last row don't count; a negative id fails."""
    if rows is None:
        rows = int(ids.agg(F.coalesce(F.max(row_id), F.lit(-1))).first()[0]) + 1
    checked = ids.select(F.when(F.col(row_id) < 0, F.raise_error(F.lit("negative row id")).cast("long")).otherwise(F.col(row_id)).alias(row_id))
    counts = checked.where(F.col(row_id) < rows).groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(rows).withColumnRenamed("id", row_id)
    return row_offsets(every.join(counts, row_id, "left").select(row_id, F.coalesce("n", F.lit(0)).alias("n")), row_id, F.col("n"))


def to_tensor(x: Column, width: int | Column, value, inner: int | Column | None = None) -> Column:
    """Padded or cropped to the width; with `inner`, arrays of arrays are so on both axes."""
    if inner is None:
        return pad(x, width, value)
    kind = F.transform(x, lambda r: pad(r, inner, value))
    return pad(kind, width, F.array_repeat(value if isinstance(value, Column) else F.lit(value), inner if isinstance(inner, int) else inner))


def add_prefix(ids: Column, prefix: Sequence[int]) -> Column:
    return F.concat(F.array(*map(F.lit, prefix)).cast("array<int>"), ids) if prefix else ids


def greedy(scores: Column) -> Column:
    """The first place of the greatest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")
