"""Mixing sources to target weights, with DataFrame operations only. Documents are never shuffled by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, n) with the target of each source.

    Sources by code point, null last, get the weights in turn. They share `share` times all sizes; a target stops at
    `limit` times its source's size, and what it can't take is shared again by weight until none is above. That is
    water filling: sorted by size / weight, the sources below the common level are full and the rest lie on it."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    x = sources.withColumn("weight", w).withColumn("full", F.col("source_size") * F.lit(float(limit)))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    all_ = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    x = x.withColumn("level", (all_ - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source that isn't full sets the level of all after it
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("rank", "level"))).over(Window.partitionBy())
    x = x.withColumn("rank", F.row_number().over(order)).withColumn("first", fits)
    target = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first.rank")), F.col("full")).otherwise(F.col("first.level") * F.col("weight"))
    return x.select("source", "source_size", "n", target.alias("target"))


SMALL = 32 << 20  #: bytes of sources up to which every task gets them all
SHARE = 1000  #: a source with more than one in so many documents is large; so there are fewer large ones than this


def mix(docs: DataFrame, seed: int = 42, small: int = SMALL, **how) -> DataFrame:
    """(row, size, source_size, target, copies): row is the document's whole row as a struct.

    Each source's tokens are summed; its rate is target / size. A document is taken floor(rate) times, and once more
    if a uniform number from a hash of the seed, its id and its text lies below the rate's fraction; so reruns agree,
    and equal rows fare alike. Null texts have size 0, a null source is a source; an empty table gives no rows.

    The sources' sums are written once and measured. Up to `small` bytes go to every task and documents don't move.
    More of them are joined by source, but for the large ones, whose documents stay where they are all the same."""
    sized = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("size"), F.col("source").alias("_source"))
    sums = docs.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = kept(sums)
    few = targets(sums, **how).withColumnRenamed("source", "_of")
    bytes_, rows = sums.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 40), F.sum("n")).first()
    same = F.col("_source").eqNullSafe(F.col("_of"))
    if (bytes_ or 0) <= small:
        x = sized.join(F.broadcast(few), same)
    else:
        large = F.col("n") * SHARE > rows
        top = F.broadcast(few.where(large))
        x = sized.join(top, same).unionByName(sized.join(top.select("_of"), same, "left_anti").join(few.where(~large), same))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.floor(rate) + (u < rate - F.floor(rate)).cast("long")
    return x.select("row", "size", "source_size", "target", copies.alias("copies"))
