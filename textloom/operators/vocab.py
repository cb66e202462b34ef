"""Vocabularies are DataFrames (token, id[, score]); look-ups are left joins. Spark picks the join by the vocabulary's size."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_counts(words: DataFrame, token: str = "token", size: int | None = None, first_id: int = 0, count: str | None = None) -> DataFrame:
    """(token, id, n): the most frequent tokens, ties in the tokens' order; size: how many; count: how often a row counts.

    With a size, the few tokens left are numbered in one task. Without one, tokens that occur equally often are numbered
    together, after the number of all more frequent ones; only tokens that occur once may be many, so they are numbered
    by ranges of themselves."""
    counts = words.groupBy(token).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))
    if size is not None:
        counts = counts.orderBy(F.desc("n"), token).limit(size)
        return counts.select(token, (F.row_number().over(Window.orderBy(F.desc("n"), token)) - 1 + first_id).cast("int").alias("id"), "n")
    group = [F.col("n"), F.substring(token, 1, 2).alias("_start")]
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))  # one row for each count and two characters
    before = F.coalesce(F.sum("_size").over(Window.orderBy(F.desc("n"), "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("n", "_start", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("n", "_start").orderBy(token)) - 1
    x = counts.withColumn("_start", F.substring(token, 1, 2)).join(sizes, ["n", "_start"])
    return x.select(token, (F.col("_before") + place + first_id).cast("int").alias("id"), "n")


def from_list(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def as_list(pairs: dict[str, int]) -> list[str]:
    """Tokens by id; gaps are empty, of tokens that share an id the last counts."""
    out = [""] * (max(pairs.values(), default=-1) + 1)
    for t, i in pairs.items():
        out[i] = t
    return out


def encode(df: DataFrame, token: str, vocab: DataFrame, default: int = -1, name: str = "token_id") -> DataFrame:
    """The id of each row's token; of equal keys in the vocabulary the first (least id) counts, an unknown token has the default."""
    v = vocab.groupBy(F.col("token").alias("_token")).agg(F.min("id").alias("_id"))
    return df.join(v, df[token] == v["_token"], "left").withColumn(name, F.coalesce("_id", F.lit(default))).drop("_token", "_id")


def lookup(df: DataFrame, key: str, table: DataFrame, default, name: str = "found") -> DataFrame:
    """The value of the key in table (key, value, at); of equal keys the one with the greatest `at` counts."""
    t = table.groupBy(F.col("key").alias("_key")).agg(F.max_by("value", "at").alias("_value"))
    return df.join(t, df[key] == t["_key"], "left").withColumn(name, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def _by_row(df: DataFrame, key: str, ids: str, table: DataFrame, default: str, name: str) -> DataFrame:
    """(key, name): for each row the token that table (_of, _token) has for each of its ids, in order.

    Rows are told apart by a number of their own, not by their key. A null array stays null."""
    flat = df.select(F.monotonically_increasing_id().alias("_row"), key, ids).select("_row", key, F.col(ids).isNull().alias("_none"), F.posexplode_outer(ids).alias("_pos", "_id"))
    flat = flat.join(table, flat["_id"] == table["_of"], "left").select("_row", key, "_none", F.struct("_pos", F.coalesce("_token", F.lit(default)).alias("_token")).alias("_t"))
    got = flat.groupBy("_row").agg(F.first(key).alias(key), F.first("_none").alias("_none"), F.array_sort(F.collect_list("_t")).alias("_t"))
    return got.select(key, F.when(~F.col("_none"), F.transform("_t", lambda s: s["_token"])).alias(name), F.get("_t", 0)["_pos"].isNull().alias("_empty"))


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame, skip: Sequence[int] = (), name: str = "tokens") -> DataFrame:
    """(key, tokens): the token of each id in order, a row for each row of df, also where rows share a key.

    Negative, unknown and skipped ids are empty strings; an empty array is one empty string, a null array null."""
    x = df.select(key, F.transform(ids, lambda i: F.when(~i.isin(list(skip)), i)).alias(ids)) if skip else df
    v = vocab.groupBy(F.col("id").alias("_of")).agg(F.max("token").alias("_token"))
    return _by_row(x, key, ids, v, "", name).drop("_empty")


def decode_small(ids: Column, tokens: Sequence[str], skip: Sequence[int] = ()) -> Column:
    """The same as an expression, for vocabularies of about a hundred tokens."""
    table = F.array(*[F.lit("" if i in set(skip) else t) for i, t in enumerate(tokens)])
    got = F.transform(ids, lambda i: F.when((i >= 0) & (i < len(tokens)), F.get(table, i)).otherwise(F.lit("")))
    return F.when(F.size(ids) == 0, F.array(F.lit(""))).otherwise(got)


def id_to_text(df: DataFrame, ids: str, mapping: str, unk: str, key: str, name: str = "text") -> DataFrame:
    """(key, texts) by a mapping of lines `token<tab>id`, a row for each row of df; an empty array stays empty, a null one null.

    Malformed lines don't count; of lines that share an id the last does; ids without a token are `unk`."""
    pairs: dict[int, str] = {}
    for line in mapping.split("\n"):
        token, tab, number = line.partition("\t")
        if tab and (m := re.match(r"\s*[+-]?\d+", number)) and int(m[0]) >= 0:
            pairs[int(m[0])] = token
    table = df.sparkSession.createDataFrame(list(pairs.items()), "_of long, _token string")
    got = _by_row(df, key, ids, table, unk, name)
    return got.select(key, F.when(F.col("_empty") & F.col(name).isNotNull(), F.array().cast("array<string>")).otherwise(F.col(name)).alias(name))


def label_encode(df: DataFrame, column: str, keys: Sequence[str], values: Sequence[int] | None = None, default: int = -1, name: str = "label") -> DataFrame:
    values = range(len(keys)) if values is None else values
    first = dict(zip(reversed(keys), reversed(list(values)), strict=True))
    if len(first) <= 100:
        expr = F.lit(None).cast("long")
        pairs = [x for k, v in first.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))]
        expr = F.element_at(F.create_map(*pairs), F.col(column)) if pairs else expr
        return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else expr, F.lit(default).cast("long")))
    table = df.sparkSession.createDataFrame(list(first.items()), "token string, id long")
    return encode(df, column, table, default, name)


def term_counts(words: DataFrame, key: str, token: str, vocab: DataFrame, count: str | None = None) -> DataFrame:
    """(key, id, n): how often each document has each term of the vocabulary; zeros are left out.

    count: a column of words that has the counts already, a row for each key and token; no two tokens may share an id then."""
    v = vocab.select(F.col("token").alias("_token"), "id")
    if count:
        return words.join(v, words[token] == v["_token"]).select(key, "id", F.col(count).alias("n"))
    return words.join(v, words[token] == v["_token"]).groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))


def term_vector(df: DataFrame, key: str, counts: DataFrame, size: int, name: str = "vector") -> DataFrame:
    """(key, vector): the counts of every key of df as a dense array of `size` floats."""
    maps = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", F.col("n").cast("float").alias("n")))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0).cast("float")))
    return df.select(key).join(maps, key, "left").select(key, dense.alias(name))
