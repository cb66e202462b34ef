"""Detokenizing a stream of token ids.

Without state each row is decoded for itself and its bytes are passed on, so a character may be cut between rows. With
state the bytes of an unfinished character wait for the next row of the same stream."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.batches import by_parts


def token_bytes(ids: Column, tokens: list[bytes]) -> Column:
    """The bytes of an array of ids; unknown ids have none."""

    def some(x: pa.Array) -> pa.Array:
        n = len(tokens)
        return pa.array([None if row is None else b"".join(tokens[i] for i in row if 0 <= i < n) for row in x.to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def each(x: pa.Array) -> pa.Array:
        return by_parts(x, some)

    return each(ids)


def decode_stream(df: DataFrame, stream: str, order: str, token_id: str, tokens: list[bytes]) -> DataFrame:
    """(stream, order, text) of a streaming DataFrame with a token id or an array of them a row; rows of a micro-batch go by `order`.

    The state of a stream is at most three bytes; it ends with the query. Broken bytes become U+FFFD."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        if state.exists:
            decoder.setstate((state.get[0], 0))
        some = list(rows)
        every = some[0] if len(some) == 1 else pd.concat(some)
        by, ids = every[order].to_numpy(), every[token_id].tolist()
        turn, n = by.argsort(kind="stable").tolist(), len(tokens)
        parts = ([tokens[i] for i in ids[k] if 0 <= i < n] if several else [tokens[ids[k]]] if 0 <= ids[k] < n else [] for k in turn)
        text = [decoder.decode(b"".join(p)) for p in parts]
        state.update((decoder.getstate()[0],))
        yield pd.DataFrame({stream: [key[0]] * len(turn), order: by[turn], "text": text})

    kinds = dict(df.dtypes)
    several = kinds[token_id].startswith("array")
    return df.groupBy(stream).applyInPandasWithState(step, f"{stream} {kinds[stream]}, {order} {kinds[order]}, text string", "tail binary", "append", "NoTimeout")
