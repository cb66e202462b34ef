"""Models over columns: an Arrow function encodes each different piece of a batch once and keeps a bounded memo.

The pieces of a document never leave its row, so no shuffle is needed and a document with a third of all words is no
hot key. The model travels with the plan."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_parts

MEMO = 64 << 20  #: bytes of pieces and ids that a task remembers


class Model(Protocol):
    def encode(self, piece: str) -> list[int]: ...


def _ragged(lengths: np.ndarray, uniq: list[list[int]], codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of ids for rows whose pieces are codes[at[i]:at[i + 1]]."""
    sizes = np.array([len(u) for u in uniq], np.int64)
    flat = np.array([i for u in uniq for i in u], np.int32)
    first = np.cumsum(sizes) - sizes
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(((first[codes] if len(codes) else n) - ends[:-1]).astype(np.int32), n)
    take += np.arange(ends[-1], dtype=np.int32)
    values = pa.array(flat[take] if len(flat) else np.zeros(0, np.int32), pa.int32())
    offsets = pa.array(ends[at], pa.int32(), mask=np.append(lengths < 0, False))
    return pa.ListArray.from_arrays(offsets, values)


def encode_pieces(pieces: Column, model: Model, special: dict[str, int] | None = None, remember: bool = True) -> Column:
    """array<int>: the ids of all pieces of a row in order. A special token has the id that `special` names, if any.

    To Spark the function is nondeterministic: else a filter that it infers from an explode of the ids would run it twice."""
    special = special or {}

    def some(x: pa.Array) -> pa.Array:
        memo, room = each_memo, each_room
        lengths = np.array([-1 if n is None else n for n in x.value_lengths().to_pylist()], np.int64)
        flat = x.flatten()
        skip = flat.field("skip").to_numpy(zero_copy_only=False).astype(bool)
        coded = flat.field("piece").dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if skip.any():  # a text may be a special token here and a plain piece there
            both, codes = np.unique(codes * 2 + skip, return_inverse=True)
            keys = [(names[k >> 1], bool(k & 1)) for k in both.tolist()]
        else:
            keys = [(name, False) for name in names]
        uniq = []
        for piece, whole in keys:
            if whole and piece in special:
                uniq.append([special[piece]])
                continue
            if (ids := memo.get(piece)) is None:
                ids = model.encode(piece)
                if remember and room[0] > 0:
                    memo[piece] = ids
                    room[0] -= len(piece) + 8 * len(ids) + 200
            uniq.append(ids)
        at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
        return _ragged(lengths, uniq, codes, at)

    @F.arrow_udf("array<int>")
    def each(x: pa.Array) -> pa.Array:
        return by_parts(x, some, 4 << 20)  # larger parts, as words come again

    each_memo: dict[str, list[int]] = {}
    each_room = [MEMO]
    return each.asNondeterministic()(pieces)


def encode_texts(x: Column, model: Model) -> Column:
    """The ids of a whole text as one piece; texts aren't remembered."""
    return encode_pieces(F.when(x.isNotNull(), F.array(F.struct(x.alias("piece"), F.lit(False).alias("skip")))), model, remember=False)


def flat_ids(df: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, pos, token_id)"""
    return df.select(key, F.posexplode(ids).alias("pos", "token_id")).withColumn("pos", F.col("pos").cast("long"))


def decode_bytes(ids: Column, tokens: list[bytes], skip=(), errors: str = "replace") -> Column:
    """The text of token ids: their bytes joined and read as UTF-8; broken sequences are replaced, ignored or fail (strict)."""
    gone = frozenset(skip)

    def some(x: pa.Array) -> pa.Array:
        n = len(tokens)
        return pa.array([None if row is None else b"".join(tokens[i] for i in row if i is not None and 0 <= i < n and i not in gone).decode("utf-8", errors) for row in x.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def each(x: pa.Array) -> pa.Array:
        return by_parts(x, some)

    return each(ids)
