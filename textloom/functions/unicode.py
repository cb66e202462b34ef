"""Functions that Catalyst lacks, as Arrow functions over whole batches: Unicode forms, case folding, byte alphabets, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.batches import by_parts
from ..operators.hashing import fingerprint64


def _texts(f: Callable[[str], str]) -> Callable[[Column], Column]:
    def some(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in x.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def each(x: pa.Array) -> pa.Array:
        return by_parts(x, some)

    return each


def normalize_unicode(x: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD of the Unicode standard."""
    form = form.upper()
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no such form: {form}")
    return _texts(lambda t: t if t.isascii() else unicodedata.normalize(form, t))(x)


def fold_case(x: Column) -> Column:
    """Full Unicode case folding."""
    return _texts(str.casefold)(x)


# What the nmt rules delete, what they make a blank, and the one character that they keep from its form.
NMT_DROP = [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F]
NMT_BLANK = [0x09, 0x0A, 0x0C, 0x0D, 0x061C, 0x1680, 0x200B, 0x200C, 0x200E, 0x200F, 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD]
NMT_KEPT = "\uff5e"


def charsmap(x: Column, table: dict[str, str] | None = None, form: str | None = None, fold: bool = False, dummy_prefix: bool = False, squeeze: bool = True, escape: bool = False, nmt: bool = False) -> Column:
    """Prefix replacement by the longest key of `table`, then a Unicode form and case folding; white space is squeezed and
    trimmed (squeeze), the text gets a blank in front (dummy_prefix), and blanks become `▁` (escape). nmt: before the
    form, control characters go, and marks and separators become blanks."""
    swap = dict.fromkeys(NMT_DROP) | dict.fromkeys(NMT_BLANK, " ")
    longest = max(map(len, table or {"": ""}))

    def f(t: str) -> str:
        if table:
            out, i = [], 0
            while i < len(t):
                for n in range(min(longest, len(t) - i), 0, -1):
                    if (got := table.get(t[i : i + n])) is not None:
                        out.append(got)
                        i += n
                        break
                else:
                    out.append(t[i])
                    i += 1
            t = "".join(out)
        if nmt:
            t = t.translate(swap)
        if form and form.lower() not in ("", "identity"):
            parts = t.split(NMT_KEPT) if nmt else [t]
            t = NMT_KEPT.join(unicodedata.normalize(form.upper(), p) for p in parts)
        if fold:
            t = t.casefold()
        if squeeze:
            t = " ".join(p for p in t.split(" ") if p)
        if dummy_prefix and t:
            t = " " + t
        return t.replace(" ", "▁") if escape else t

    return _texts(f)(x)


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_ALPHABET = byte_alphabet()
_LETTERS = {i: c for i, c in enumerate(_ALPHABET)}
_BYTES = {c: i for i, c in enumerate(_ALPHABET)}


def bytes_to_chars_text(t: str) -> str:
    return t.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LETTERS)


def chars_to_bytes_text(t: str) -> bytes:
    """Characters outside the alphabet stand for their own UTF-8."""
    return b"".join(bytes([_BYTES[c]]) if c in _BYTES else c.encode() for c in t)


def bytes_to_chars(x: Column) -> Column:
    """Each UTF-8 byte as a printable character."""
    return _texts(bytes_to_chars_text)(x)


def chars_to_bytes(x: Column) -> Column:
    """The inverse, as binary."""

    def some(t: pa.Array) -> pa.Array:
        return pa.array([None if v is None else chars_to_bytes_text(v) for v in t.to_pylist()], pa.binary())

    @F.arrow_udf("binary")
    def each(t: pa.Array) -> pa.Array:
        return by_parts(t, some)

    return each(x)


def float_text(x: Column) -> Column:
    """Six significant digits as C prints them; Java rounds the shortest decimal form instead of the value."""

    @F.arrow_udf("string")
    def each(v: pa.Array) -> pa.Array:
        return pa.array([None if n is None else "%g" % n for n in v.to_pylist()], pa.string())

    return each(x)


def hash_bucket(x: Column, buckets: int) -> Column:
    """The 64-bit fingerprint of the text's UTF-8 modulo the number of buckets, unsigned. Equal in every process and release."""
    if buckets <= 0:
        raise ValueError("at least one bucket")

    @F.arrow_udf("bigint")
    def each(t: pa.Array) -> pa.Array:
        coded = t.dictionary_encode()
        got = [None if v is None else fingerprint64(v.encode()) % buckets for v in coded.dictionary.to_pylist()]
        return pa.array(got, pa.int64()).take(coded.indices)

    return each(x)


def each_piece_text(pieces: Column, f: Callable[[str], str]) -> Column:
    """f on the text of every piece that isn't a special token."""

    def some(x: pa.Array) -> pa.Array:
        flat = x.flatten()
        text = [t if k or t is None else f(t) for t, k in zip(flat.field("piece").to_pylist(), flat.field("skip").to_pylist(), strict=True)]
        values = pa.StructArray.from_arrays([pa.array(text, pa.string()), flat.field("skip")], ["piece", "skip"])
        ends, at = [], 0
        for n in x.value_lengths().to_pylist():
            ends.append(None if n is None else at)
            at += n or 0
        return pa.ListArray.from_arrays(pa.array([*ends, at], pa.int32()), values)

    @F.arrow_udf("array<struct<piece:string,skip:boolean>>")
    def each(x: pa.Array) -> pa.Array:
        return by_parts(x, some)

    return each(pieces)
