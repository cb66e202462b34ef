"""Functions of one text: Column to Column, built-in expressions but for floats. A null text gives null."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import compiled, quoted, replacement_to_java, to_java

MARK, SET = "\ufffd", "\ue000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def regex_normalize(x: Column | str, pattern: str, replacement: str, everywhere: bool = True) -> Column:
    """Replace each match, or only the first. A pattern that doesn't compile fails."""
    java, with_ = to_java(pattern), replacement_to_java(replacement)
    if everywhere:
        return F.regexp_replace(_col(x), F.lit(java), F.lit(with_))
    # one match of the whole text: what lies before the first match and after it are groups of their own
    groups = compiled(pattern).groups
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: "${}".format(int(m[1]) + 2), with_)
    return F.regexp_replace(_col(x), F.lit(f"(?s)\\A(.*?)((?-s){java})(.*)\\z"), F.lit(f"$1{shifted}${groups + 3}"))


def ascii_case(x: Column | str, lower: bool = True) -> Column:
    """Only A-Z and a-z change."""
    return F.translate(_col(x), UPPER, LOWER) if lower else F.translate(_col(x), LOWER, UPPER)


def valid_utf8(x: Column | str, replace: bool = True) -> Column:
    """Bytes as text: each malformed sequence becomes U+FFFD, or goes. A U+FFFD that was there stays either way."""
    text = _col(x).cast("string")
    if replace:
        return F.make_valid_utf8(text)
    swap = ((SET, SET + "1"), (MARK, SET + "2"))  # what is there already is set aside
    for a, b in swap:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(F.make_valid_utf8(text), F.lit(MARK), F.lit(""))
    for a, b in reversed(swap):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def equal_text(a: Column | str, b: Column | str) -> Column:
    """1 where both are the same bytes, else 0; a null is equal to nothing."""
    return F.coalesce((_col(a) == _col(b)).cast("int"), F.lit(0))


def equal_complex(a: Column, b: Column) -> Column:
    """Structs (re, im) are equal if both parts are."""
    return (a["re"] == b["re"]) & (a["im"] == b["im"])


def number_text(x: Column, kind: str) -> Column:
    """A number as text: integers exactly, floats with six significant digits, booleans as true and false; strings stay."""
    if kind in ("float", "double"):
        from .unicode import float_text

        return float_text(x)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean", "string") or kind.startswith("decimal"):
        return x.cast("string")
    raise TypeError(f"numbers, booleans and strings only, not {kind}")


def byte_token(x: Column | str) -> Column:
    """Bytes of a token: `<0xNN>` is that byte, anything else its UTF-8."""
    t = _col(x)
    return F.when(t.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.unhex(F.substring(t, 4, 2))).otherwise(F.encode(t, "UTF-8"))


def join_text(x: Column | str, separator: str = "") -> Column:
    """The strings of an array, joined; of an empty array the empty string."""
    return F.array_join(_col(x), separator)


def split_text(x: Column | str, delimiter: str, skip_empty: bool = False) -> Column:
    """array<struct<pos long, value string>>: parts between literal delimiters, single bytes for an empty delimiter.

    Empty parts can be left out; positions are those before that."""
    t = _col(x)
    if delimiter:
        parts = F.split(t, f"\\Q{delimiter}\\E", -1) if "\\E" not in delimiter else F.split(t, quoted(delimiter), -1)
    else:
        hexed = F.hex(F.encode(t, "UTF-8"))
        parts = F.transform(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda h: F.decode(F.unhex(h), "ISO-8859-1"))
    out = F.transform(parts, lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias("value")))
    return F.filter(out, lambda s: s["value"] != "") if skip_empty else out


def split_words(x: Column | str, separator: str = "", most: int = -1) -> Column:
    """array<struct<pos long, value string>>: parts between matches of the separator, a pattern; empty parts are left out.

    Without a separator the text is trimmed and split at white space. most: at most so many parts."""
    from .pieces import split_strings

    t = _col(x)
    if not separator:
        t, separator = strip(t), r"[\s\p{Zs}]+"
    return F.transform(split_strings(t, separator, "remove", most=most), lambda v, i: F.struct(i.cast("long").alias("pos"), v.alias("value")))


def stop_words(x: Column | str, words: Sequence[str], case_sensitive: bool = False, action: str = "none") -> Column:
    """Delete whole stop words and the white space after each, then change the case: none, lower (full case folding) or upper (ASCII)."""
    t = _col(x)
    if words:
        either = "|".join(quoted(w) for w in sorted(words, key=len, reverse=True))
        t = F.regexp_replace(t, F.lit(f"(?U){'' if case_sensitive else '(?iu)'}\\b(?:{either})\\b\\s*"), F.lit(""))
    if action == "none":
        return t
    if action == "lower":
        from .unicode import fold_case

        return fold_case(t)
    return ascii_case(t, lower=False)


def matches(x: Column | str, pattern: str, least: int = 1, unit: str = "byte") -> Column:
    """All matches that have at least so many bytes (or chars)."""
    size = F.octet_length if unit == "byte" else F.length
    return F.filter(F.regexp_extract_all(_col(x), F.lit(to_java(pattern)), F.lit(0)), lambda m: size(m) >= least)


# ---------------------------------------------------------------- named normalizations


def strip_accents(x: Column | str) -> Column:
    """Delete combining marks; the text should be decomposed first."""
    return regex_normalize(x, r"\p{Mn}", "")


def prefix_space(x: Column | str, unless: str = r"\s") -> Column:
    """A blank before a text whose first character isn't white space (or isn't `unless`)."""
    return F.when(_col(x).rlike(f"(?Us)^(?!{unless})."), F.concat(F.lit(" "), _col(x))).otherwise(_col(x))


def plain_spaces(x: Column | str) -> Column:
    return regex_normalize(x, r"\s", " ")


def space_han(x: Column | str) -> Column:
    return regex_normalize(x, r"(\p{Han})", " $1 ")


def metaspace(x: Column | str, mark: str = "▁") -> Column:
    return F.replace(_col(x), F.lit(" "), F.lit(mark))


def prepend(x: Column | str, prefix: str, unless_starts: str | None = None) -> Column:
    """The prefix before any text that isn't empty, and that doesn't start with `unless_starts`."""
    t, on = _col(x), _col(x) != ""
    if unless_starts:
        on = on & ~F.startswith(t, F.lit(unless_starts))
    return F.when(on, F.concat(F.lit(prefix), t)).otherwise(t)


def drop_controls(x: Column | str) -> Column:
    """Delete control and format characters, but not tab, line feed and carriage return."""
    return regex_normalize(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]|\p{Cf}", "")


def strip(x: Column | str, left: bool = True, right: bool = True) -> Column:
    sides = [p for p, on in ((r"^\s+", left), (r"\s+\z", right)) if on]
    return regex_normalize(x, "|".join(sides), "") if sides else _col(x)


def tidy_spaces(x: Column | str) -> Column:
    """Delete the blank before `. ? ! ,` and English contractions."""
    return regex_normalize(regex_normalize(x, r" ([.?!,])", "$1"), r" (n't|'m|'s|'ve|'re)", "$1")


def drop_first(x: Column | str, content: str = " ", before: str = "") -> Column:
    """One `content` from the beginning, if the pattern `before` follows."""
    return regex_normalize(x, f"^{quoted(content)}" + (f"(?={before})" if before else ""), "")


def drop_last(x: Column | str, content: str = " ") -> Column:
    return regex_normalize(x, f"{quoted(content)}\\z", "")


def replace_literal(x: Column | str, pairs: Mapping[str, str]) -> Column:
    t = _col(x)
    for a, b in pairs.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t
