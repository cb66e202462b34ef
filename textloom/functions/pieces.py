"""Splitting texts into pieces. A *pieces* column is array<struct<piece string, skip boolean>>: later steps leave a piece
alone whose skip is true, since it is a special token already. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dialect import can_be_empty, quoted, to_java

MODES = ("remove", "isolate", "contiguous", "mergedwithprevious", "mergedwithnext")
# The split patterns that tokenizer definitions name.
PUNCTUATION = r"[!-/:-@\[-`{-~]|\p{P}"
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL_DIGITS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITESPACE = r"\w+|[^\w\s]+"
NUMBER = r"\p{N}"


def as_pieces(x: Column | str) -> Column:
    """The whole text as one piece; null stays null."""
    t = F.col(x) if isinstance(x, str) else x
    return F.when(t.isNotNull(), F.array(F.struct(t.alias("piece"), F.lit(False).alias("skip"))))


def values(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: p["piece"])


def fuse(pieces: Column) -> Column:
    """The pieces of a row as one text again."""
    return F.array_join(values(pieces), "")


def each_piece(pieces: Column, f: Callable[[Column], Column]) -> Column:
    """f on every piece that isn't a special token."""
    return F.transform(pieces, lambda p: F.struct(F.when(p["skip"], p["piece"]).otherwise(f(p["piece"])).alias("piece"), p["skip"].alias("skip")))


def split_strings(x: Column, pattern: str, mode: str = "isolate", invert: bool = False, most: int = -1) -> Column:
    """array<string>: the text cut at the matches of the pattern.

    remove: the gaps (inverted: the matches). isolate: both. contiguous: as isolate, with neighbouring matches as one.
    mergedwithprevious: each match ends a piece. mergedwithnext: each match begins one. Inverted, the last two take gaps
    for matches. Pieces are never empty; an empty text is one empty piece. most: at most so many pieces, the last goes on
    to the end of the text."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if most != -1 and most < 1:
        raise ValueError("most is -1 or at least 1")
    if can_be_empty(pattern):
        raise ValueError(f"the pattern matches the empty text: {pattern}")
    p = f"(?:{to_java(pattern)})"
    # possessive repeats: without them Java would recurse for every character
    gap = f"(?:(?!{p})(?s:.))++"
    if mode == "contiguous":
        p = f"{p}++"
    found = {
        ("remove", True): p, ("isolate", False): f"{p}|{gap}", ("mergedwithprevious", False): f"(?:{gap})?+{p}|{gap}", ("mergedwithnext", False): f"{p}(?:{gap})?+|{gap}",
        ("mergedwithprevious", True): f"{p}*+{gap}|{p}++", ("mergedwithnext", True): f"{gap}{p}*+|{p}++",
    }
    if mode == "remove" and not invert:
        # Java's own split goes from match to match; a gap found by itself could begin within a match
        got = F.filter(F.split(x, p, -1), lambda s: s != "")
        before = f"\\A{p}*+(?:{gap}{p}++){{{most - 1}}}+"
    else:
        got = F.regexp_extract_all(x, F.lit(found["isolate" if mode == "contiguous" else mode, invert and mode not in ("isolate", "contiguous")]), F.lit(0))
        before = f"\\A(?:(?:{gap})?+{p}){{{most - 1}}}+(?:{gap})?+"
    if most > 0:
        if mode == "remove":  # what lies between the pieces is gone, so the last one is cut from the text
            last = F.regexp_replace(x, F.lit(before), F.lit(""))
        else:
            last = F.array_join(F.slice(got, F.lit(most), F.greatest(F.size(got), F.lit(1))), "")
        got = F.when(F.size(got) >= most, F.concat(F.slice(got, 1, most - 1), F.array(last))).otherwise(got)
    return F.when(x == "", F.array(F.lit(""))).otherwise(got)


def regex_split(pieces: Column, pattern: str, mode: str = "isolate", invert: bool = False, most: int = -1) -> Column:
    """Split every piece that isn't a special token."""
    plain = lambda p: F.transform(split_strings(p["piece"], pattern, mode, invert, most), lambda s: F.struct(s.alias("piece"), F.lit(False).alias("skip")))
    return F.flatten(F.transform(pieces, lambda p: F.when(p["skip"], F.array(p)).otherwise(plain(p))))


@dataclass(frozen=True)
class SpecialToken:
    text: str
    strip_left: bool = False
    strip_right: bool = False
    at_edge: bool = False  #: only where a word begins or ends with it


def special_pattern(tokens: Iterable[SpecialToken]) -> str:
    """One alternation; longer tokens of a kind come first, stripped white space is outside the token."""
    kinds: dict[tuple[bool, bool, bool], list[str]] = {}
    for t in sorted(tokens, key=lambda t: t.text, reverse=True):
        kinds.setdefault((t.strip_left, t.strip_right, t.at_edge), []).append(t.text)
    parts = []
    for (left, right, edge), texts in kinds.items():
        either = "|".join(rf"\b{quoted(t)}|{quoted(t)}\b" if edge else quoted(t) for t in texts)
        parts.append((r"\s*" if left else "") + f"(?:{either})" + (r"\s*" if right else ""))
    return "|".join(parts)


def special_split(pieces: Column, tokens: Iterable[SpecialToken]) -> Column:
    """Cut out special tokens, which become pieces with skip; white space that a token strips goes with it."""
    tokens = list(tokens)
    if not tokens:
        return pieces
    pattern = special_pattern(tokens)
    bare = "|".join(quoted(t.text) for t in sorted(tokens, key=lambda t: t.text, reverse=True))
    whole, java = f"^(?:{to_java(pattern)})\\z", to_java(bare)

    def cut(p: Column) -> Column:
        return F.transform(split_strings(p["piece"], pattern), lambda s: F.struct(F.when(s.rlike(whole), F.regexp_extract(s, java, 0)).otherwise(s).alias("piece"), s.rlike(whole).alias("skip")))

    return F.flatten(F.transform(pieces, lambda p: F.when(p["skip"], F.array(p)).otherwise(cut(p))))


# ---------------------------------------------------------------- named splits


def split_chars(pieces: Column) -> Column:
    return regex_split(pieces, ".", "isolate")


def bert_split(pieces: Column) -> Column:
    return regex_split(regex_split(pieces, r"\s+", "remove"), f"{PUNCTUATION}|{CJK}", "isolate")


def whitespace_split(pieces: Column) -> Column:
    return regex_split(pieces, WHITESPACE, "remove", invert=True)


def metaspace_split(pieces: Column, mark: str = "▁") -> Column:
    return regex_split(pieces, quoted(mark), "mergedwithnext")


def prepend_first(pieces: Column, prefix: str, unless_starts: str) -> Column:
    """The prefix before the first piece alone, unless it is empty, a special token, or begins with `unless_starts`."""
    on = lambda p, i: (i == 0) & ~p["skip"] & (p["piece"] != "") & ~F.startswith(p["piece"], F.lit(unless_starts))
    return F.transform(pieces, lambda p, i: F.struct(F.when(on(p, i), F.concat(F.lit(prefix), p["piece"])).otherwise(p["piece"]).alias("piece"), p["skip"].alias("skip")))


def byte_level_split(pieces: Column, single_digits: bool = False) -> Column:
    return regex_split(pieces, BYTE_LEVEL_DIGITS if single_digits else BYTE_LEVEL, "isolate")


def digits_split(pieces: Column, mode: str = "isolate") -> Column:
    return regex_split(pieces, NUMBER, mode)


def punctuation_split(pieces: Column, mode: str = "isolate") -> Column:
    return regex_split(pieces, r"\p{P}", mode)
