"""Stages by name. A stage is plain data, so a pipeline can be written as JSON; `apply` makes the expression.

Neighbouring stages that Catalyst can't express are fused into one Arrow function, in their order."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions import pieces as P
from ..functions import text as X
from ..functions.unicode import bytes_to_chars_text, each_piece_text

NORMALIZE, SPLIT = "normalize", "split"


@dataclass(frozen=True)
class Stage:
    name: str
    args: dict = field(default_factory=dict)

    @property
    def phase(self) -> str:
        return SPLIT if self.name in SPLITS else NORMALIZE


#: Of one text; built-in expressions.
NORMALIZERS: dict[str, Callable[..., Column]] = {
    "regex": X.regex_normalize, "strip_accents": X.strip_accents, "prefix_space": X.prefix_space, "plain_spaces": X.plain_spaces, "space_han": X.space_han, "metaspace": X.metaspace,
    "prepend": X.prepend, "drop_controls": X.drop_controls, "strip": X.strip, "ascii_case": X.ascii_case, "replace": X.replace_literal,
}
#: Of a text; Python functions.
TEXTS: dict[str, Callable[..., Callable[[str], str]]] = {
    "nfc": lambda: lambda t: unicodedata.normalize("NFC", t), "nfd": lambda: lambda t: unicodedata.normalize("NFD", t),
    "nfkc": lambda: lambda t: unicodedata.normalize("NFKC", t), "nfkd": lambda: lambda t: unicodedata.normalize("NFKD", t),
    "fold": lambda: str.casefold, "bytes_to_chars": lambda: bytes_to_chars_text, "charsmap": lambda blob, squeeze=True: _charsmap(bytes.fromhex(blob), squeeze),
}
#: Of pieces; built-in expressions.
SPLITS: dict[str, Callable[..., Column]] = {
    "split": P.regex_split, "chars": P.split_chars, "bert": P.bert_split, "words": P.whitespace_split, "metaspace_split": P.metaspace_split, "byte_level": P.byte_level_split,
    "digits": P.digits_split, "punctuation": P.punctuation_split, "prepend_first": P.prepend_first,
}


def _charsmap(blob: bytes, squeeze: bool) -> Callable[[str], str]:
    from ..sources.sentencepiece import CharsMap

    table = CharsMap(blob)
    tidy = (lambda t: " ".join(p for p in t.split(" ") if p)) if squeeze else (lambda t: t)
    return lambda t: tidy(table.apply(t))


def fused(stages: Iterable[Stage]) -> list[list[Stage]]:
    """Neighbouring stages that run in Python together; all others alone."""
    out: list[list[Stage]] = []
    for s in stages:
        if out and s.name in TEXTS and out[-1][0].name in TEXTS:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def apply(pieces: Column, stages: Iterable[Stage]) -> Column:
    for group in fused(stages):
        name, args = group[0].name, group[0].args
        if name in TEXTS:
            steps = [TEXTS[s.name](**s.args) for s in group]

            def run(t: str, steps=steps) -> str:
                for f in steps:
                    t = f(t)
                return t

            pieces = each_piece_text(pieces, run)
        elif name in NORMALIZERS:
            pieces = P.each_piece(pieces, lambda x, name=name, args=args: NORMALIZERS[name](x, **args))
        elif name in SPLITS:
            pieces = SPLITS[name](pieces, **args)
        else:
            raise ValueError(f"no such stage: {name}")
    return pieces
