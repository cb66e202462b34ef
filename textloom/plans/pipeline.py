"""A whole tokenizer: special tokens, stages, a model, truncation, a template and padding; and the way back to text."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions import text as X
from ..functions.pieces import SpecialToken, as_pieces, special_split
from ..functions.unicode import chars_to_bytes_text
from ..operators import kernels as K
from ..operators.models import decode_bytes, encode_pieces
from .stages import Stage, apply

NO_LIMIT = 2**31 - 1


def build_model(spec: dict):
    kind, a = spec["type"], {k: v for k, v in spec.items() if k != "type"}
    if kind == "wordpiece":
        return K.WordPiece(**a)
    if kind == "wordlevel":
        return K.WordLevel(**a)
    if kind == "trie":
        return K.Trie(**{**a, "vocab": {bytes.fromhex(t): i for t, i in a["vocab"].items()}})
    if kind == "unigram":
        return K.Unigram([tuple(x) for x in a.pop("vocab")], **a)
    if kind == "sentencepiece":
        from ..sources.sentencepiece import SentencePiece

        return SentencePiece.read(bytes.fromhex(a["blob"]), **a["options"])
    if kind == "bpe":
        raw = chars_to_bytes_text if a.pop("byte_level", False) else str.encode
        if a.pop("hexed", False):
            raw = bytes.fromhex
        added = {t: i for t, i in a.pop("added", {}).items()}
        return K.BPE({raw(t): i for t, i in a.pop("vocab").items()}, [(raw(x), raw(y)) for x, y in a.pop("merges")], added=added, **a)
    raise ValueError(f"no such model: {kind}")


@dataclass
class Pipeline:
    """Plain data; `ids`, `encode` and `decode` make plans.

    template: for one text, items "A" or token ids with their type ids; pair: the same with "B". decoder: names of text
    functions with arguments, applied after the bytes of the tokens are joined. tokens: the text of each id, in hex."""

    model: dict
    stages: list[Stage] = field(default_factory=list)
    special: dict[str, int] = field(default_factory=dict)
    stripping: dict[str, tuple[bool, ...]] = field(default_factory=dict)
    template: list[tuple] = field(default_factory=lambda: [("A", 0)])
    pair: list[tuple] = field(default_factory=lambda: [("A", 0), ("B", 1)])
    max_length: int | None = None
    truncation_side: str = "right"
    padding_side: str = "right"
    pad_id: int = 0
    pad_type_id: int = 0
    pad_to: int = 0
    tokens: list[str] = field(default_factory=list)
    skip_ids: list[int] = field(default_factory=list)
    decoder: list[tuple[str, dict]] = field(default_factory=list)
    info: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        d = json.loads(text)
        d["stages"] = [Stage(**s) for s in d["stages"]]
        d["stripping"] = {k: tuple(v) for k, v in d["stripping"].items()}
        for k in ("template", "pair", "decoder"):
            d[k] = [tuple(x) for x in d[k]]
        return cls(**d)

    # ---- text to ids

    def pieces(self, text: Column) -> Column:
        tokens = [SpecialToken(t, *self.stripping.get(t, (False, False))) for t in self.special]
        return apply(special_split(as_pieces(text), tokens), self.stages)

    def ids(self, text: Column) -> Column:
        """The ids of the text alone: no template, no limit."""
        ids = encode_pieces(self.pieces(text), build_model(self.model), self.special)
        return F.reverse(ids) if self.model.get("reverse") else ids

    def _filled(self, items: list[tuple], **segments: Column) -> tuple[Column, Column]:
        cols = [segments[x] if isinstance(x, str) else [x] for x, _ in items]
        return R.combine(cols, [n for _, n in items])

    def encode(self, df: DataFrame, text: str, second: str | None = None, add_special: bool = True, truncation: bool = True, pad: bool = True, batch: str | None = None, max_length: int | None = None, encoded: bool = False) -> DataFrame:
        """df with input_ids, token_type_ids and attention_mask. A null text gives nulls; a null or empty second text is none.

        encoded: the columns `text` and `second` hold ids (of `ids`) and not texts.

        Padding is to the longest row of the batch (a value of the column `batch`; all rows without one), at least pad_to."""
        limit = max_length or self.max_length or NO_LIMIT
        items = self.template if second is None else self.pair
        if not add_special:
            items = [x for x in items if isinstance(x[0], str)]
        made = F.col if encoded else lambda c: self.ids(F.col(c))
        room = lambda some: max(0, limit - sum(not isinstance(x, str) for x, _ in some))
        if second is None:
            df = df.withColumn("_a", made(text))
            a = R.truncate(F.col("_a"), room(items), self.truncation_side) if truncation else F.col("_a")
            ids, types = self._filled(items, A=a)
        else:
            df = df.withColumn("_a", made(text)).withColumn("_b", F.coalesce(made(second), F.array().cast("array<int>")))
            a, b = R.truncate_pair(F.col("_a"), F.col("_b"), room(items), self.truncation_side) if truncation else (F.col("_a"), F.col("_b"))
            alone = self.template if add_special else [x for x in self.template if isinstance(x[0], str)]
            one = R.truncate(F.col("_a"), room(alone), self.truncation_side) if truncation else F.col("_a")
            (ids, types), (ids1, types1) = self._filled(items, A=a, B=b), self._filled(alone, A=one)
            ids, types = F.when(F.size("_b") == 0, ids1).otherwise(ids), F.when(F.size("_b") == 0, types1).otherwise(types)
        df = df.withColumns({"input_ids": ids, "token_type_ids": types}).drop("_a", "_b")
        if not pad:
            return df.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
        df = R.longest(df, "input_ids", batch, self.pad_to, "_width")
        w = F.col("_width")
        out = {"input_ids": R.pad(F.col("input_ids"), w, self.pad_id, self.padding_side), "token_type_ids": R.pad(F.col("token_type_ids"), w, self.pad_type_id, self.padding_side), "attention_mask": R.mask(F.col("input_ids"), w, self.padding_side)}
        return df.withColumns(out).drop("_width")

    # ---- ids to text

    def decode(self, ids: Column, skip_special: bool | Sequence[int] = True, errors: str = "replace") -> Column:
        """The text of ids. skip_special: whether skip_ids are left out, or the ids that are left out instead."""
        skip = (self.skip_ids if skip_special else ()) if isinstance(skip_special, bool) else skip_special
        text = decode_bytes(ids, [bytes.fromhex(t) for t in self.tokens], skip, errors)
        for name, args in self.decoder:
            text = {"regex": X.regex_normalize, "replace": X.replace_literal, "drop_first": X.drop_first, "drop_last": X.drop_last, "tidy_spaces": X.tidy_spaces}[name](text, **args)
        return text

    def explain_stages(self, df: DataFrame, text: str) -> DataFrame:
        """df with one column of pieces for the special tokens and for each stage: where two tokenizers part is where to look."""
        tokens = [SpecialToken(t, *self.stripping.get(t, (False, False))) for t in self.special]
        x = special_split(as_pieces(F.col(text)), tokens)
        df = df.withColumn("stage_0_special", x)
        last = "stage_0_special"
        for i, s in enumerate(self.stages, 1):
            df = df.withColumn(name := f"stage_{i}_{s.name}", apply(F.col(last), [s]))
            last = name
        return df.withColumn("stage_ids", encode_pieces(F.col(last), build_model(self.model), self.special))


def connect(df: DataFrame, first, second, names: dict[str, str] | None = None, keep: bool = True) -> DataFrame:
    """Two DataFrame functions in a row; names maps the first's outputs to the inputs of the second. keep: columns without a partner stay."""
    got = first(df)
    for a, b in (names or {}).items():
        got = got.withColumnRenamed(a, b)
    if names and not keep:
        got = got.select(*names.values())
    return second(got)
