"""One entry for all kinds of definitions, with the options that a conversion has."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import valid_utf8
from ..plans.pipeline import NO_LIMIT, Pipeline
from ..streaming.decode import token_bytes
from .definitions import TIDY, from_ranks, from_sentencepiece, from_tokenizer_json, from_trie_lines, read_ranks

KINDS = {".json": "json", ".model": "sentencepiece", ".tiktoken": "ranks", ".txt": "trie", ".pipeline": "pipeline"}


@dataclass(frozen=True)
class Options:
    """How a definition is used. None: as the definition says.

    number_of_inputs: 2 for pairs of texts. use_max_padding: pad to max_length instead of the longest row. utf8_replace_mode:
    `replace` or `ignore` for malformed bytes, None leaves them. streaming_detokenizer: bytes of each row, which may end
    within a character. left_padding: None as the definition says."""

    with_detokenizer: bool = False
    add_special_tokens: bool = True
    skip_special_tokens: bool = True
    clean_up_tokenization_spaces: bool | None = None
    tokenizer_output_type: str = "bigint"
    detokenizer_input_type: str = "bigint"
    streaming_detokenizer: bool = False
    use_max_padding: bool = False
    truncation: bool = False
    handle_special_tokens_with_re: bool | None = None
    use_sentencepiece_backend: bool = False
    utf8_replace_mode: str | None = "replace"
    max_length: int | None = None
    number_of_inputs: int = 1
    add_attention_mask: bool = True
    left_padding: bool | None = None

    def __post_init__(self):
        if self.number_of_inputs not in (1, 2):
            raise ValueError("number_of_inputs is 1 or 2")
        if self.utf8_replace_mode not in ("replace", "ignore", None):
            raise ValueError("utf8_replace_mode is replace, ignore or None")
        for kind in (self.tokenizer_output_type, self.detokenizer_input_type):
            if kind not in ("int", "bigint"):
                raise ValueError("token ids are int or bigint")


def special_tokens(tokenizer, only_special: bool = True) -> dict[str, int]:
    """The special tokens of a tokenizer object by its attributes added_tokens_decoder, tokenizer.index_special_tokens and
    special_tokens; of tokens that share an id the later counts, and an unknown token that isn't listed takes its id."""
    by_id: dict[int, str] = {i: t.content for i, t in getattr(tokenizer, "added_tokens_decoder", {}).items() if t.special or not only_special}
    by_id.update(getattr(getattr(tokenizer, "tokenizer", None), "index_special_tokens", {}))
    if named := getattr(tokenizer, "special_tokens", None):
        by_id.update({i: t for t, i in sorted(named.items(), key=lambda x: x[1])})
        unk = getattr(tokenizer, "unk_token", None)
        if unk is not None and unk not in by_id.values():
            by_id[tokenizer.unk_token_id or tokenizer.pad_token_id] = unk
    return {t: i for i, t in by_id.items()}


def load(source, kind: str | None = None, options: Options | None = None) -> Pipeline:
    """A pipeline from a path, a dict, the bytes of a SentencePiece model, a pipeline, or a tokenizer object.

    An object gives its definition by `backend_tokenizer.to_str()` or `to_str()`, or, with use_sentencepiece_backend or
    where it has no other, by the model file that its `vocab_file` names; its special tokens, length limit and sides count."""
    options = options or Options()
    if isinstance(source, Pipeline):
        return Pipeline.from_json(source.to_json())
    if isinstance(source, dict):
        return from_tokenizer_json(source, options.clean_up_tokenization_spaces)
    if isinstance(source, bytes):
        return from_sentencepiece(source)[1]
    if not isinstance(source, (str, Path)):
        return _from_object(source, options)
    path = Path(source)
    kind = kind or KINDS.get(path.suffix)
    if kind == "sentencepiece":
        return from_sentencepiece(path.read_bytes())[1]
    text = path.read_text()
    if kind == "json":
        return from_tokenizer_json(json.loads(text), options.clean_up_tokenization_spaces)
    if kind == "ranks":
        return from_ranks(read_ranks(text.splitlines()))
    if kind == "trie":
        return from_trie_lines(text.splitlines())
    if kind == "pipeline":
        return Pipeline.from_json(text)
    raise ValueError(f"what kind of definition is {source}?")


def _from_object(source, options: Options) -> Pipeline:
    backend = getattr(source, "backend_tokenizer", source)
    model = getattr(source, "vocab_file", None)
    if model and str(model).endswith(".model") and (options.use_sentencepiece_backend or not hasattr(backend, "to_str")):
        special = special_tokens(source) if options.handle_special_tokens_with_re is not False else {}
        p = from_sentencepiece(Path(model).read_bytes(), special, add_bos=bool(getattr(source, "add_bos_token", False)), add_eos=bool(getattr(source, "add_eos_token", False)))[1]
    elif hasattr(backend, "to_str"):
        p = from_tokenizer_json(json.loads(backend.to_str()), options.clean_up_tokenization_spaces)
        p.skip_ids = sorted({*p.skip_ids, *special_tokens(source).values()})
    else:
        raise TypeError(f"no definition in a {type(source).__name__}")
    if (limit := getattr(source, "model_max_length", None)) is not None:
        p.max_length = int(min(limit, NO_LIMIT))
    p.truncation_side = getattr(source, "truncation_side", p.truncation_side)
    p.padding_side = getattr(source, "padding_side", p.padding_side)
    return p


def convert(source, options: Options | None = None, kind: str | None = None, **how) -> Callable | tuple[Callable, Callable]:
    """tokenize(df, text[, second], batch=None) -> df with input_ids, token_type_ids and attention_mask; with_detokenizer
    also detokenize(ids: Column) -> Column. Options come as one object or one by one, not both."""
    if options is not None and how:
        raise ValueError("options or single ones, not both")
    o = options or Options(**how)
    p = load(source, kind, o)
    if o.max_length is not None:
        p.max_length = o.max_length
    if o.left_padding is not None:
        p.padding_side = "left" if o.left_padding else "right"
    if o.use_max_padding:
        if not p.max_length or p.max_length >= NO_LIMIT - 64:
            raise ValueError("use_max_padding needs a length limit")
        p.pad_to = p.max_length
    if o.clean_up_tokenization_spaces is not None:
        p.decoder = [s for s in p.decoder if tuple(s) != TIDY] + [TIDY] * o.clean_up_tokenization_spaces

    def tokenize(df: DataFrame, text: str, second: str | None = None, batch: str | None = None) -> DataFrame:
        if (second is not None) != (o.number_of_inputs == 2):
            raise ValueError(f"made for {o.number_of_inputs} text columns")
        if o.utf8_replace_mode:
            for c in (text, second) if second else (text,):
                df = df.withColumn(c, valid_utf8(c, o.utf8_replace_mode == "replace"))
        out = p.encode(df, text, second, add_special=o.add_special_tokens, truncation=o.truncation or o.use_max_padding, batch=batch)
        out = out.withColumns({c: F.col(c).cast(f"array<{o.tokenizer_output_type}>") for c in ("input_ids", "token_type_ids", "attention_mask")})
        return out if o.add_attention_mask else out.drop("attention_mask")

    def detokenize(ids: Column) -> Column:
        some = ids.cast("array<int>")
        if o.streaming_detokenizer:
            gone = set(p.skip_ids) if o.skip_special_tokens else ()
            return token_bytes(some, [b"" if i in gone else bytes.fromhex(t) for i, t in enumerate(p.tokens)])
        return p.decode(some, o.skip_special_tokens, o.utf8_replace_mode or "replace")

    tokenize.pipeline = p
    return (tokenize, detokenize) if o.with_detokenizer else tokenize

