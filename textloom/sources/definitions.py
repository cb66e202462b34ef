"""Tokenizer definitions as pipelines."""

from __future__ import annotations

import ast
import base64
import warnings
from collections.abc import Iterable

from ..functions.pieces import BYTE_LEVEL
from ..functions.unicode import byte_alphabet, chars_to_bytes_text
from ..operators.kernels import merges_from_ranks
from ..operators.vocab import as_list
from ..plans.pipeline import NO_LIMIT, Pipeline
from ..plans.stages import Stage
from .sentencepiece import BYTE, CONTROL, SPACE, UNKNOWN, UNKNOWN_TEXT, SentencePiece

TIDY = ("tidy_spaces", {})


def _each(step: dict | None, inner: str) -> list[dict]:
    if not step:
        return []
    return [x for s in step[inner] for x in _each(s, inner)] if step["type"] == "Sequence" else [step]


def _pattern(p) -> tuple[str, bool]:
    """The pattern, and whether it is literal."""
    if isinstance(p, str):
        return p, True
    return (p["Regex"], False) if "Regex" in p else (p["String"], True)


def _bert(s: dict) -> list[Stage]:
    out = [Stage("drop_controls"), Stage("plain_spaces")] if s.get("clean_text", True) else []
    if s.get("handle_chinese_chars", True):
        out.append(Stage("space_han"))
    lower = s.get("lowercase", True)
    if s.get("strip_accents") or (s.get("strip_accents") is None and lower):
        out += [Stage("nfd"), Stage("strip_accents")]
    return [*out, Stage("fold")] if lower else out


def _normalizer(s: dict) -> list[Stage]:
    kind = s["type"]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [Stage(kind.lower())]
    if kind == "Lowercase":
        return [Stage("fold")]
    if kind == "StripAccents":
        return [Stage("strip_accents")]
    if kind == "BertNormalizer":
        return _bert(s)
    if kind == "Replace":
        p, literal = _pattern(s["pattern"])
        return [Stage("replace", {"pairs": {p: s["content"]}}) if literal else Stage("regex", {"pattern": p, "replacement": s["content"]})]
    if kind == "Prepend":
        return [Stage("prepend", {"prefix": s["prepend"]})]
    if kind == "Strip":
        return [Stage("strip", {"left": s.get("strip_left", True), "right": s.get("strip_right", True)})]
    if kind == "Precompiled":
        return [Stage("charsmap", {"blob": base64.b64decode(s["precompiled_charsmap"]).hex()})]
    raise ValueError(f"normalizer {kind} isn't known")


def _splitter(s: dict) -> list[Stage]:
    kind = s["type"]
    mode = lambda m: m.lower().removesuffix("d") if m.lower() in ("removed", "isolated") else m.lower()
    if kind == "BertPreTokenizer":
        return [Stage("bert")]
    if kind == "Whitespace":
        return [Stage("words")]
    if kind == "WhitespaceSplit":
        return [Stage("split", {"pattern": r"\s+", "mode": "remove"})]
    if kind == "Punctuation":
        return [Stage("punctuation", {"mode": mode(s.get("behavior", "Isolated"))})]
    if kind == "Digits":
        return [Stage("digits", {"mode": "isolate" if s.get("individual_digits") else "contiguous"})]
    if kind == "Split":
        p, literal = _pattern(s["pattern"])
        if not p:
            return [Stage("chars")]
        from ..dialect import quoted

        return [Stage("split", {"pattern": quoted(p) if literal else p, "mode": mode(s.get("behavior", "Removed")), "invert": s.get("invert", False)})]
    if kind == "ByteLevel":
        out = [Stage("prefix_space")] if s.get("add_prefix_space") else []
        return [*out, Stage("byte_level")] if s.get("use_regex", True) else out
    if kind == "Metaspace":
        mark, scheme = s.get("replacement", SPACE), s.get("prepend_scheme", "always" if s.get("add_prefix_space", True) else "never")
        out = [Stage("metaspace", {"mark": mark})]
        if scheme != "never":
            out.append(Stage("prepend_first" if scheme == "first" else "prepend", {"prefix": mark, "unless_starts": mark}))
        return [*out, Stage("metaspace_split", {"mark": mark})] if s.get("split", True) else out
    raise ValueError(f"pre-tokenizer {kind} isn't known")


def _template(s: dict | None, p: Pipeline) -> None:
    for step in _each(s, "processors"):
        kind = step["type"]
        if kind == "TemplateProcessing":
            ids = {k: v["ids"] for k, v in step["special_tokens"].items()}

            def items(some, ids=ids) -> list[tuple]:
                out = []
                for x in some:
                    (name, v), = x.items()
                    out += [(v["id"], v["type_id"])] if name == "Sequence" else [(i, v["type_id"]) for i in ids[v["id"]]]
                return out

            p.template, p.pair = items(step["single"]), items(step["pair"])
        elif kind in ("BertProcessing", "RobertaProcessing"):
            (_, cls), (_, sep) = step["cls"], step["sep"]
            two = 1 if kind == "BertProcessing" else 0
            p.template = [(cls, 0), ("A", 0), (sep, 0)]
            p.pair = [*p.template, *([] if two else [(sep, 0)]), ("B", two), (sep, two)]
        elif kind != "ByteLevel":
            raise ValueError(f"post-processor {kind} isn't known")


def _with_added(vocab: list, added: list[dict]) -> list[list]:
    """A scored vocabulary with its added tokens: at least the length times the best score, so that they win; gaps are empty."""
    out = [list(x) for x in vocab]
    best, worst = max(s for _, s in out), min(s for _, s in out)
    out += [["", worst] for _ in range(max((t["id"] for t in added), default=-1) + 1 - len(out))]
    for t in added:
        i, text = t["id"], t["content"]
        out[i] = [text, max(out[i][1], best * len(text) - 0.1)]
    return out


def from_tokenizer_json(d: dict, clean_up_spaces: bool | None = None) -> Pipeline:
    """A pipeline from the fast-tokenizer definition as a dict."""
    model, kind = d["model"], d["model"].get("type") or ("BPE" if "merges" in d["model"] else "WordPiece")
    splits = _each(d.get("pre_tokenizer"), "pretokenizers")
    byte_level = any(s["type"] == "ByteLevel" for s in splits) or any(s["type"] == "ByteLevel" for s in _each(d.get("decoder"), "decoders"))
    added = d.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    if kind == "WordPiece":
        vocab = model["vocab"]
        spec = {"type": "wordpiece", "vocab": vocab, "unk_id": vocab[model["unk_token"]], "prefix": model.get("continuing_subword_prefix", "##"), "max_bytes": model.get("max_input_chars_per_word", 100)}
    elif kind == "BPE":
        vocab = model["vocab"]
        if model.get("continuing_subword_prefix"):
            raise ValueError("a BPE with a continuing prefix isn't supported")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        unk = model.get("unk_token")
        spec = {"type": "bpe", "vocab": vocab, "merges": merges, "unk_id": vocab.get(unk) if unk else None, "fuse_unk": bool(model.get("fuse_unk")), "end_suffix": model.get("end_of_word_suffix") or "", "byte_fallback": bool(model.get("byte_fallback")), "byte_level": byte_level}
    elif kind == "Unigram":
        scored = _with_added(model["vocab"], added)
        vocab = {t: i for i, (t, _) in reversed(list(enumerate(scored)))}
        spec = {"type": "unigram", "vocab": scored, "unk_id": model["unk_id"], "byte_fallback": bool(model.get("byte_fallback"))}
    elif kind == "WordLevel":
        vocab = model["vocab"]
        spec = {"type": "wordlevel", "vocab": vocab, "unk_id": vocab.get(model.get("unk_token"), -1)}
    else:
        raise ValueError(f"model {kind} isn't known")
    p = Pipeline(spec, special=special, stripping={t["content"]: (bool(t.get("lstrip")), bool(t.get("rstrip"))) for t in added})
    p.stages = [x for s in _each(d.get("normalizer"), "normalizers") for x in _normalizer(s)] + [x for s in splits for x in _splitter(s)]
    digits = [i for i, s in enumerate(p.stages) if s.name == "digits" and s.args.get("mode") == "isolate"]
    if digits and any(s.name == "byte_level" for s in p.stages):  # one expression does both
        p.stages = [Stage("byte_level", {"single_digits": True}) if s.name == "byte_level" else s for i, s in enumerate(p.stages) if i not in digits]
    _template(d.get("post_processor"), p)
    if t := d.get("truncation"):
        p.max_length, p.truncation_side = min(t["max_length"], NO_LIMIT), t.get("direction", "Right").lower()
    if t := d.get("padding"):
        p.pad_id, p.pad_type_id, p.padding_side = t.get("pad_id", 0), t.get("pad_type_id", 0), t.get("direction", "Right").lower()
        p.pad_to = t["strategy"]["Fixed"] if isinstance(t.get("strategy"), dict) else 0
    p.skip_ids = [t["id"] for t in added if t.get("special")]
    _decoder(d, p, kind, as_list({**vocab, **special}), set(special), byte_level)
    if clean_up_spaces or (clean_up_spaces is None and kind == "WordPiece" and TIDY not in p.decoder):
        p.decoder.append(TIDY)
    return p


def _decoder(d: dict, p: Pipeline, kind: str, names: list[str], special: set[str], byte_level: bool) -> None:
    steps = _each(d.get("decoder"), "decoders")
    kinds = {s["type"] for s in steps}
    fallback = "ByteFallback" in kinds
    glue = next((s.get("prefix", "##") for s in steps if s["type"] == "WordPiece"), "##") if kind == "WordPiece" else None
    out = []
    for t in names:
        if byte_level and t not in special:
            out.append(chars_to_bytes_text(t))
        elif fallback and len(t) == 6 and t.startswith("<0x"):
            out.append(bytes.fromhex(t[3:5]))
        elif glue:
            out.append((t[len(glue) :] if t.startswith(glue) else " " + t).encode())
        elif kind == "WordLevel":
            out.append((" " + t).encode())
        else:
            out.append(t.encode())
    p.tokens = [t.hex() for t in out]
    if glue or kind == "WordLevel":
        p.decoder.append(("drop_first", {}))
        if any(s["type"] == "WordPiece" and s.get("cleanup", True) for s in steps):
            p.decoder.append(TIDY)
    if kind == "BPE" and p.model.get("end_suffix"):
        p.decoder += [("replace", {"pairs": {p.model["end_suffix"]: " "}}), ("drop_last", {})]
    for s in steps:
        if s["type"] == "Replace":
            pattern, literal = _pattern(s["pattern"])
            p.decoder.append(("replace", {"pairs": {pattern: s["content"]}}) if literal else ("regex", {"pattern": pattern, "replacement": s["content"]}))
        elif s["type"] == "Strip":
            p.decoder += [("drop_first", {"content": s["content"]})] * s.get("start", 0) + [("drop_last", {"content": s["content"]})] * s.get("stop", 0)
        elif s["type"] == "Metaspace":
            p.decoder.append(("replace", {"pairs": {s.get("replacement", SPACE): " "}}))
            if s.get("prepend_scheme", "always") != "never":
                p.decoder.append(("drop_first", {}))
        elif s["type"] not in ("Fuse", "ByteFallback", "ByteLevel", "WordPiece", "BPEDecoder"):
            warnings.warn(f"decoder {s['type']} isn't known and does nothing", stacklevel=3)


def from_ranks(ranks: dict[bytes, int], pattern: str = BYTE_LEVEL, special: dict[str, int] | None = None) -> Pipeline:
    """A pipeline from byte tokens with ranks that are their ids, the pattern that cuts texts, and special tokens."""
    merges, alone = merges_from_ranks(ranks)
    spec = {"type": "bpe", "vocab": {t.hex(): i for t, i in ranks.items()}, "merges": [(a.hex(), b.hex()) for a, b in merges], "hexed": True}
    p = Pipeline(spec, [Stage("split", {"pattern": pattern, "mode": "isolate"})], dict(special or {}))
    table: dict[int, bytes] = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in p.special.items()}
    p.tokens = [table.get(i, b"").hex() for i in range(max(table, default=-1) + 1)]
    p.skip_ids, p.info = list(p.special.values()), {"without_merge": len(alone)}
    return p


def read_ranks(lines: Iterable[str]) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def from_trie_lines(lines: Iterable[str]) -> Pipeline:
    """A greedy-trie pipeline from lines `id literal length`; the literal is a Python string or bytes."""
    ids: dict[bytes, int] = {}
    for line in filter(str.strip, lines):
        i, rest = line.split(" ", 1)
        literal, size = rest.strip().rsplit(" ", 1)
        token = ast.literal_eval(literal)
        token = token.encode() if isinstance(token, str) else token
        if len(token) != int(size):
            raise ValueError(f"token {i} isn't {size} bytes long")
        ids[token] = int(i)
    table = {i: t for t, i in ids.items()}
    p = Pipeline({"type": "trie", "vocab": {t.hex(): i for t, i in ids.items()}})
    p.tokens = [table.get(i, b"").hex() for i in range(max(table, default=-1) + 1)]
    return p


def from_sentencepiece(blob: bytes, special: dict[str, int] | None = None, **options) -> tuple[SentencePiece, Pipeline]:
    """The model itself (for `encode_texts`), and a pipeline that encodes and decodes with it.

    special: tokens that are cut out before the model sees a text, one of letters alone only at a word's edge. The
    options add_bos, add_eos and reverse are the pipeline's template; the others go to the model."""
    m = SentencePiece.read(blob, **options)
    around = {k: options.pop(k, False) for k in ("add_bos", "add_eos", "reverse")}
    p = Pipeline({"type": "sentencepiece", "blob": blob.hex(), "options": options, "reverse": around["reverse"]}, special=dict(special or {}))
    p.stripping = {t: (False, False, True) for t in p.special if t.isascii() and t.isalpha()}
    bos, eos = [(m.bos_id, 0)] * bool(around["add_bos"]), [(m.eos_id, 0)] * bool(around["add_eos"])
    p.template = [*eos, ("A", 0), *bos] if around["reverse"] else [*bos, ("A", 0), *eos]
    names = [(bytes([int(t[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else UNKNOWN_TEXT if kind == UNKNOWN else t.replace(SPACE, " ").encode()) for t, _, kind in m.pieces]
    names += [b""] * (max([-1, *p.special.values()]) + 1 - len(names))
    for t, i in p.special.items():
        names[i] = names[i] or t.encode()
    p.tokens = [t.hex() for t in names]
    p.skip_ids = sorted({i for i, (_, _, kind) in enumerate(m.pieces) if kind == CONTROL} | set(p.special.values()))
    p.decoder = [("drop_first", {})] if m.dummy_prefix else []
    p.info = {"alphabet": len(byte_alphabet())} if m.byte_fallback else {}
    return m, p
