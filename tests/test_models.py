"""Models against other implementations built from the same in-memory vocabularies, and whole pipelines both ways."""

import itertools
import json
import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import kernels as K
from textloom.operators import models as M
from textloom.plans.pipeline import Pipeline
from textloom.plans.stages import Stage, fused
from textloom.sources import definitions as D
from textloom.sources.sentencepiece import CharsMap, SentencePiece
from textloom.streaming.decode import decode_stream, token_bytes

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", "hello world", "Hello,  wörld! 123", "don't stop\nnow", "日本語 text", "🙂 emoji", "a", "   lead and trail  ", "thethethe anand", "x" * 150, "ﬁne ½"]


def bpe_json(byte_level=True):
    from textloom.functions.unicode import byte_alphabet

    vocab = {c: i for i, c in enumerate(byte_alphabet())}
    merges = []
    for a, b in [("h", "e"), ("l", "l"), ("he", "ll"), ("hell", "o"), ("Ġ", "w"), ("t", "he"), ("Ġ", "t"), ("a", "n"), ("an", "d"), ("an", "an"), ("x", "x"), ("xx", "xx"), ("Ã", "¶")]:
        if a in vocab and b in vocab:
            merges.append((a, b))
            vocab.setdefault(a + b, len(vocab))
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [{"id": len(vocab), "content": "<|end|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "vocab": vocab, "merges": [list(m) for m in merges]}}


def bert_json():
    words = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "hello", "world", "wor", "##ld", "don", "'", "t", "stop", "now", "!", ",", "日", "本", "語", "text", "a", "the", "##the", "an", "##and", "lead", "and", "trail", "1", "##2", "##3", "fine", "##x", "x", "em", "##oji"]
    special = [{"id": i, "content": w, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, w in enumerate(words[:4])]
    return {"version": "1.0", "truncation": {"direction": "Right", "max_length": 12, "strategy": "LongestFirst", "stride": 0}, "padding": None, "added_tokens": special, "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True}, "pre_tokenizer": {"type": "BertPreTokenizer"}, "post_processor": {"type": "BertProcessing", "sep": ["[SEP]", 2], "cls": ["[CLS]", 1]}, "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True}, "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": {w: i for i, w in enumerate(words)}}}


def run(spark, f, texts=TEXTS):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.y for r in df.select("i", f(F.col("text")).alias("y")).orderBy("i").collect()]


def test_byte_level_bpe(spark):
    d = bpe_json()
    other, p = tokenizers.Tokenizer.from_str(json.dumps(d)), Pipeline.from_json(D.from_tokenizer_json(d).to_json())
    texts = [*TEXTS, "hello<|end|> world"]
    ids = run(spark, p.ids, texts)
    assert ids == [other.encode(t).ids for t in texts]
    assert run(spark, lambda c: p.decode(p.ids(c)), TEXTS) == TEXTS
    assert run(spark, lambda c: p.decode(p.ids(c), skip_special=False), texts) == texts


def test_bert_single_and_pairs(spark):
    d = bert_json()
    other, p = tokenizers.Tokenizer.from_str(json.dumps(d)), D.from_tokenizer_json(d)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.product(TEXTS[1:6], ["hello hello hello hello world stop now", "a"]))], "i int, a string, b string")
    for r in p.encode(df, "a", pad=False).collect():
        e = other.encode(r.a)
        assert (r.input_ids, r.token_type_ids, r.attention_mask) == (e.ids, e.type_ids, e.attention_mask)
    for r in p.encode(df, "a", "b", truncation=False, pad=False).collect():
        other.no_truncation()
        e = other.encode(r.a, r.b)
        assert (r.input_ids, r.token_type_ids) == (e.ids, e.type_ids)
    widths = {(len(r.input_ids), len(r.token_type_ids), len(r.attention_mask)) for r in p.encode(df, "a", "b").collect()}
    assert len(widths) == 1 and {*map(len, widths)} == {3} and max(widths)[0] <= 12
    none = p.encode(spark.createDataFrame([("hello", ""), ("hello", None)], "a string, b string"), "a", "b", pad=False).collect()
    assert [r.input_ids for r in none] == [[1, 4, 2]] * 2
    assert run(spark, lambda c: p.decode(p.ids(c)), ["hello world, now!"]) == ["hello world, now!"]


def brute_unigram(vocab, text, unk):
    best = {0: (0.0, [])}
    low = min(s for i, (_, s) in enumerate(vocab) if i != unk) - 10
    for end in range(1, len(text) + 1):
        some = []
        for at in range(end):
            if at in best:
                for i, (t, s) in enumerate(vocab):
                    if i != unk and t == text[at:end]:
                        some.append((best[at][0] + s, best[at][1] + [i]))
                if end == at + 1 and not any(t == text[at:end] for i, (t, _) in enumerate(vocab) if i != unk):
                    some.append((best[at][0] + low, best[at][1] + [unk]))
        if some:
            best[end] = max(some, key=lambda x: x[0])
    ids = best[len(text)][1]
    return [x for i, x in enumerate(ids) if not (x == unk and i and ids[i - 1] == unk)]


def test_unigram():
    r = random.Random(1)
    vocab = [("<unk>", 0.0), ("a", -2.13), ("b", -3.7), ("ab", -3.91), ("abc", -6.05), ("c", -4.4), ("bc", -5.21), ("é", -5.03)]
    m = K.Unigram(vocab, 0)
    for _ in range(300):
        t = "".join(r.choice("abcéz日") for _ in range(r.randint(0, 14)))
        assert m.encode(t) == brute_unigram(vocab, t, 0)
    drawn = {tuple(m.sample("abcabc", 0.3, seed)) for seed in range(200)}
    assert len(drawn) > 5 and m.sample("abcabc", 0.3, 4) == m.sample("abcabc", 0.3, 4)
    assert all("".join(vocab[i][0] for i in d) == "abcabc" for d in drawn)


def test_word_models():
    w = K.WordPiece({"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "##a": 4}, 0)
    assert w.encode("unaffable") == [1, 2, 3] and w.encode("unaffablex") == [0] and w.encode("un" * 60) == [0] and w.encode("") == []
    t = K.Trie({"a": 1, "ab": 2, "abc": 3})
    assert t.encode("abcabxa") == [3, 2, -1, 1]
    b = K.BPE({"a": 0, "b": 1, "ab": 2, "<0xC3>": 3, "<unk>": 4}, [("a", "b")], unk_id=4, byte_fallback=True, fuse_unk=True)
    assert b.encode("abé") == [2, 3, 4] and b.encode("zzab") == [4, 2]
    with pytest.raises(ValueError):
        K.BPE({"a": 0}, [("a", "b")])


def test_ranks(spark):
    ranks = {bytes([b]): b for b in range(256)}
    for t in (b"he", b"ll", b"hell", b"hello", b" w", b"the", b" the", b"an", b"and"):
        ranks[t] = len(ranks)
    p = D.from_ranks(ranks, special={"<end>": 900})
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={"<end>": 900})
    texts = [*TEXTS, "the<end> and"]
    assert run(spark, p.ids, texts) == [enc.encode(t, allowed_special="all") for t in texts]
    assert D.read_ranks(["aGU= 256", ""]) == {b"he": 256}


def test_trie_lines(spark):
    p = D.from_trie_lines(["1 'a' 1", "2 b'\\xe6' 1", "3 'ab' 2", "5 '\\n' 1"])
    assert run(spark, p.ids, ["abaa\n"]) == [[3, 1, 1, 5]]
    assert run(spark, lambda c: p.decode(p.ids(c)), ["abaa\n"]) == ["abaa\n"]


def message(number, value):
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def sp_blob(kind=1, fallback=False):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    text = ["▁", "a", "b", "c", "e", "h", "l", "o", "t", "▁t", "he", "ll", "▁the", "hello", "▁hello", "an", "▁a", "and"]
    pieces += [(t, -1.5 - i / 3 if kind == 1 else -float(i + 1), 1) for i, t in enumerate(text)]
    out = b"".join(message(1, message(1, t) + message(2, s) + message(3, k)) for t, s, k in pieces)
    return out + message(2, message(3, kind) + message(35, int(fallback))) + message(3, message(1, "identity"))


@pytest.mark.parametrize("kind, fallback", [(1, False), (1, True), (2, False), (2, True)])
def test_sentencepiece(spark, kind, fallback):
    spm = pytest.importorskip("sentencepiece")
    blob = sp_blob(kind, fallback)
    other = spm.SentencePieceProcessor(model_proto=blob)
    m, p = D.from_sentencepiece(blob)
    texts = ["hello the and", "the  hello ", "", "band", "zé the", "日本 a"]
    assert run(spark, lambda c: M.encode_texts(c, m), texts) == [other.encode(t) for t in texts]
    ids = [other.encode(t) for t in texts]
    assert [m.decode(i) for i in ids] == [other.decode(i) for i in ids]
    both = SentencePiece.read(blob, add_bos=True, add_eos=True, reverse=True)
    assert both.encode("hello") == [2, *m.encode("hello")[::-1], 1]


def test_charsmap():
    # a double array for the keys "a" -> "b" and "ab" -> "xy", laid out by hand
    strings = b"b\0xy\0"
    units = [0] * 512
    units[0] = 256 << 10  # the root's children begin at 256
    node_a = 256 ^ ord("a")
    units[node_a] = ord("a") | 1 << 8 | (128 << 10)
    base = node_a ^ 128
    units[base] = 1 << 31 | 0
    node_ab = base ^ ord("b")
    units[node_ab] = ord("b") | 1 << 8 | (64 << 10)
    units[node_ab ^ 64] = 1 << 31 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings
    assert CharsMap(blob).apply("aabcé") == "bxycé"


def test_fusion():
    got = fused([Stage("nfd"), Stage("fold"), Stage("strip_accents"), Stage("nfc"), Stage("metaspace_split"), Stage("words")])
    assert [[s.name for s in g] for g in got] == [["nfd", "fold"], ["strip_accents"], ["nfc"], ["metaspace_split"], ["words"]]  # words still cuts off punctuation


def public(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def documents(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return [t for t in docs if t] + ["", " ", "\n\n  x", "don't  stop…  ", "日本語 Ünïcödé 🙂🙂", "a\u00a0b\u3000c", "<|endoftext|>x", "x" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_public_definitions(spark, documents, name):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(public(name))
    p = D.from_tokenizer_json(json.loads(Path(public(name)).read_text()))
    # `Lowercase` is full case folding here, and an empty piece still gets its word end
    documents = [t for t in documents if t.casefold() == t.lower() and (t or name.startswith("byte"))]
    want = [e.ids for e in other.encode_batch(documents, add_special_tokens=False)]
    got = run(spark, p.ids, documents)
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
    texts = run(spark, lambda c: p.decode(p.ids(c)), documents)
    if name.startswith("byte"):
        assert texts == [other.decode(w) for w in want]


def test_public_ranks(spark, documents):
    tiktoken = pytest.importorskip("tiktoken")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        ranks = D.read_ranks(Path(public(name)).read_text().splitlines())
        pattern = __import__("public_tokenizers").PATTERN
        other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        p = D.from_ranks(ranks, pattern)
        got = run(spark, p.ids, documents)
        assert [i for i, (a, t) in enumerate(zip(got, documents)) if a != other.encode_ordinary(t)] == []
        assert run(spark, lambda c: p.decode(p.ids(c)), documents) == documents


def test_public_sentencepiece(spark, documents):
    spm = pytest.importorskip("sentencepiece")
    other = spm.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    m, p = D.from_sentencepiece(Path(public("piece_bpe_32k.model")).read_bytes(), add_bos=True, add_eos=True)
    want = [other.encode(t) for t in documents]
    got = run(spark, p.ids, documents)
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []
    df = spark.createDataFrame([("the end",)], "t string")
    assert p.encode(df, "t").first().input_ids == [1, *other.encode("the end"), 2]
    back = run(spark, lambda c: p.decode(p.ids(c)), documents)
    assert back == [other.decode(w) for w in want]
    again = D.Pipeline.from_json(p.to_json())
    assert run(spark, again.ids, ["of the of"]) == [other.encode("of the of")]


def test_sentencepiece_special_tokens(spark):
    blob = sp_blob(1, True)
    m, p = D.from_sentencepiece(blob, special={"<turn>": 900, "sop": 901})
    got = run(spark, p.ids, ["the<turn>hello", "people sop", "sopx", "<turn>"])
    assert got[0] == [*m.encode("the"), 900, *m.encode("hello")] and got[3] == [900]
    assert got[1] == [*m.encode("people "), 901] and 901 not in run(spark, p.ids, ["psopx"])[0] and got[2] == [901, *m.encode("x")]
    assert run(spark, lambda c: p.decode(p.ids(c)), ["the<turn>hello"]) == ["the hello"]


def test_long_piece_bpe():
    blob = sp_blob(2, True)
    m = D.SentencePiece.read(blob)
    import time

    began = time.process_time()
    m.encode("hello the and " * 20_000)
    assert time.process_time() - began < 20


def test_metaspace_first(spark):
    split = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "first", "split": True}
    d = {"model": {"type": "WordLevel", "vocab": {"▁a": 0, "a": 1, "▁b": 2, "?": 3}, "unk_token": "?"}, "pre_tokenizer": split, "added_tokens": [{"id": 9, "content": "<s>", "special": True}]}
    p = D.from_tokenizer_json(d)
    assert run(spark, p.ids, ["a b", "<s>a b", "a<s>a", " a"]) == [[0, 2], [9, 1, 2], [0, 9, 1], [0]]


def test_explain_stages(spark):
    p = D.from_tokenizer_json(bert_json())
    r = p.explain_stages(spark.createDataFrame([("Héllo",)], "text string"), "text").first()
    assert r["stage_ids"] == [4] and r["stage_0_special"][0].piece == "Héllo"


def test_streams(spark, tmp_path):
    tokens = [bytes([b]) for b in range(256)]
    text = "é🙂 done"
    rows = [("s", i, b) for i, b in enumerate(text.encode())] + [("t", i, b) for i, b in enumerate(b"ok\xff")]
    for k in range(0, len(rows), 4):  # a file is a micro-batch
        spark.createDataFrame(rows[k : k + 4], "stream string, at int, id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream string, at int, id int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decode_stream(src, "stream", "at", "id", tokens).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {k: "".join(r.text for r in spark.table("decoded").where(F.col("stream") == k).orderBy("at").collect()) for k in "st"}
    assert got == {"s": text, "t": "ok�"}
    df = spark.createDataFrame([(list(text.encode()),)], "ids array<int>")
    assert bytes(df.select(token_bytes(F.col("ids"), tokens).alias("b")).first().b) == text.encode()
