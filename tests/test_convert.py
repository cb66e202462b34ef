"""Conversion with options, from files and objects."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom.functions import unicode as U
from textloom.sources.convert import Options, convert, load, special_tokens
from textloom.sources.definitions import from_tokenizer_json

from .test_models import bert_json, sp_blob

UNIGRAM = {"model": {"type": "Unigram", "unk_id": 0, "vocab": [["<unk>", 0.0], ["a", -1.0], ["b", -2.0], ["ab", -5.0]]}, "added_tokens": [{"id": 3, "content": "ab", "special": False}, {"id": 6, "content": "zz", "special": True}]}


def rows(df):
    return [(list(r.input_ids), list(r.attention_mask)) for r in df.orderBy("t").collect()]


def test_options(spark):
    df = spark.createDataFrame([("hello",), ("hello hello hello",)], "t string")
    tokenize, back = convert(bert_json(), with_detokenizer=True, tokenizer_output_type="int")
    got = tokenize(df, "t")
    assert dict(got.dtypes)["input_ids"] == "array<int>"
    whole = [ids for ids, _ in rows(got)]
    assert [r.x for r in got.orderBy("t").select(back(F.col("input_ids")).alias("x")).collect()] == ["hello", "hello hello hello"]
    bare = rows(convert(bert_json(), add_special_tokens=False)(df, "t"))
    assert len(bare[1][0]) == len(whole[1]) - 2
    cut = rows(convert(bert_json(), max_length=4, truncation=True)(df, "t"))
    assert [len(i) for i, _ in cut] == [4, 4] and sum(cut[1][1]) == 4
    wide = rows(convert(bert_json(), max_length=9, use_max_padding=True, left_padding=True)(df, "t"))
    assert [len(i) for i, _ in wide] == [9, 9] and wide[0][1][0] == 0 and wide[0][1][-1] == 1
    assert "attention_mask" not in convert(bert_json(), add_attention_mask=False)(df, "t").columns
    pairs = convert(bert_json(), number_of_inputs=2)
    assert len(rows(pairs(df.withColumn("u", F.col("t")), "t", "u"))[0][0]) > len(whole[0])
    for bad in (lambda: pairs(df, "t"), lambda: convert(bert_json(), Options(), max_length=3), lambda: convert(bert_json(), number_of_inputs=3), lambda: convert(bert_json(), utf8_replace_mode="x"), lambda: convert(UNIGRAM, use_max_padding=True)):
        with pytest.raises(ValueError):
            bad()


def test_streaming_bytes_and_skips(spark):
    _, back = convert(sp_blob(1, True), with_detokenizer=True, streaming_detokenizer=True)
    p = load(sp_blob(1, True))
    df = spark.createDataFrame([([1, 3 + 0xC3, 3 + 0xA9, 2],)], "ids array<bigint>")
    assert bytes(df.select(back(F.col("ids")).alias("x")).first().x) == "é".encode()
    ids = p.ids(F.lit("hello the"))
    text = lambda skip: spark.range(1).select(p.decode(ids, skip).alias("x")).first().x
    assert text(True) == "hello the" and text(list(range(3, 400))) == ""


def test_objects(tmp_path):
    import json

    token = lambda t, special: SimpleNamespace(content=t, special=special)
    other = SimpleNamespace(added_tokens_decoder={5: token("<a>", True), 6: token("b", False)}, tokenizer=SimpleNamespace(index_special_tokens={7: "<c>"}), special_tokens={"<d>": 8, "<p>": 0}, unk_token="<unk>", unk_token_id=0, pad_token_id=0)
    assert special_tokens(other) == {"<a>": 5, "<c>": 7, "<d>": 8, "<unk>": 0}
    assert "b" in special_tokens(other, only_special=False)
    fast = SimpleNamespace(backend_tokenizer=SimpleNamespace(to_str=lambda: json.dumps(bert_json())), model_max_length=10**30, truncation_side="left", padding_side="left", added_tokens_decoder={9: token("<x>", True)})
    p = load(fast)
    assert p.truncation_side == "left" == p.padding_side and p.max_length == 2**31 - 1 and 9 in p.skip_ids
    (tmp_path / "m.model").write_bytes(sp_blob(2, True))
    slow = SimpleNamespace(vocab_file=str(tmp_path / "m.model"), add_bos_token=True, model_max_length=7, added_tokens_decoder={400: token("<x>", True)})
    p = load(slow)
    assert p.template == [(1, 0), ("A", 0)] and p.special == {"<x>": 400} and p.max_length == 7
    with pytest.raises(TypeError):
        load(SimpleNamespace())


def test_added_tokens_win(spark):
    p = from_tokenizer_json(UNIGRAM)
    assert p.model["vocab"][3] == ["ab", -0.1 - 0.0] or p.model["vocab"][3][1] == pytest.approx(-0.1)
    assert len(p.model["vocab"]) == 7 and p.model["vocab"][5][0] == ""
    df = spark.createDataFrame([("abab",)], "t string")
    assert df.select(p.ids(F.col("t")).alias("x")).first().x == [3, 3]


def test_nmt(spark):
    spm = pytest.importorskip("sentencepiece")
    other = spm.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    some = [chr(c) for c in [*range(1, 0x2600), *range(0xFE00, 0x10000)]]
    df = spark.createDataFrame([(c,) for c in some], "c string")
    got = {r.c: r.x for r in df.select("c", U.charsmap(F.col("c"), form="nfkc", squeeze=False, nmt=True).alias("x")).collect()}
    assert [hex(ord(c)) for c in some if got[c] != other.normalize(c)] == []
