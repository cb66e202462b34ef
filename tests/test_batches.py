"""Arrow functions over large batches: what they hold at a time, how often they run, and the ways that make them faster."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from textloom import catalog
from textloom.operators import batches as B
from textloom.operators import kernels as K
from textloom.operators import models as M

SF = "/root/testdata/sf0.001"


def plain_function(monkeypatch, make):
    """The Python function behind a column."""
    seen = []

    class Seen:
        def __init__(self, f):
            seen.append(f)

        def asNondeterministic(self):
            return self

        def __call__(self, *_):
            return self

    monkeypatch.setattr("pyspark.sql.functions.arrow_udf", lambda *_: Seen)
    make()
    return seen[-1]


def test_parts():
    rows = [[{"piece": "ab" * i, "skip": i % 3 == 0}] * 5 if i % 7 else None for i in range(100)]
    x = pa.array(rows, pa.list_(pa.struct([("piece", pa.string()), ("skip", pa.bool_())])))[10:]
    some = B.parts(x, 2000)
    assert sum((p.to_pylist() for p in some), []) == rows[10:] and len(some) > 20
    assert all(len(p) == 1 or p.nbytes <= 2000 for p in some)
    assert B.by_parts(x, lambda p: p, 2000).to_pylist() == rows[10:] and len(B.by_parts(x[:0], lambda p: p)) == 0


def test_models_hold_a_part(monkeypatch):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(40000)]
    x = pa.array([[{"piece": w, "skip": False} for w in words[i : i + 400]] for i in range(0, 40000, 400)] * 2, pa.list_(pa.struct([("piece", pa.string()), ("skip", pa.bool_())])))
    peaks = []
    for rows in (x, pa.concat_arrays([x] * 32)):
        f = plain_function(monkeypatch, lambda: M.encode_pieces(None, K.Trie(catalog.TRIE_VOCAB), remember=False))
        f(rows[:1])
        tracemalloc.start()
        got = f(rows)
        peaks.append(tracemalloc.get_traced_memory()[1] - got.nbytes)
        tracemalloc.stop()
        assert len(got) == len(rows) and got[-1].as_py() == got[len(x) - 1].as_py()
    assert peaks[1] < 4 * peaks[0]  # over 32 times the rows, besides what it gives


@pytest.mark.parametrize("name", ["q_wordpiece", "q_bpe", "q_unigram", "q_trie", "q_sentencepiece", "q_sentencepiece_stream"])
def test_models_run_once(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("each(") == (2 if name == "q_sentencepiece_stream" else 1)


def test_texts_hold_a_part(monkeypatch):
    """Three forms of 32 MB of text, of which a list would take as much again for each."""
    from textloom.functions import unicode as U

    texts = pa.array([("é" + chr(97 + i % 26) * 999) for i in range(32 * 1024)])
    f = plain_function(monkeypatch, lambda: U.normalize_unicode(None, "NFD"))
    f(texts[:1])
    tracemalloc.start()
    got = f(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(texts) and got[-1].as_py()[:3] == "é" + chr(97 + (len(texts) - 1) % 26)
    assert peak < 16 << 20


def test_pairs_are_encoded_once(spark):
    """Three Arrow functions make ids of a text; both texts of a pair and the widths read the same ones."""
    df = catalog.queries()["q_pair_encode"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("- ArrowEvalPython") == 3


@pytest.mark.parametrize("pieces", [[("▁", -3.0)], [("▁", -3.0), ("▁an", -2.5)], [("▁", -3.0), ("▁th▁", -1.0)], []])
@pytest.mark.parametrize("rough", [False, True])
def test_sentences_by_words(pieces, rough):
    """Where a text is cut into words first, the ids are those of the whole text; a word is encoded once then."""
    from textloom.sources.sentencepiece import CONTROL, NORMAL, UNKNOWN, SentencePiece

    known = [*pieces, *((t, s * 1.1 - 0.013 if rough else s) for t, s in catalog.UNIGRAMS[1:])]
    m = SentencePiece([("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), *((t, s, NORMAL) for t, s in known)])
    r, seen, whole = random.Random(3), [], K.Unigram([("" if k != NORMAL else t, s) for t, s, k in m.pieces], 0, min_score=min(s for _, s in known))
    encode = m.model.encode
    m.model.encode = lambda w: seen.append(w) or encode(w)
    for _ in range(100):
        text = " ".join(r.choice(["the", "ändern", "re", "constant", "😀", "ßß", "th", "▁", "x.y", "anan"]) for _ in range(r.randint(0, 30)))
        assert m.encode(text) == whole.encode(m.normalize(text))
    by_words = not rough and bool(pieces) and pieces[-1][0] != "▁th▁"
    assert m.by_words == (bool(pieces) and pieces[-1][0] != "▁th▁") and (len(seen) < 20) == by_words


def test_streams_of_several_ids(spark, tmp_path):
    """A row may hold several ids; characters are cut between rows."""
    from textloom.streaming.decode import decode_stream

    text = {"s": "héllo 日本語 🙂", "t": "ß", "u": "x" + "é" * 20}
    rows = [(k, at, list(v.encode()[at * 4 : at * 4 + 4])) for k, v in text.items() for at in range(-(-len(v.encode()) // 4))]
    for k in range(0, len(rows), 6):
        spark.createDataFrame(rows[k : k + 6][::-1], "stream string, at int, ids array<int>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream string, at int, ids array<int>").parquet(str(tmp_path / "in"))
    q = decode_stream(src, "stream", "at", "ids", [bytes([b]) for b in range(256)]).writeStream.format("memory").queryName("several").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.stream, r.at, r.text) for r in spark.table("several").collect())
    assert {k: "".join(t for s, _, t in got if s == k) for k in text} == text and len(got) == len(rows)


def test_terms_are_split_once(spark):
    df = catalog.queries()["q_term_counts"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate posexplode") == 1
