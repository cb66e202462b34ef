"""The same results when what batches send each other travels in several hops, and what it takes to deal rows to many batches."""

import time

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import common, near
from textloom.llm.common import Lanes

from . import test_lm, test_near, test_substring


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(common, "FAN", 6)
    assert Lanes.of(24, 48).hops == 3


def test_lanes():
    assert Lanes.of(127, 300) == Lanes(300, 1, 2000)
    for senders, receivers in ((7500, 15_000), (25_000_000, 50_000_000), (2001, 10)):
        x = Lanes.of(senders, receivers)
        assert x.count(x.hops) >= receivers and x.wide <= x.fan and x.fan**x.hops >= senders and x.hops > 1


def test_counts(spark, narrow):
    test_lm.test_base_and_model(spark)


def test_strings(spark, narrow):
    test_substring.test_both_equal_brute_force(spark, 20)


def test_classes(spark, narrow):
    test_near.test_classes_equal_brute_force(spark)


@pytest.mark.parametrize("gb", [6, 30, 1000])
def test_a_hop_joins_what_about_one_sender_sends(gb):
    senders, buckets = gb * 250 + 1, gb * 1000 // 3 + 1
    for there, n in ((Lanes.of(senders, buckets), senders), (Lanes.of(buckets, senders), buckets)):
        assert there.hops > 1 and there.count(there.hops) >= (buckets if n == senders else senders)
        assert min(there.fan, n) <= 1.5 * there.wide  # a group has `fan` senders' parts for one lane of `wide`
        assert n * there.wide <= 0.1 * senders * buckets


def test_rows_are_dealt_to_many_batches_without_a_copy_for_each():
    n = 3000
    some = [pa.RecordBatch.from_pydict({"batch": pa.array([(7 * i) % n for i in range(r, n, 10)], pa.int32()), "k": pa.array(range(r, n, 10)), "doc": pa.array(range(r, n, 10)), "text": pa.array([f"é{i} " * 1500 for i in range(r, n, 10)]), "more0": pa.array(range(r, n, 10))}) for r in range(10)]
    began = time.process_time()
    got = [(rb.column("batch")[0].as_py(), common.unpack(rb.column("blob")[0].as_py())) for rb in common._packed(iter(some), ["more0"])]
    assert time.process_time() - began < 10
    assert [b for b, _ in got] == list(range(n))
    for b, (k, doc, texts, more) in got:
        i = int(k[0])
        assert 7 * i % n == b and doc.tolist() == [i] and texts == [f"é{i} ".encode() * 1500] and more == [[i]]
    whole = list(common._packed(iter([rb.set_column(0, "batch", pa.array(np.zeros(len(rb)), pa.int32())) for rb in some]), [], 1))
    assert len(whole) == 10 and sum(len(common.unpack(x.column("blob")[0].as_py())[0]) for x in whole) == n


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(common, "ROWS", 1000)
    assert Lanes.of(24, 48) == Lanes(7, 2, 7)


def test_classes_by_balanced_hops(spark, few_rows):
    test_near.test_classes_equal_brute_force(spark)


def test_scores_by_balanced_hops(spark, few_rows):
    test_lm.test_base_and_model(spark)


def test_words_by_balanced_hops(spark, few_rows):
    test_substring.test_both_equal_brute_force(spark, 20)


def test_classes_read_each_text_once_a_step(spark, few_rows, monkeypatch, tmp_path):
    log = str(tmp_path / "log")

    def logged(name, f):
        def g(b, *rest):
            with open(log, "a") as out:
                print(name, len(rest), b.number, file=out)
            return f(b, *rest)

        return g

    for name in ("_df_words", "_shingles"):
        monkeypatch.setattr(near, name, logged(name, getattr(near, name)))
    test_near.test_classes_equal_brute_force(spark)
    steps = (tmp_path / "log").read_text().split("\n")[:-1]
    assert {x.rsplit(" ", 1)[0] for x in steps} == {"_df_words 0", "_shingles 3", "_shingles 4"}  # counts, sketches, shingles of pairs
    assert len(steps) == len(set(steps))
