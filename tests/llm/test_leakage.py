import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoframe.llm import leakage as lk
from chronoframe.llm.fm_index import FMIndex, suffix_array


@settings(max_examples=60)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 3))
def test_fm_index(text, width):
    t = np.array(text, np.int64)
    s = np.append(t, 0)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = FMIndex(t, 5, sample=3)
    phrases = np.array(np.meshgrid(*[[1, 2, 3, 4]] * width)).reshape(width, -1).T
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases.tolist(), lo, hi):
        want = [i for i in range(len(text) - width + 1) if text[i : i + width] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words():
    assert lk.words("Der​ Fluß&nbsp;&amp; FLUSS ½ co­op, x_y") == ["der", "fluss", "fluss", "1", "2", "coop", "x", "y"]
    assert lk.words("été &eacute;") == ["été", "é"] and lk.words(None) == [] and lk.words("…") == []


def _brute(docs, items, n):
    out = set()
    for i, it in items:
        w = lk.words(it)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, t in docs:
            v = lk.words(t)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [1 << 19, 25])
def test_against_brute_force(spark, shard, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(3, 30)))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        w = rng.choices([*vocab, "zz", "yy"], k=rng.randrange(60))
        if rng.random() < 0.5:
            it = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(it))
            at = rng.randrange(len(w) + 1)
            w[at:at] = it[a : a + rng.randrange(14)]
        docs.append((d, rng.choice([" ", ", ", " ­&nbsp;"]).join(w).upper()))
    docs += [(500, None), (501, ""), (502, items[3][1] * 40), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = _brute(docs, items, 5)
    assert want
    for at_once in (64 << 20, 700):
        monkeypatch.setattr(lk, "ITEM_BYTES", at_once)
        spans = lk.leaked_spans(df, it, size=5, shard_words=shard)
        assert {tuple(r) for r in lk.leaked_items(spans).collect()} == want
    text = dict(docs)
    for r in lk.leaked_spans(df, it, size=5).collect():
        w = lk.words(text[r.doc_id])[r.first_word : r.last_word + 1]
        assert len(w) == r.last_word - r.first_word + 1 >= 5
        assert (r.doc_id, r.item_id) in _brute([(r.doc_id, " ".join(w))], items, 5)
    assert lk.leaked_spans(df.where("false"), it).count() == 0 and lk.leaked_spans(df, it.where("false")).count() == 0


def test_removal_spans_do_not_overlap(spark):
    spans = [(1, 7, 1, 22), (1, 8, 6, 17), (1, 9, 23, 30), (1, 7, 40, 50), (2, 7, 1, 5), (None, 1, 0, 9), (None, 2, 5, 11)]
    df = spark.createDataFrame(spans, lk._SPANS)
    got = [(r.doc_id, r.first_word, r.last_word, r["items"]) for r in lk.removal_spans(df).orderBy("doc_id", "first_word").collect()]
    assert got == [(None, 0, 11, [1, 2]), (1, 1, 30, [7, 8, 9]), (1, 40, 50, [7]), (2, 1, 5, [7])]
    assert lk.removal_spans(df.where("false")).count() == 0
