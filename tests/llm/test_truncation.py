import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import truncation as tr

WHO, DID, WHAT = ["The baker", "A potter", "Her pilot", "El farero", "Der Müller"], ["sold", "moved", "drew", "counted"], ["the old bell", "clay jars", "wooden boats", "the garden gate"]


def _corpus():
    rng = random.Random(2)
    sentence = lambda: f"{rng.choice(WHO)} {rng.choice(DID)} {rng.choice(WHAT)} near the harbour."
    docs, cut = [], set()

    def add(source, text, is_cut=False):
        docs.append((len(docs), text, source))
        if is_cut:
            cut.add(len(docs) - 1)

    for source, limit, unit in (("chars", 120, "c"), ("bytes", 140, "b"), ("mark", 100, "m"), ("free", None, "")):
        for _ in range(400):
            text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
            if rng.random() < 0.05:
                text = text[:-1] + rng.choice(["…", "...", ";", ":", "!”"])
            if rng.random() < 0.06:
                add(source, f"Notes on {rng.choice(WHAT)}")
                continue
            if unit == "c" and len(text) > limit:
                short = text[:limit]
            elif unit == "b" and len(text.encode()) > limit:
                short = text.encode()[:limit].decode("utf-8", "replace")
            elif unit == "m" and len(text) > limit:
                short = text[:limit].rstrip() + rng.choice(["…", " [...]"])
            elif rng.random() < 0.03:
                short = text[: rng.randrange(12, len(text) - 2)]
            else:
                add(source, text)
                continue
            body = short.removesuffix(" [...]").removesuffix("…") if unit == "m" else short
            add(source, short, not body.rstrip().endswith((".", "”")))
    return docs, cut


def test_cut_documents(spark):
    docs, cut = _corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("kind", F.lit("clash"))
    got = {r.doc_id for r in tr.truncated(df).collect()}
    assert len(got & cut) / len(cut) > 0.98 and len(got & cut) / len(got) > 0.97
    limits = {r.source: (r.field_limit, r.unit) for r in tr.truncation_rates(df).collect()}
    assert limits["chars"] == (120, "chars") and limits["bytes"] == (140, "bytes") and limits["mark"][0] in (99, 100) and limits["free"] == (None, None)


def test_censored_fit():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(4.5, 0.6, 20_000))
    limit = 120.0
    length, n = np.unique(np.round(x[x < limit]), return_counts=True)
    mu, sigma, _ = tr.fit_censored(length, n.astype(float), limit, float((x >= limit).sum()))
    assert abs(mu - 4.5) < 0.03 and abs(sigma - 0.6) < 0.03


def _lengths(n, limit, strays):
    """Counts by length: 3 % cut anywhere, 5 % titles, cuts at the limit, open-ended strays of different lengths above."""
    rng = np.random.default_rng(1)
    length = np.maximum(5, np.round(np.exp(rng.normal(4.6, 0.6, n)))).astype(int)
    loose = rng.random(n) < 0.08
    if limit:
        over = length > limit
        length[over] = limit - rng.integers(0, 3, over.sum())
        loose |= over
    length, loose = np.append(length, strays), np.append(loose, np.ones(len(strays), bool))
    at, i = np.unique(length, return_inverse=True)
    return at, np.bincount(i), np.bincount(i, weights=loose).astype(int)


def test_limit_under_many_strays():
    strays = [240 + 20 * i for i in range(12)]
    gain, limit, posterior = tr.source_limit(*_lengths(8000, 220, strays))
    assert limit == 220 and gain > 1000 and min(posterior[x] for x in (218, 219, 220)) > 0.9 and max(posterior) == 220


def test_every_limit_that_gains_counts():
    _, limit, posterior = tr.source_limit(*_lengths(8000, 220, [400] * 12))
    assert limit == 220 and posterior[220] > 0.9 and posterior[400] > 0.5


def test_no_limit_in_the_tail_of_a_large_source():
    assert tr.source_limit(*_lengths(300_000, None, []))[1:] == (None, {})


@pytest.mark.parametrize("text", [None, "", "  \n", "​"])
def test_nothing_to_judge(spark, text):
    df = spark.createDataFrame([(1, text, "s"), (2, "It is whole.", None)], "doc_id long, text string, source string")
    assert tr.truncated(df).count() == 0


def test_nulls_repeats_long_and_empty(spark):
    long = "The baker sold bread. " * 50_000 + "The baker so"
    df = spark.createDataFrame([(1, long, None), (1, long, None), (2, "The baker sold bread.", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in tr.truncated(df).collect()] == [(1, None)]
    assert tr.truncated(df.where("false")).count() == 0 and tr.truncation_rates(df.where("false")).count() == 0
    assert {(r.source, r.n_texts, r.n_cut) for r in tr.truncation_rates(df).collect()} == {(None, 3, 2)}


@pytest.mark.parametrize("part", ["-", " ", ".", "(", "a", "\u2014 ", "<a", '. "', "<|a|>", "\u2026", "[ ", "\u3002", "\u00e9\u0301", "\u00a0", ". "])
def test_endings_of_very_long_runs(part):
    """Linear in the length, whatever runs the end, the start or all of a text."""
    begin = time.perf_counter()
    for text in ("It is whole. " + part * 1_000_000, part * 1_000_000 + " and the", part * 1_000_000):
        tr.ending(text)
    assert time.perf_counter() - begin < 30


@pytest.mark.parametrize(
    "text,kind",
    [("It is whole.", "sound"), ("\u201cIt is.\u201d ", "sound"), ("It is wh", "open"), ("It is\u2026", "mark"), ("It is [...]", "mark"), ("It is (..)", "mark"), ("It is ..", "sound"),
     ("It is. [...]", "sound"), ("It is:", "line"), ("It is. // --", "noise"), ("It is. <br> [END]", "noise"), ("It is. \u201c", "noise"), ("It is \ufffd", "open"), ("\u6771\u4eac\u3002", "sound"), ("Is it <b>", "open")],
)
def test_ending_kinds(text, kind):
    assert tr.ending(text)[0] == kind


def test_limit_of_a_part_of_a_source():
    """Two pipelines of one source, only one of which stops at 220."""
    a, b = _lengths(8000, 220, []), _lengths(2000, None, [])
    table = {}
    for at, n, k in (a, b):
        for x, i, j in zip(at.tolist(), n.tolist(), k.tolist()):
            c = table.setdefault(x, [0, 0])
            c[0], c[1] = c[0] + i, c[1] + j
    at = np.array(sorted(table))
    _, limit, posterior = tr.source_limit(at, np.array([table[x][0] for x in at]), np.array([table[x][1] for x in at]))
    assert limit == 220 and posterior[220] > 0.9
