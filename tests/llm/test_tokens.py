import os
import random

import pytest
from pyspark.sql import functions as F

from chronoframe.llm import tokens as tk

pytestmark = pytest.mark.skipif(not os.path.isdir(tk.DEFAULT_DIR), reason="no vocabularies")

ODD = ["", None, " ", "it's  we'LL\n\n x ", "<|endoftext|>", "á​­", "👩‍🔧" * 9, "\x00\x01", "x" * 700, "1" * 700, " " * 700 + "y", "don't " * 200, "東京は" * 200, "\r\n\t  z", "'re 're" * 99]


def _reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tk.DEFAULT_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


@pytest.mark.parametrize("chunk,overlap", [(tk.CHUNK_CHARS, tk.OVERLAP_CHARS), (40, 16), (7, 6)])
def test_ids_and_round_trip(spark, chunk, overlap):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "Bc", " ", "  ", "'s", "'", "1", "é", "\n", "。", "東", "🙂", ".", "'ll"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("piece", F.lit(1))
    got = tk.encode_corpus(df, chunk=chunk, overlap=overlap)
    out = got.collect()
    assert len(out) == len(rows)
    want = dict(enumerate(_reference(texts)))
    for r in out:
        assert r.ids == want[r.doc_id], (r.doc_id, texts[r.doc_id])
    decoded = {r.doc_id: r.text for r in tk.decode_ids(got).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b" * 30), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in tk.encode_corpus(df, chunk=16, overlap=8).collect()) == [0, len(_reference(["a b" * 30])[0])]
    assert tk.encode_corpus(df.where("false")).count() == 0
    assert tk.decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text is None


def test_long_texts_at_the_production_chunk(spark):
    rng = random.Random(5)
    words = "".join(rng.choice(["the ", "Bells ", "don't ", "  ", "東京は", "é", "1234", "\n", "🙂", ". "]) for _ in range(12_000))
    texts = [words, "x" * 9000, " " * 9000 + "y", "x" * 8192, words[:8193]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert max(map(len, texts)) > 3 * tk.CHUNK_CHARS
    got = {r.doc_id: r.ids for r in tk.encode_corpus(df).select("doc_id", "ids").collect()}
    assert got == dict(enumerate(_reference(texts)))


@pytest.mark.parametrize("block,block_overlap", [(64, 16), (200, 40)])
def test_texts_of_many_blocks(spark, block, block_overlap):
    """Blocks that fall into step, that never do (runs without a boundary), and repeats of a text."""
    rng = random.Random(7)
    mixed = lambda n: "".join(rng.choice(["a", "Bc", " ", "'s", "1", "\u00e9", "\n", "\u6771\u4eac", ".", "'ll"]) for _ in range(n))
    texts = [mixed(900), "x" * 1000, " " * 1000 + "y", "\u6771" * 700 + mixed(300) + "z" * 600 + mixed(50), "'" * 500, mixed(block), mixed(block + 1)] + [mixed(150) + rng.choice("x1 '") * rng.randrange(500) + mixed(150) for _ in range(20)]
    rows = [*enumerate(texts), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = tk.encode_corpus(df, chunk=16, overlap=8, block=block, block_overlap=block_overlap).collect()
    want = dict(enumerate(_reference(texts)))
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == want[r.doc_id], (r.doc_id, texts[r.doc_id])


def test_chunks_are_stitched():
    """Nearly every chunk of an ordinary text gives a cut; one long run gives none, in few passes."""
    text = "The miller moved the wooden boats. " * 300
    cuts, _ = tk.stitch(text)
    assert len(cuts) == -(-len(text) // tk.CHUNK_CHARS) and set(cuts) <= set(tk.pre_token_starts(text))
    assert tk.stitch("x" * 200_000)[0] == [0]
