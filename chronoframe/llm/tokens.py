"""Encoding of a whole corpus with a public byte-level BPE tokenizer, by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; the first pre-token boundary that a
chunk shares with the overlap of the chunk before it is a true boundary (the pattern only looks ahead), so both agree
from there on. The pieces between such boundaries are encoded independently and joined. Very long texts are spread over
tasks as blocks of chunks, which are stitched in the same way. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.session import cut_lineage

DEFAULT_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS, OVERLAP_CHARS = 512, 64
#: What one task handles of a text at once, and how far such blocks overlap.
BLOCK_CHARS, BLOCK_OVERLAP = 1 << 18, 4096
#: The pattern sees at most this many characters past a boundary; so close to a chunk's end none is trusted.
LOOKAHEAD = 4
MAX_VOCABULARY_BYTES = 64 << 20


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(hashlib.md5(vocabulary).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def ship_vocabulary(df: DataFrame, tokenizer_dir: str = DEFAULT_DIR, name: str = BYTE_BPE_50K) -> Broadcast:
    """The rank file, read once on the driver; its size is checked before it is sent to the executors."""
    path = os.path.join(tokenizer_dir, name)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def pre_token_starts(text: str, pattern: str = PATTERN) -> list[int]:
    return [m.start() for m in _pattern(pattern).finditer(text)]


def _white(c: str) -> bool:
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def cut_places(text: str, start: int, end: int, pattern: str, whole: bool = True) -> list[int]:
    """Places of the pre-tokens of ``text[start:end]`` at which it may be cut. Left out is what lies so close to the end
    that more text could move it (unless that is the ``whole`` text's end), and the end of white space: a run of it would
    be one pre-token if nothing followed."""
    last = end - start - (0 if whole and end == len(text) else LOOKAHEAD)
    places = (start + s for s in pre_token_starts(text[start:end], pattern) if s <= last)
    return [p for p in places if p == 0 or not (_white(text[p - 1]) and not _white(text[p]))]


def stitch(text: str, pattern: str = PATTERN, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, whole: bool = True) -> tuple[list[int], list[int]]:
    """Boundaries at which the chunks of a text fall into step (0 first), and the boundaries known past the last chunk's
    start. A chunk that shares none with the overlap before it is taken together with what precedes it, from the last
    boundary known, over a stretch twice as long each time."""
    cuts, width, at, n = [0], chunk, chunk, len(text)
    known = cut_places(text, 0, min(n, chunk + overlap), pattern, whole)
    while at < n:
        mine = cut_places(text, at, min(n, at + chunk + overlap), pattern, whole)
        before = {p for p in known if p >= at}
        meet = next((p for p in mine if p <= at + overlap and p in before), None)
        if meet is None:
            width *= 2
            at = cuts[-1] + width
            known = cut_places(text, cuts[-1], min(n, at + overlap), pattern, whole)
        else:
            cuts.append(meet)
            known = [p for p in mine if p >= meet]
            width, at = chunk, at + chunk
    return cuts, known


def _encode_rows(vocabulary: Broadcast, text: str, keep: list[str], pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value, pattern).encode_ordinary

        def ids_of(t: str | None) -> list[int]:
            # ids of lone surrogates cannot arise: Arrow strings are valid UTF-8
            if not t:
                return []
            cuts = stitch(t, pattern, chunk, overlap)[0]
            if len(cuts) == 1:
                return encode(t)
            return [i for a, b in zip(cuts, [*cuts[1:], len(t)]) for i in encode(t[a:b])]

        for batch in batches:
            ids = pa.array([ids_of(t) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], [*keep, "ids"])

    return run


def _cut(block: int, overlap: int):
    """Kernel: a row per block with its number and text, each reaching ``overlap`` characters into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for s in range(0, len(text), block):
                    cols = [pa.array([key], pa.string()), pa.array([s // block], pa.int64()), pa.array([s + block + overlap >= len(text)]), pa.array([text[s : s + block + overlap]], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "i", "last", "piece"])

    return run


def _edges(block: int, block_overlap: int, pattern: str, chunk: int, overlap: int):
    """Kernel: the boundaries in a block's first and last ``block_overlap`` characters, and whether some place before
    the latter is a boundary for sure: where white space follows anything else, since no pre-token goes on so."""
    import re

    sure_place = re.compile(r"[^\s\x1c-\x1f](?=[ \n])")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, sure = [], [], []
            for i, last, piece in zip(*(batch.column(c).to_pylist() for c in ("i", "last", "piece"))):
                place = sure_place.search(piece)
                known = stitch(piece, pattern, chunk, overlap, last)[1]
                head = cut_places(piece, 0, min(len(piece), 2 * block_overlap), pattern, last)
                heads.append([s + i * block for s in head if s and s <= block_overlap])
                tails.append([s + i * block for s in known if block <= s])
                sure.append(place is not None and place.end() <= block)
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("i"), pa.array(heads, long_list), pa.array(tails, long_list), pa.array(sure, pa.bool_())], ["key", "i", "head", "tail", "sure"])

    return run


def _encode_long(long: DataFrame, id_type: str, vocabulary: Broadcast, pattern: str, chunk: int, overlap: int, block: int, block_overlap: int) -> DataFrame:
    """(doc_id, ids) of texts longer than a block. Only boundaries pass through a window per text, never its characters.
    Blocks that do not fall into step (runs longer than the overlap without any boundary) are encoded as one."""
    texts = long.groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = cut_lineage(texts.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")))
    pieces = texts.select("key", "text").mapInArrow(_cut(block, block_overlap), "key string, i long, last boolean, piece string").repartition("key", "i")
    ends = pieces.mapInArrow(_edges(block, block_overlap, pattern, chunk, overlap), "key string, i long, head array<long>, tail array<long>, sure boolean")
    w = Window.partitionBy("key").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    meet = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w))))
    s = ends.withColumn("meet", meet)
    # in step: they share a boundary, and so did all blocks since the last one that holds a sure one, or the start
    s = s.withColumn("firm", F.coalesce(F.max(F.when(F.col("sure") | (F.col("i") == 0), F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("broken", F.coalesce(F.max(F.when(F.col("meet").isNull(), F.col("i"))).over(upto), F.lit(-1)))
    s = s.withColumn("at", F.when((F.col("i") == 0) | (F.col("meet").isNotNull() & (F.col("broken") <= F.col("firm"))), F.col("meet")))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    s = s.withColumn("group", F.max(F.when(F.col("at").isNotNull(), F.col("i"))).over(upto)).withColumn("to", F.first("at", ignorenulls=True).over(after)).withColumn("joined", F.col("at").isNull()).withColumn("next_joined", F.coalesce(F.lead("joined").over(w), F.lit(False)))
    places = s.select("key", "i", "group", "at", "to", "next_joined")
    start = F.coalesce(F.col("at"), F.col("i") * block)
    end = F.when(F.col("next_joined"), (F.col("i") + 1) * block).otherwise(F.coalesce(F.col("to"), F.lit((1 << 31) - 1 + block) + F.col("i") * block))
    part = F.substring(F.col("piece"), (start - F.col("i") * block + 1).cast("int"), F.least(end - start, F.lit((1 << 31) - 1)).cast("int"))
    parts = pieces.join(places, ["key", "i"]).select("key", "group", "i", part.alias("part"))
    whole = parts.groupBy("key", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("part"))
    encoded = whole.mapInArrow(_encode_rows(vocabulary, "part", ["key", "group"], pattern, chunk, overlap), "key string, group long, ids array<int>")
    joined = encoded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group", "ids"))), lambda x: x["ids"])).alias("ids"))
    return texts.select("key", "doc_id", "copies").join(joined, "key").select("doc_id", F.explode(F.array_repeat("ids", F.col("copies").cast("int"))).alias("ids"))


def encode_corpus(
    docs: DataFrame, text: str = "text", tokenizer_dir: str = DEFAULT_DIR, name: str = BYTE_BPE_50K, pattern: str = PATTERN,
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, block: int = BLOCK_CHARS, block_overlap: int = BLOCK_OVERLAP,
) -> DataFrame:
    """(doc_id, ids) of every row, without special tokens; their strings in a text are ordinary text. Null and empty
    texts give an empty list; repeated rows each give a row. Every text is encoded by chunks; the chunks of a text of one
    block are stitched where they are, only the blocks of longer texts are shuffled."""
    vocabulary = ship_vocabulary(docs, tokenizer_dir, name)
    rows = docs.select("doc_id", F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    short = rows.where(F.col("text").isNull() | (F.length("text") <= block)).mapInArrow(_encode_rows(vocabulary, "text", ["doc_id"], pattern, chunk, overlap), f"doc_id {kind}, ids array<int>")
    long = rows.where(F.length("text") > block)
    if long.isEmpty():
        return short
    return short.unionByName(_encode_long(long, kind, vocabulary, pattern, chunk, overlap, block, block_overlap))


def decode_ids(encoded: DataFrame, tokenizer_dir: str = DEFAULT_DIR, name: str = BYTE_BPE_50K, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text): the raw bytes of the ids, concatenated. Null ids give null."""
    vocabulary = ship_vocabulary(encoded, tokenizer_dir, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoding(vocabulary.value, pattern).decode_bytes
        for batch in batches:
            texts = [None if ids is None else decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
