"""Evaluation texts leaking into training text: an FM-index per training shard, searched for all test phrases."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.fm_index import FMIndex

PHRASE_WORDS = 10
SHARD_WORDS = 1 << 19
#: Bytes of item texts that go to the tasks at once.
ITEM_BYTES = 64 << 20
OTHER = 1  # the symbol of words no item has, and of the place between two documents

_WORD = re.compile(r"[^\W_]+")
_HIDDEN: re.Pattern | None = None
_SPANS = "doc_id long, item_id long, first_word long, last_word long"


def _hidden() -> re.Pattern:
    """Format characters (zero-width, soft hyphen, direction marks), joiners and variation selectors."""
    global _HIDDEN
    if _HIDDEN is None:
        extra = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)]
        codes = sorted({i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf"} | set(extra))
        _HIDDEN = re.compile("[" + "".join(map(re.escape, map(chr, codes))) + "]")
    return _HIDDEN


def words(text: str | None) -> list[str]:
    """Words of a text: HTML escapes resolved, invisible characters removed, NFKC, case folded; then the maximal
    sequences of letters and digits. Null gives none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _hidden().sub("", text))
    return _WORD.findall(text.casefold())


class Phrases:
    """All runs of ``size`` words of the items, as symbols of the items' own vocabulary."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = PHRASE_WORDS) -> None:
        self.code: dict[str, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            codes = [self.code.setdefault(w, len(self.code) + OTHER + 1) for w in words(text)]
            for i in range(len(codes) - size + 1):
                owners.setdefault(tuple(codes[i : i + size]), set()).add(item)
        self.sigma = len(self.code) + OTHER + 1
        self.rows = np.array(list(owners), np.int64).reshape(-1, size)
        self.owners = [sorted(x) for x in owners.values()]


def _search(phrases: Phrases, shard_words: int):
    size = phrases.rows.shape[1]

    def hits(ids: list, parts: list[np.ndarray], places: list[np.ndarray], of: list[int]) -> pa.RecordBatch:
        """Index one shard, search it for all phrases, merge overlapping hits into spans."""
        text = np.concatenate(parts)
        place = np.concatenate(places)
        doc = np.repeat(np.array(of), [len(p) for p in parts])
        index = FMIndex(text, phrases.sigma)
        lo, hi = index.search(phrases.rows)
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(found) else np.empty(0, np.int64)
        at = index.locate(rows)
        which = np.repeat(found, n)
        spans = sorted({(doc[p], item, int(place[p])) for p, w in zip(at.tolist(), which.tolist()) for item in phrases.owners[w]})
        out: list[list] = []
        for d, item, start in spans:
            if out and out[-1][0] == d and out[-1][1] == item and start <= out[-1][3] + 1:
                out[-1][3] = start + size - 1
            else:
                out.append([d, item, start, start + size - 1])
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array([ids[d] for d in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "item_id", "first_word", "last_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, places, of, n = [], [], [], [], 0
        get = phrases.code.get
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                codes = np.array([OTHER, *(get(w, OTHER) for w in words(text))], np.int64)
                known = codes > OTHER
                if known.sum() < size:
                    continue  # cannot hold a phrase
                keep = known.copy()
                keep[0] = True
                keep[1:] |= known[:-1]  # one OTHER stands for a run of them
                place = np.flatnonzero(keep)
                codes = codes[keep]
                ids.append(doc_id)
                for s in range(0, max(1, len(codes) - size + 1), shard_words):  # pieces of very long texts overlap
                    parts.append(codes[s : s + shard_words + size - 1] if s == 0 else np.append(OTHER, codes[s : s + shard_words + size - 1]))
                    places.append(place[s : s + shard_words + size - 1] - 1 if s == 0 else np.append(-1, place[s : s + shard_words + size - 1] - 1))
                    of.append(len(ids) - 1)
                    n += len(parts[-1])
                    if n >= shard_words:
                        yield hits(ids, parts, places, of)
                        ids, parts, places, of, n = [doc_id], [], [], [], 0
        if parts:
            yield hits(ids, parts, places, of)

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, size: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every stretch of at least ``size`` consecutive words of an item in a document: doc_id, item_id, first_word,
    last_word (counted from 0 in the document's words). Whole texts are searched; null and empty texts hold nothing,
    items shorter than ``size`` words leak nowhere, repeated documents are reported under their own id, a passage of
    two items counts for both.

    The documents are not shuffled: each task indexes its own rows in shards of about ``shard_words`` symbols. The
    stated items go to the tasks in blocks of about ``ITEM_BYTES`` of text, so what is sent stays bounded; each block is
    one pass over the documents. Spans of one item that touch are one, also across the shards of a long text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pool = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n_bytes = pool.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    blocks = max(1, math.ceil(n_bytes / ITEM_BYTES))
    out = None
    for b in range(blocks):
        part = pool.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pool
        phrases = Phrases([(r.item_id, r.text) for r in part.collect()], size)
        shipped = docs.sparkSession.sparkContext.broadcast(phrases)
        spans = rows.mapInArrow(lambda it, x=shipped: _search(x.value, shard_words)(it), _SPANS)
        out = spans if out is None else out.unionByName(spans)
    return merge_spans(out, "doc_id", "item_id").drop("items")


def merge_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Spans of equal ``by`` that overlap or touch become one: by, first_word, last_word, and the items (sorted)."""
    w = Window.partitionBy(*by).orderBy("first_word", "last_word", "item_id")
    before = F.max("last_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.withColumn("opens", F.coalesce(F.col("first_word") > before + 1, F.lit(True)))
    island = opens.withColumn("island", F.count_if("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy(*by, "island").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return out.drop("island")


def removal_spans(spans: DataFrame) -> DataFrame:
    """The stretches of words to remove from each document: spans of any items merged."""
    return merge_spans(spans, "doc_id")


def leaked_items(spans: DataFrame) -> DataFrame:
    """Which items leaked into which document."""
    return spans.select("doc_id", "item_id").distinct()
