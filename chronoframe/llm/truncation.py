"""Text cut off by field limits or in transfer.

Per source, a log-normal length distribution is fitted by maximum likelihood, right-censored at each candidate limit:
a text that stops at the limit only says that its whole length is larger. The fit gives each length near the limit a
posterior of being censored. As odds, that is multiplied by the likelihood ratios of how the text ends: mid-sentence,
with a mark, inside a word, as a title does; a text is cut if the odds are above one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.session import cut_lineage, small_enough

#: A limit that cuts at a word or trims what it cut leaves lengths up to this much below it.
ZONE = 12
#: Least gain in log-likelihood for a limit (half of it by counts alone), least open-ended texts in its zone.
LEAST_GAIN, LEAST_OPEN = 8.0, 3
#: A limit stops at least this share of what would be longer; what stops less is a habit of length, such as of titles.
LEAST_STOPPED = 0.1
STRAY, MOST_ODDS = 0.03, 6.0

SOUND, LINE, MARK, NOISE, OPEN = "sound", "line", "mark", "noise", "open"

#: Odds of a cut in transfer, at any length, against one at a limit, and likelihood ratio, by ending class. An open end
#: is what a cut leaves, so alone it decides nothing; a mark may be the writer's own; the others are cuts only at a limit.
TRANSFER = {OPEN: 1 / 400, MARK: 0.1, LINE: 0.0, NOISE: 0.0}
RATIO = {OPEN: 400.0, MARK: 1.0, LINE: 1 / 9, NOISE: 1.0}
#: Log likelihood ratios: a whole sentence before the open end, a broken character, clauses in what has no sentence.
SENTENCE, BROKEN, CLAUSE = 12.0, 20.0, 3.0
#: Share of cuts that fall inside a word.
INSIDE = 0.5
SALTS = 16

# What sentences end with, what may follow that, and what a cut is marked with.
STOPS = ".!?\u3002\uff01\uff1f\uff61\uff0e\u203c\u2047\u2048\u2049\u061f\u0964"
CLOSERS = "\"'\u201d\u201c\u201e\u00bb\u00ab\u2019\u2018\u201b\u203a\u2039)]}\u300d\u300f\uff09\u3011\u3009\u300b*_"
OPENERS = "\u201c\u00ab\u201e\u201a\u00bf\u00a1([{"
AFTER_STOP = "\"'\u201d\u201c\u2019\u00bb)]\u300d\u300f\uff09"
LINE_ENDS = ";:\uff1b\uff1a"
DOTS = "\u2026\u22ef"
BROKEN_CHARACTER = "\ufffd"
CLAUSE_SIGNS = ",;\uff0c\u3001\u2014\u201c\u201d\u00ab\u00bb\u201e"
BRACKETS = {"[": "]", "(": ")"}

_SPACES = "".join(chr(i) for i in range(0x3001) if unicodedata.category(chr(i)) in ("Zs", "Zl", "Zp")) + "\t\n\x0b\x0c\r"
_TRAIL = _SPACES + "".join(chr(i) for i in range(0xA0) if unicodedata.category(chr(i)) == "Cc")
_CLOSE = CLOSERS + _SPACES
_STOP_SPACE = re.compile(f"[{re.escape(STOPS)}][{re.escape(CLOSERS)}]*+[{re.escape(_SPACES)}]")
_CJK_STOP = re.compile("[\u3002\uff01\uff1f].")
_CLAUSE = re.compile(f"[{CLAUSE_SIGNS}]")
_TAG = re.compile(r"<\|[A-Za-z0-9_]+\|>|</?[A-Za-z0-9_]{1,12}>|\[[A-Z]{2,10}\]")
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"


def _is_cjk(c: str) -> bool:
    return "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or c in "\u3005\u3007" or "\U00020000" <= c <= "\U0003ffff"


def _in_word(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] in "LMN"


def _noise_start(t: str) -> int:
    """Where the end without words begins: everything after it is neither letter nor digit, or a tag."""
    i = len(t)
    while i:
        c = t[i - 1]
        if c in ">]":
            # the tag's start is looked for among what a tag may hold, which is also passed over only once
            start = i - 1
            while start and (t[start - 1].isascii() and (t[start - 1].isalnum() or t[start - 1] in "_|/")):
                start -= 1
            if start and t[start - 1] in "<[" and _TAG.fullmatch(t, start - 1, i):
                i = start - 1
                continue
        if c.isalnum():
            break
        i -= 1
    return i


def _stop_then_space(t: str, start: int) -> bool:
    m = _STOP_SPACE.search(t, start)
    return m is not None


def ending(text: str) -> tuple | None:
    """(kind, characters, bytes, opening word, last word, whole sentence before the end, clauses, broken end) of a text;
    None if it is blank. Every step passes over the text, or its end, once."""
    t = text.rstrip(_TRAIL)
    if not t:
        return None
    u = t.rstrip(_CLOSE)
    body = text.rstrip(BROKEN_CHARACTER)
    broken = t[-1] == BROKEN_CHARACTER
    dots = len(u) - len(u.rstrip("."))
    one = u[-1:] in DOTS and bool(u)
    mark = one or dots >= 3
    before = u[:-1] if one else u[: len(u) - dots] if dots >= 2 else u
    if (one or dots >= 2) and before:
        inner = before.rstrip(" \t\n\x0b\x0c\r")
        after = t[len(u) :].lstrip(" \t\n\x0b\x0c\r")
        if inner and inner[-1] in BRACKETS and after[:1] == BRACKETS[inner[-1]]:
            mark, before = True, inner[:-1]
    if mark:
        body = before.rstrip(_SPACES)
    opened = t.rstrip(OPENERS)
    spaced = opened.rstrip(_SPACES)
    if mark:
        kind = SOUND if body.rstrip(_CLOSE)[-1:] in STOPS and body.rstrip(_CLOSE) else MARK
    elif len(spaced) < len(opened) < len(t) and (x := spaced.rstrip(AFTER_STOP)) and x[-1] in STOPS:
        kind = NOISE  # the next sentence has only begun
    elif u and u[-1] in STOPS:
        kind = SOUND
    elif t[-1] in LINE_ENDS:
        kind = LINE
    elif not broken and _stop_then_space(t, _noise_start(t)):
        kind = NOISE
    else:
        kind = OPEN
    n, i = len(t), 0
    while i < n and not t[i].isalnum():
        i += 1
    if i < n and _is_cjk(t[i]):
        head = t[i : i + 2]
    else:
        j, digits = i, i < n and not t[i].isalpha()
        while j < n and ((t[j].isalnum() and not t[j].isalpha()) if digits else (t[j].isalpha() or unicodedata.category(t[j])[0] == "M")):
            j += 1
        head = t[i:j].lower()
    j = len(body)
    while j and not _in_word(body[j - 1]):
        j -= 1
    k = j
    while k and _in_word(body[k - 1]):
        k -= 1
    m = _STOP_SPACE.search(body)
    sentence = (m is not None and m.end() < len(body.rstrip(_SPACES))) or _CJK_STOP.search(body) is not None
    return kind, len(body), len(body.encode("utf-8", "replace")), head, body[k:j].lower(), sentence, _CLAUSE.search(body) is not None, broken


def endings(docs: DataFrame) -> DataFrame:
    """Per text that is neither null nor blank: its ending class, its length in characters and bytes without a mark or
    broken last character, its opening word, its last word and whether a whole sentence comes before the end."""
    names = ["kind", "chars", "bytes", "head", "tail", "sentence", "clause", "broken"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ending(t) for t in batch.column("text").to_pylist()]
            some = pa.array([i for i, e in enumerate(found) if e is not None], pa.int64())
            cols = list(zip(*(e for e in found if e is not None))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(some) for c in ("doc_id", "source")] + [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "source", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null").select("doc_id", F.col("source").cast("string"), "text").mapInArrow(
        run, f"doc_id {kind}, source string, kind string, chars long, bytes long, head string, tail string, sentence boolean, clause boolean, broken boolean"
    )


def _log_cdf(z: np.ndarray) -> np.ndarray:
    return np.log(np.maximum([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], 1e-300))


def _mass(length: np.ndarray, mu: float, sigma: float) -> np.ndarray:
    """Log of the log-normal's share of each whole length, by its density there."""
    z = (np.log(length) - mu) / sigma
    return -0.5 * z * z - np.log(length * sigma * math.sqrt(2 * math.pi))


def fit_censored(length: np.ndarray, n: np.ndarray, limit: float, n_cut: float) -> tuple[float, float, float]:
    """Maximum likelihood of a log-normal given observed lengths (with counts) and ``n_cut`` texts longer than
    ``limit``: (mu, sigma, log-likelihood), by expectation-maximisation."""
    x = np.log(length)
    total = n.sum() + n_cut
    mu = float((n * x).sum() / max(n.sum(), 1e-9)) if n.sum() else math.log(limit)
    sigma = max(0.1, float(np.sqrt((n * (x - mu) ** 2).sum() / max(n.sum(), 1e-9)))) if n.sum() else 0.5
    edge = math.log(limit)
    for _ in range(200):
        z = (edge - mu) / sigma
        upper = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)
        ratio = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / upper
        mean_cut = mu + sigma * ratio
        var_cut = sigma * sigma * max(0.0, 1 + z * ratio - ratio * ratio)
        new = float(((n * x).sum() + n_cut * mean_cut) / total)
        var = float(((n * (x - new) ** 2).sum() + n_cut * (var_cut + (mean_cut - new) ** 2)) / total)
        done = abs(new - mu) < 1e-7
        mu, sigma = new, max(0.05, math.sqrt(var))
        if done:
            break
    tail = float(_log_cdf(np.array([(mu - edge) / sigma]))[0])
    return mu, sigma, float((n * _mass(length, mu, sigma)).sum() + n_cut * tail)


def source_limit(length: np.ndarray, n_all: np.ndarray, n_open: np.ndarray) -> tuple[float, int | None, dict[int, float]]:
    """(gain, limit, posterior by length) of one source's lengths in one unit. ``n_open`` counts open-ended texts, with
    or without a mark.

    Candidates are all lengths that open-ended texts have, and the longest, where more of them end within the zone than
    the source's lengths lead to expect. Texts longer than a candidate count against it: the likelihood has the split of
    what is longer into stopped and passed, so a limit may hold for a part of a source, and be one of several. All limits
    that gain enough count in the posterior, the better first, none in another's zone; the limit and gain returned are
    the best one's."""
    order = np.argsort(length)
    length, n_all, n_open = length[order].astype(float), n_all[order].astype(float), n_open[order].astype(float)
    usable = length > 0
    length, n_all, n_open = length[usable], n_all[usable], n_open[usable]
    if not n_open.sum():
        return 0.0, None, {}
    mu, sigma, base = fit_censored(length, n_all, float(length[-1]), 0.0)
    candidates = np.unique(np.append(length[n_open > 0], length[-1]))
    upto = np.append(0, np.cumsum(n_open))
    inside = upto[np.searchsorted(length, candidates, side="right")] - upto[np.searchsorted(length, candidates - ZONE, side="right")]
    share = np.exp(_log_cdf((np.log(candidates) - mu) / sigma)) - np.exp(_log_cdf((np.log(np.maximum(candidates - ZONE, 1e-9)) - mu) / sigma))
    expected = np.maximum(n_open.sum() * share, 1e-9)
    excess = inside * np.log(np.maximum(inside, 1e-9) / expected) - (inside - expected)
    tried: list[tuple[float, int, dict[int, float]]] = []
    for c in candidates[(inside >= LEAST_OPEN) & (inside > expected) & (excess > LEAST_GAIN / 2)]:
        over = float(n_all[length > c].sum())
        zone = (length > c - ZONE) & (length <= c)
        cut = float(n_open[zone].sum())
        if cut < LEAST_STOPPED * (over + cut):
            continue
        rest = n_all - np.where(zone, n_open, 0)
        mu, sigma, like = fit_censored(length, rest, float(c), cut)
        share = (n_open[zone] + 0.5 / ZONE) / (cut + 0.5)
        like += float((n_open[zone] * np.log(share)).sum())
        if over:
            like += over * math.log(over / (over + cut)) + cut * math.log(cut / (over + cut))
        stopped = cut / (over + cut)
        at_limit = stopped * math.exp(float(_log_cdf(np.array([(mu - math.log(c)) / sigma]))[0]))
        free = np.exp(_mass(length[zone], mu, sigma)) * max(n_open[~zone].sum() / max(n_all[~zone].sum(), 1), 1e-3)
        posterior = at_limit * share / (at_limit * share + free)
        tried.append((like - base, int(c), {int(x): float(p) for x, p, o in zip(length[zone], posterior, n_open[zone]) if o > 0}))
    tried.sort(key=lambda t: -t[0])
    kept: list[int] = []
    near: dict[int, float] = {}
    for gain, c, posterior in tried:
        if gain > LEAST_GAIN and all(abs(c - k) >= ZONE for k in kept):
            kept.append(c)
            near |= posterior
    return max(0.0, tried[0][0] if tried else 0.0), kept[0] if kept else None, near


def source_limits(ends: DataFrame) -> DataFrame:
    """Per source: unit (``chars`` or ``bytes``), field limit (null if none shows), gain in log-likelihood, the censoring
    posterior by length near the limit, and whether most of what is cut there bears a mark. Lengths are counted per source before they leave the executors'
    map side; a source's table of lengths is as long as its longest text at most."""
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")
    counts = (
        ends.select("source", "kind", unit)
        .groupBy("source", "u.unit", "u.length")
        .agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin(OPEN, MARK)).alias("n_open"), F.count_if(F.col("kind") == MARK).alias("n_mark"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for unit, g in pdf.groupby("unit"):
            found[unit] = source_limit(g["length"].to_numpy(), g["n"].to_numpy(), g["n_open"].to_numpy())
        unit = max(found, key=lambda u: (found[u][0], u == "chars"))
        gain, limit, posterior = found[unit]
        near = pdf[(pdf["unit"] == unit) & pdf["length"].isin(list(posterior))]
        marks = bool(near["n_mark"].sum() * 2 > near["n_open"].sum())
        return pd.DataFrame({"source": [pdf["source"].iloc[0]], "unit": [unit], "field_limit": pd.array([limit], "Int64"), "gain": [gain], "posterior": [posterior], "marks": [marks]})

    return counts.groupBy("source").applyInPandas(fit, "source string, unit string, field_limit long, gain double, posterior map<long,double>, marks boolean")


def _heads(ends: DataFrame) -> DataFrame:
    """Per opening word the log-odds of "begins sentences" against "begins titles": all but ``STRAY`` of the texts a
    sentence word begins end soundly, all but ``STRAY`` of those a title word begins do not."""
    plain = ends.where((F.col("kind") == OPEN) & ~F.col("sentence") | (F.col("kind") == SOUND))
    by = plain.groupBy("head").agg(F.count_if(F.col("kind") == SOUND).alias("n_sound"), F.count_if(F.col("kind") == OPEN).alias("n_open"))
    odds = (F.col("n_sound") - F.col("n_open")) * math.log((1 - STRAY) / STRAY)
    return by.select("head", F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), odds)).alias("odds"))


def _is_word(tail: Column) -> Column:
    """Letters only, of a script that sets words apart."""
    return tail.rlike(r"^[\p{L}\p{M}]+$") & ~tail.rlike(_CJK)


def _last_words(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words that soundly ended texts end with, and how often such a word is new: a marked text that ends in no such
    word was likely cut inside one."""
    seen = ends.where((F.col("kind") == SOUND) & _is_word(F.col("tail"))).groupBy("tail").agg(F.count("*").alias("n"))
    rate = seen.agg(F.coalesce(F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")), F.lit(1.0)).alias("new_rate"))
    return seen.select("tail", F.lit(True).alias("known")), rate


def _with_words(df: DataFrame, words: DataFrame, word: str) -> DataFrame:
    """Left join with a table of words: broadcast if counted small, else salted, since words are as skewed as they come."""
    if small_enough(words, 100_000):
        return df.join(F.broadcast(words), word, "left")
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [word, "salt"], "left").drop("salt")


def judge_endings(docs: DataFrame) -> DataFrame:
    """Every text that does not end as a whole sentence does, with ``posterior`` (of having been cut) and ``cut``
    (posterior above one half). Null and blank texts have no ending; a null source is a source of its own; repeated rows
    are judged alike.

    The odds of having been stopped at the source's limit, given the length, plus those of a cut in transfer, which may
    fall anywhere, times the ratios of the evidence: an open end, after a whole sentence, with clauses, with an opening
    word that begins sentences rather than titles; a mark, in a word nobody ends with; a broken last character."""
    return _judge(cut_lineage(_placed(docs)))


def _placed(docs: DataFrame) -> DataFrame:
    return endings(docs).withColumn("source", F.coalesce("source", F.lit("\x01")))


def _judge(ends: DataFrame) -> DataFrame:
    limits = source_limits(ends)
    known, rate = _last_words(ends)
    loose = _with_words(ends.where(F.col("kind") != SOUND).join(limits, "source", "left"), cut_lineage(_heads(ends)), "head")
    loose = _with_words(loose, cut_lineage(known), "tail").join(F.broadcast(rate))  # one row
    length = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes")).cast("long")
    p = F.coalesce(F.try_element_at("posterior", length), F.lit(0.0))
    by_kind = lambda table: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in table.items()))
    unknown = F.col("known").isNull() & _is_word(F.col("tail"))
    inside = F.when(unknown, F.greatest(F.lit(0.0), F.log(INSIDE / F.greatest(F.col("new_rate"), F.lit(1e-4))))).otherwise(0.0)
    evidence = (
        F.when(F.col("kind") == OPEN, F.coalesce("odds", F.lit(0.0)) + F.when(F.col("sentence"), SENTENCE).otherwise(0.0) + F.when(F.col("clause"), CLAUSE).otherwise(0.0))
        .when(F.col("kind") == MARK, inside)
        .when((F.col("kind") == LINE) & F.col("marks"), F.lit(-SENTENCE))  # what is cut there bears a mark
        .otherwise(0.0)
    )
    odds = p / F.greatest(1 - p, F.lit(1e-9)) + by_kind(TRANSFER)
    log_odds = F.log(F.greatest(odds, F.lit(1e-12))) + F.log(by_kind(RATIO)) + evidence + F.when(F.col("broken"), BROKEN).otherwise(0.0)
    loose = loose.withColumn("log_odds", F.when(F.col("broken"), F.greatest(log_odds, F.lit(BROKEN))).otherwise(log_odds))
    posterior = 1 / (1 + F.exp(-F.col("log_odds")))
    return loose.select("doc_id", F.when(F.col("source") != "\x01", F.col("source")).alias("source"), "kind", posterior.alias("posterior"), (F.col("log_odds") > 1e-9).alias("cut"))


def truncated(docs: DataFrame) -> DataFrame:
    """The cut documents."""
    return judge_endings(docs).where("cut").select("doc_id", "source").distinct()


def truncation_rates(docs: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, rate, and the field limit with its unit where one shows."""
    ends = cut_lineage(_placed(docs))
    cut = _judge(ends).where("cut").groupBy(F.coalesce("source", F.lit("\x01")).alias("source")).agg(F.count("*").alias("n_cut"))
    n = ends.groupBy("source").agg(F.count("*").alias("n_texts"))
    limits = source_limits(ends).select("source", "field_limit", F.when(F.col("field_limit").isNotNull(), F.col("unit")).alias("unit"))
    r = n.join(cut, "source", "left").join(limits, "source", "left").withColumn("n_cut", F.coalesce("n_cut", F.lit(0)))
    return r.select(F.when(F.col("source") != "\x01", F.col("source")).alias("source"), "n_texts", "n_cut", (F.col("n_cut") / F.col("n_texts")).alias("rate"), "field_limit", "unit")
