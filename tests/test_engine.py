import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import dedup as dd
from chronoframe.operators import filters, grouping, ordering, series
from chronoframe.operators.ring import Ring
from chronoframe.schema import MINUTE_NS, DuplicateDetected
from tests.makers import BASE, frame, frames_df

SEC = 1_000_000_000


def _series(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "seq long, tm_ns long")


def _brute(times, probe, strict, tie):
    order = sorted(range(len(times)), key=lambda i: (times[i], i))
    probe -= probe % 8
    ok = [k for k, i in enumerate(order) if (times[i] < probe if strict else times[i] <= probe)]
    if not ok:
        return "InPast", -1
    t = times[order[ok[-1]]]
    tied = [k for k in ok if times[order[k]] == t]
    return "InFuture" if probe > max(times) else "Avail", tied[-1] if tie == "last" else tied[0]


@pytest.mark.parametrize("reps", [[5, 5, 5, 5], [1, 2, 1, 2], [1, 1, 1, 1], [1], [1, 1]])
def test_asof_repeats(spark, reps):
    times = [BASE + i * SEC for i, n in enumerate(reps) for _ in range(n)]
    probes = sorted({t + x for t in times for x in (-10, 0, 10, SEC // 2)})
    p = spark.createDataFrame([(t,) for t in probes], "tm_ns long")
    for strict in (True, False):
        for tie in ("last", "first"):
            got = {r.tm_ns: (r.status, r["index"]) for r in series.asof(p, _series(spark, times), strict=strict, tie=tie, bucket_ns=2 * SEC).collect()}
            assert got == {t: _brute(times, t, strict, tie) for t in probes}


def test_asof_gaps_between_ties(spark):
    s = _series(spark, [16, 16, 72])
    p = spark.createDataFrame([(24,)], "tm_ns long")
    assert series.first_at_or_before(p, s).collect()[0]["index"] == 0
    assert series.last_at_or_before(p, s).collect()[0]["index"] == 1
    s = _series(spark, [8, 64])
    p = spark.createDataFrame([(40,)], "tm_ns long")
    assert series.last_at_or_before(p, s).collect()[0]["index"] == 0


def test_asof_keys_nulls_empty(spark):
    s = spark.createDataFrame([(0, 8, "a", 1), (1, 16, "b", 2), (2, None, "a", 3), (3, 24, None, 4)], "seq long, tm_ns long, k string, status int")
    p = spark.createDataFrame([(16, "a", 0), (16, "b", 0), (16, "c", 0), (None, "a", 0), (32, None, 0), (16, "a", 0)], "tm_ns long, k string, index_ int")
    got = sorted((str(r.tm_ns), str(r.k), r.f_seq, r.f_status, r.status) for r in series.asof(p, s, ["k"], bucket_ns=8).collect())
    assert got == [("16", "a", 0, 1, "InFuture"), ("16", "a", 0, 1, "InFuture"), ("16", "b", 1, 2, "Avail"), ("16", "c", None, None, "InPast"), ("32", "None", 3, 4, "InFuture"), ("None", "a", None, None, "InPast")]
    none = series.asof(p, s.where("false"), ["k"]).collect()
    assert len(none) == 6 and {r.status for r in none} == {"InPast"}
    assert series.asof(p.where("false"), s, ["k"]).count() == 0


def test_dedup_windows(spark):
    rng = random.Random(3)
    rows = [(i, bytes([rng.randrange(12)])) for i in range(400)]
    for window in (2, 7, 401):
        expected = [i for i, k in rows if k not in [x for _, x in rows[max(0, i - window) : i]]]
        keep, dups = dd.dedup(spark.createDataFrame(rows, "seq long, raw binary"), window)
        assert sorted(r.seq for r in keep.collect()) == expected
        assert dups.count() == 400 - len(expected)
    with pytest.raises(ValueError):
        dd.dedup(spark.createDataFrame(rows, "seq long, raw binary"), 1)


def test_duplicate_detected(spark):
    a, b = frame(BASE, 2, 1.0), frame(BASE + SEC, 2, 2.0)
    dd.require_unique(frames_df(spark, [("s", "x", a), ("s", "x", b)]))
    with pytest.raises(DuplicateDetected, match="000002 "):
        dd.require_unique(frames_df(spark, [("s", "x", a), ("s", "x", b), ("s", "x", a)]))


def test_merge_of_dealt_piles(spark):
    rng = random.Random(1)
    rows = [(i, BASE + i * 8) for i in range(100)]
    piles = [[] for _ in range(5)]
    for r in rows:
        piles[rng.randrange(5)].append(r)
    dfs = [spark.createDataFrame([(k, t, i) for k, (i, t) in enumerate(p)], "seq long, tm_ns long, number long") for p in piles]
    for presorted in (True, False):
        assert [r.number for r in ordering.merge(*dfs, presorted=presorted).collect()] == list(range(100))


def test_merge_by_heads(spark):
    rng = random.Random(4)
    piles = [[rng.randrange(50) * 8 for _ in range(30)] for _ in range(3)]
    heads, expected = [0] * 3, []
    while any(h < 30 for h in heads):
        k = min((i for i in range(3) if heads[i] < 30), key=lambda i: (piles[i][heads[i]], i))
        expected.append((k, heads[k]))
        heads[k] += 1
    dfs = [spark.createDataFrame(list(enumerate(p)), "seq long, tm_ns long") for p in piles]
    assert [(r.source_ord, r.seq) for r in ordering.merge(*dfs, presorted=False).collect()] == expected


def test_rank_and_running_max(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, v long").repartition(7)
    got = {r.seq: r.run_max for r in ordering.running_max(df, "v", "seq", bucket_rows=16).collect()}
    assert got == {i: max(v for _, v in rows[: i + 1]) for i in range(300)}
    rank = {r.seq: r["rank"] for r in ordering.ranked(df, "v", "seq").collect()}
    assert rank == {s: k for k, (s, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert ordering.slice_frames(df, 10, 5).count() == 5 and ordering.slice_frames(df, 290).count() == 10 and ordering.slice_frames(df, 900, 5).count() == 0


def _count_brute(times, step):
    due, out, n = times[0] + step, [], 0
    for t in times:
        while t > due:
            out.append(n)
            n, due = 0, due + step
        n += 1
    return [*out, n]


def test_count_per(spark):
    rng = random.Random(6)
    times = [BASE + rng.randrange(900) * 8 for _ in range(60)]
    df = _series(spark, times).withColumn("k", F.lit("x"))
    for by in ([], ["k"]):
        got = [r.n for r in grouping.count_per(df, 400, by).orderBy("window").collect()]
        assert got == _count_brute(times, 400)
    assert grouping.count_per(df.where("false"), 400).count() == 0


def _index_brute(times, step):
    due, out = None, []
    for i, t in enumerate(times):
        if due is None or t > due:
            out.append(i)
            due = t - t % step + step
    return out


def test_time_index(spark):
    rng = random.Random(7)
    times = {s: [BASE + rng.randrange(40) * MINUTE_NS // 4 for _ in range(700)] for s in "ab"}
    times["c"] = sorted(times["a"])
    df = spark.createDataFrame([(s, i, t, i * 16) for s, ts in times.items() for i, t in enumerate(ts)], "source_id string, seq long, tm_ns long, byte_offset long")
    got = {s: [] for s in times}
    for r in grouping.time_index(df).orderBy("source_id", "seq").collect():
        got[r.source_id].append(r.seq)
        assert r.byte_offset == r.seq * 16
    assert got == {s: _index_brute(ts, MINUTE_NS) for s, ts in times.items()}
    assert grouping.index_frames(grouping.time_index(df)).select("pti").distinct().collect()[0][0] == 1


def test_filters(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "i int, t string")
    ids = lambda **k: [r.i for r in filters.filter_regex(df, ["a", "b"], text=F.col("t"), **k).orderBy("i").collect()]
    assert ids() == [1] and ids(match_any=True) == [1, 2, 3] and ids(exclude=True) == [2, 3, 4, 5] and ids(match_any=True, exclude=True) == [4, 5]
    assert filters.filter_regex(df, ["x*"], text=F.col("t")).count() == 0
    with pytest.raises(ValueError):
        filters.filter_regex(df, [])


def test_grep_fields(spark):
    lines = ['{"op":"seal","n":5}', r'x \"op\":\"drop\" y', "nothing 100% {}", None]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    assert sorted((r.field, r.found) for r in filters.grep_fields(df, "op", "n").collect()) == [("n", "5"), ("op", '"seal"'), ("op", "drop")]


def test_last_n_and_ring(spark):
    df = _series(spark, [1, 2, 3, 4])
    got = {r.seq: [x.tm_ns for x in r.last] for r in ordering.last_n(df, 2).collect()}
    assert got == {0: [1], 1: [1, 2], 2: [2, 3], 3: [3, 4]}
    ring = Ring(3)
    assert ring.write([1, 2, 3, 4]) == 3 and ring.free == 0 and ring.write([5]) == 0
    assert ring.peek(2) == [1, 2] and ring.read(2) == [1, 2] and ring.first() == ring.last() == 3
    assert ring.kth(1) is None and ring.next_place(0) is None and ring.legal_place(0) and not ring.legal_place(1)
    ring.adopt([7, 8, 9, 10])
    assert ring.capacity == 4 and ring.previous_place(1) == 0 and ring.advance(9) == 4
    with pytest.raises(EOFError):
        ring.read(1)


def test_payload_grep_searches_all_text(spark, tmp_path):
    import __spark_entry__ as entry

    hit = b'{"lsn": 7}'
    rows = [(e, hit) for e in (-1, 12, 13, 14, 2000, 2101, 3003, 9999)] + [(14, b'\xff"lsn":8'), (14, b'{"lsn":"x"}'), (9, hit), (16, hit), (1999, hit), (10000, hit), (14, None)]
    f = spark.createDataFrame([("s", i, e, p and bytearray(p)) for i, (e, p) in enumerate(rows)], "source_id string, seq long, evtnum int, payload binary")
    f.write.parquet(f"{tmp_path}/frames.parquet")
    got = sorted((r.seq, r.lsn) for r in entry.queries()["payload_grep"](spark, str(tmp_path)).collect())
    assert got == [(i, "7") for i in range(8)] + [(8, "8")]
    con = pytest.importorskip("duckdb").connect()
    con.sql(f"create view frames as select * from '{tmp_path}/frames.parquet/*.parquet'")
    assert sorted(con.sql(f"select seq, lsn from ({entry.oracle_sql()['payload_grep']})").fetchall()) == got


@pytest.mark.parametrize(
    "any_,exclude,want",
    [(False, False, {0: "x 1"}), (True, False, {0: "a", 1: "a", 2: "y 2"}), (False, True, {}), (True, True, {})],
)
def test_sub_prints_the_pattern_tested_last(spark, any_, exclude, want):
    """All: the last pattern, where the others match. Any: the first that matches. Excluded frames end on a miss."""
    f = spark.createDataFrame([(0, "a x1"), (1, "a"), (2, "y2"), (3, "none"), (4, None)], "seq long, line string")
    got = filters.filter_sub(f, ["(a)", "([xy])([0-9])"], any_, exclude, F.col("line"))
    assert {r.seq: r["sub"] for r in got.collect()} == want


def test_v1_is_set_where_both_numbers_are(spark):
    from chronoframe.functions import frames as ff
    from tests.makers import BASE, frame, frames_df

    f = frames_df(spark, [("s", "a", frame(BASE, e, 1.5, 7)) for e in (1, 2, 3)])
    got = ff.set_v1(f, F.lit(9)).select("v1", ff.decode_raw("raw").alias("r")).select("v1", F.col("r.v1").alias("w")).collect()
    assert [tuple(r) for r in got] == [(7, 7), (None, None), (9, 9)]
