"""Queries over the engine's own operators, each over its whole tables, with the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.adapters import frames_from_events
from chronoframe.functions import dates, paths
from chronoframe.functions import frames as ff
from chronoframe.functions import text as tx
from chronoframe.functions.times import floor_to, minute_floor
from chronoframe.operators import dedup as dd
from chronoframe.operators import filters, grouping, ordering, series
from chronoframe.plans.tables import table
from chronoframe.schema import HOUR_NS, MINUTE_NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_EV = """WITH ev AS (SELECT event_id AS seq, (epoch_us(ts) * 1000) & (-8) AS tm_ns, user_id, event_type AS stream_name, value AS v0, props FROM events)"""
_TIED = _EV + ", t AS (SELECT *, tm_ns - tm_ns % 3600000000000 AS tied FROM ev)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return frames_from_events(table(spark, d, "events"))


def _group_sql(ns: int) -> str:
    return f"""{_EV}, r AS (SELECT *, max(tm_ns) OVER (ORDER BY seq) AS m, first_value(tm_ns) OVER (ORDER BY seq) AS t0 FROM ev),
k AS (SELECT t0, greatest((m - t0 + {ns - 1}) // {ns} - 1, 0) AS k FROM r), c AS (SELECT k, count(*) AS n FROM k GROUP BY k),
w AS (SELECT unnest(range(0, (SELECT max(k) FROM k) + 1)) AS k)
SELECT w.k AS "window", (SELECT min(t0) FROM k) + (w.k + 1) * {ns} AS end_ns, coalesce(n, 0) AS n FROM w LEFT JOIN c ON c.k = w.k"""


@query(_group_sql(MINUTE_NS))
def group_per_minute(spark, d):
    return grouping.count_per(_events(spark, d))


@query(_group_sql(HOUR_NS))
def group_per_hour(spark, d):
    return grouping.count_per(_events(spark, d), HOUR_NS)


@query(f"""WITH r AS (SELECT source_id, seq, tm_ns, max(tm_ns) OVER (PARTITION BY source_id ORDER BY seq) AS m, first_value(tm_ns) OVER (PARTITION BY source_id ORDER BY seq) AS t0 FROM frames),
k AS (SELECT source_id, t0, greatest((m - t0 + {MINUTE_NS - 1}) // {MINUTE_NS} - 1, 0) AS k FROM r),
c AS (SELECT source_id, k, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT source_id, min(t0) AS t0, max(k) AS last FROM k GROUP BY ALL),
w AS (SELECT source_id, t0, unnest(range(0, last + 1)) AS k FROM s)
SELECT w.source_id, w.k AS "window", t0 + (w.k + 1) * {MINUTE_NS} AS end_ns, coalesce(n, 0) AS n FROM w LEFT JOIN c ON c.source_id = w.source_id AND c.k = w.k""")
def group_per_source(spark, d):
    return grouping.count_per(table(spark, d, "frames"), MINUTE_NS, ["source_id"])


@query(f"""WITH RECURSIVE idx AS (
SELECT source_id, seq, tm_ns, byte_offset, tm_ns - tm_ns % {MINUTE_NS} + {MINUTE_NS} AS due FROM frames WHERE seq = 0
UNION ALL SELECT source_id, seq, tm_ns, byte_offset, due FROM (
  SELECT f.source_id, f.seq, f.tm_ns, f.byte_offset, f.tm_ns - f.tm_ns % {MINUTE_NS} + {MINUTE_NS} AS due, row_number() OVER (PARTITION BY f.source_id ORDER BY f.seq) AS k
  FROM idx JOIN frames f ON f.source_id = idx.source_id AND f.seq > idx.seq AND f.tm_ns > idx.due) WHERE k = 1)
SELECT source_id, seq, tm_ns, byte_offset FROM idx""")
def index_minute(spark, d):
    return grouping.time_index(table(spark, d, "frames"))


def _asof_sql(strict: bool, tie: str, tied: bool) -> str:
    op, t = "<" if strict else "<=", "tied" if tied else "tm_ns"
    order = "s.seq DESC" if tie == "last" else "s.seq"
    return f"""{_TIED}, s AS (SELECT seq, {t} AS tm, user_id, row_number() OVER (PARTITION BY user_id ORDER BY {t}, seq) - 1 AS i FROM t WHERE stream_name <> 'purchase'),
m AS (SELECT user_id, max(tm) AS latest FROM s GROUP BY user_id), p AS (SELECT seq, {t} AS tm, user_id FROM t WHERE stream_name = 'purchase'),
j AS (SELECT p.seq, p.tm, p.user_id, s.seq AS f, s.i, row_number() OVER (PARTITION BY p.seq ORDER BY s.tm DESC NULLS LAST, {order}) AS k
      FROM p LEFT JOIN s ON s.user_id = p.user_id AND s.tm {op} p.tm)
SELECT j.seq, coalesce(j.f, -1) AS f_seq, CASE WHEN j.tm > latest THEN 'InFuture' WHEN j.f IS NULL THEN 'InPast' ELSE 'Avail' END AS status, coalesce(i, -1) AS "index"
FROM j LEFT JOIN m USING (user_id) WHERE k = 1"""


def _asof(strict: bool, tie: str, tied: bool):
    def run(spark, d):
        ev = _events(spark, d).withColumnRenamed("v1", "user_id")
        if tied:
            ev = ev.withColumn("tm_ns", floor_to(F.col("tm_ns"), HOUR_NS))
        probes = ev.where("stream_name = 'purchase'").select("seq", "user_id", "tm_ns")
        rows = ev.where("stream_name <> 'purchase'").select("seq", "user_id", "tm_ns")
        return series.asof(probes, rows, ["user_id"], strict, tie).select("seq", F.coalesce("f_seq", F.lit(-1)).alias("f_seq"), "status", "index")

    return run


for _strict, _word in ((True, "before"), (False, "at")):
    for _tie in ("last", "first"):
        for _tied in (False, True):
            _name = f"asof_{_tie}_{_word}{'_tied' if _tied else ''}"
            QUERIES[_name] = _asof(_strict, _tie, _tied)
            SQL[_name] = _asof_sql(_strict, _tie, _tied)


@query(f"""{_EV}, s AS (SELECT seq, tm_ns FROM ev WHERE stream_name <> 'purchase'), p AS (SELECT seq, tm_ns FROM ev WHERE stream_name = 'purchase')
SELECT p.seq, coalesce(s.seq, -1) AS f_seq FROM p ASOF LEFT JOIN s ON p.tm_ns >= s.tm_ns""")
def asof_one_series(spark, d):
    ev = _events(spark, d).select("seq", "stream_name", "tm_ns")
    return series.asof(ev.where("stream_name = 'purchase'"), ev.where("stream_name <> 'purchase'")).select("seq", F.coalesce("f_seq", F.lit(-1)).alias("f_seq"))


_DUP = _EV + ", k AS (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY user_id, stream_name ORDER BY seq) <= 300, false) AS dup FROM ev)"
_KEY = ["v1", "stream_name"]


@query(f"{_DUP} SELECT seq, tm_ns FROM k WHERE NOT dup")
def dedup_window(spark, d):
    return dd.dedup(_events(spark, d), 300, _KEY)[0].select("seq", "tm_ns")


@query(f"{_DUP} SELECT seq, tm_ns FROM k WHERE dup")
def dedup_dups(spark, d):
    return dd.dedup(_events(spark, d), 300, _KEY)[1].select("seq", "tm_ns")


@query(f"{_DUP} SELECT seq, tm_ns FROM k WHERE dup ORDER BY seq LIMIT 1")
def dedup_detect(spark, d):
    return dd.first_duplicate(_events(spark, d), 300, _KEY).select("seq", "tm_ns")


@query("""SELECT source_id, seq, coalesce(seq - lag(seq) OVER (PARTITION BY source_id, raw ORDER BY seq) <= 1000, false) AS is_dup FROM frames""")
def dedup_frames(spark, d):
    return dd.mark_duplicates(table(spark, d, "frames"), by=["source_id"]).select("source_id", "seq", "is_dup")


@query(f"{_TIED} SELECT seq, row_number() OVER (ORDER BY tied, seq) - 1 AS rank FROM t")
def time_sort(spark, d):
    ev = _events(spark, d).select("seq", floor_to(F.col("tm_ns"), HOUR_NS).alias("tm_ns"))
    return ordering.ranked(ev, "tm_ns", "seq").select("seq", "rank")


_KINDS = ("click", "error", "purchase", "signup", "view")
_MERGE = f"""{_TIED}, o AS (SELECT *, CASE stream_name {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS))} END AS source_ord FROM t)"""


def _sources(spark, d) -> list[DataFrame]:
    ev = _events(spark, d).select("seq", "stream_name", floor_to(F.col("tm_ns"), HOUR_NS).alias("tm_ns"))
    return [ev.where(F.col("stream_name") == k) for k in _KINDS]


@query(f"{_MERGE} SELECT seq, source_ord, row_number() OVER (ORDER BY tied, source_ord, seq) - 1 AS rank FROM o")
def merge_by_type(spark, d):
    return ordering.ranked(ordering.union_sources(*_sources(spark, d)), "tm_ns", "source_ord", "seq").select("seq", "source_ord", "rank")


@query(f"""{_MERGE}, u AS (SELECT seq, source_ord, max(CAST(CAST(tm_ns AS HUGEINT) * 7919 % 86400000000000 AS BIGINT)) OVER (PARTITION BY source_ord ORDER BY seq) AS m FROM o)
SELECT seq, source_ord, row_number() OVER (ORDER BY m, source_ord, seq) - 1 AS rank FROM u""")
def merge_unsorted(spark, d):
    ev = _events(spark, d).select("seq", "stream_name", (F.col("tm_ns").cast("decimal(38,0)") * 7919 % 86_400_000_000_000).cast("long").alias("tm_ns"))
    rows = ordering.union_sources(*[ev.where(F.col("stream_name") == k) for k in _KINDS])
    return ordering.ranked(ordering.merge_keys(rows), "merge_tm", "source_ord", "seq").select("seq", "source_ord", "rank")


@query(f"{_EV} SELECT seq, tm_ns, v0 FROM ev WHERE seq >= 100 AND seq < 350")
def slice_offset_limit(spark, d):
    return ordering.slice_frames(_events(spark, d), 100, 250).select("seq", "tm_ns", "v0")


_PATTERNS = ["^(click|view)", '"k": [0-9]*7']


def _filter(match_any: bool, exclude: bool):
    def run(spark, d):
        ev = _events(spark, d)
        return filters.filter_regex(ev, _PATTERNS, match_any, exclude, F.concat_ws(" ", "stream_name", "props")).select("seq", "stream_name", "props")

    return run


for _name, _any, _ex, _cond in (
    ("filter_all", False, False, "a AND b"), ("filter_any", True, False, "a OR b"), ("filter_not_all", False, True, "NOT (a AND b)"), ("filter_none", True, True, "NOT (a OR b)"),
):
    QUERIES[_name] = _filter(_any, _ex)
    SQL[_name] = f"""{_EV}, m AS (SELECT *, regexp_matches(concat_ws(' ', stream_name, props), '{_PATTERNS[0]}') AS a,
regexp_matches(concat_ws(' ', stream_name, props), '{_PATTERNS[1]}') AS b FROM ev) SELECT seq, stream_name, props FROM m WHERE {_cond}"""


@query(f"""{_EV} SELECT seq, regexp_extract(props, '"(k)": ([0-9]+)', 1) || ' ' || regexp_extract(props, '"(k)": ([0-9]+)', 2) AS sub FROM ev WHERE regexp_matches(props, '"(k)": ([0-9]+)')""")
def sub_extract(spark, d):
    return filters.extract_groups(_events(spark, d), F.col("props"), '"(k)": ([0-9]+)', 2).select("seq", "sub")


@query(f"""{_EV} SELECT seq, 'k' AS field, regexp_extract(props, '"k":([^,}}]+)[,}}]', 1) AS found FROM ev WHERE regexp_matches(props, '"k":([^,}}]+)[,}}]')""")
def json_field_grep(spark, d):
    return filters.grep_fields(_events(spark, d).select("seq", "props"), "k", line="props").select("seq", "field", "found")


_TEXT_PAYLOAD = "payload IS NOT NULL AND (evtnum IN (-1, 12, 13, 14) OR evtnum BETWEEN 2000 AND 9999)"


@query(rf"""SELECT source_id, seq, regexp_extract(line, '\\x22lsn\\x22: ?([0-9]+)', 1) AS lsn FROM (SELECT source_id, seq, CAST(payload AS VARCHAR) AS line FROM frames WHERE {_TEXT_PAYLOAD})
WHERE regexp_matches(line, '\\x22lsn\\x22: ?([0-9]+)')""")
def payload_grep(spark, d):
    """A field searched in every payload that the registry calls text or json. The SQL has bytes as DuckDB prints them."""
    f = table(spark, d, "frames").where(_TEXT_PAYLOAD).withColumn("line", F.col("payload").cast("string"))
    return filters.extract_groups(f, F.col("line"), '"lsn": ?([0-9]+)', 1, "lsn").select("source_id", "seq", "lsn")


@query("""SELECT strftime(ts, '%Y/%m/%d') AS day, event_type AS stream, '/archive/' || strftime(ts, '%Y/%m/%d') || '/' || event_type AS path, count(*) AS n FROM events GROUP BY ALL""")
def archive_partitions(spark, d):
    ev = _events(spark, d)
    day = dates.date_text(dates.date_of_ns(F.col("tm_ns")))
    return ev.groupBy(day.alias("day"), F.col("stream_name").alias("stream"), paths.archive_path("/archive", F.col("tm_ns"), F.col("stream_name")).alias("path")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT strftime(ts, '%Y/%m/%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""")
def days_between(spark, d):
    days = _events(spark, d).select(dates.date_of_ns(F.col("tm_ns")).alias("d")).distinct()
    return days.where(dates.days_between(F.col("d"), "2024/01/05", "2024/1/20")).select(dates.date_text(F.col("d")).alias("day"))


@query("""SELECT DISTINCT strftime(ts, '%Y/%m/%d') AS day, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS unix, strftime(ts, '%Y/%m') AS month, strftime(CAST(ts AS DATE) + 1, '%Y/%m/%d') AS next, strftime(CAST(ts AS DATE) - 1, '%Y/%m/%d') AS prev,
CAST(ts AS DATE) < DATE '2024-01-15' AS before, CAST(ts AS DATE) > DATE '2024-01-15' AS after, CAST(ts AS DATE) = DATE '2024-01-15' AS same FROM events""")
def date_functions(spark, d):
    day = dates.parse_date(dates.date_text(dates.date_of_ns(F.col("tm_ns"))))
    mid = dates.parse_date(F.lit("2024/1/15"))
    return (
        _events(spark, d).select(day.alias("day")).distinct()
        .select(dates.date_text(F.col("day")).alias("day"), dates.date_unix(F.col("day")).alias("unix"), dates.month_text(F.col("day")).alias("month"), dates.date_text(dates.next_date(F.col("day"))).alias("next"), dates.date_text(dates.prev_date(F.col("day"))).alias("prev"),
                dates.date_before(F.col("day"), mid).alias("before"), dates.date_after(F.col("day"), mid).alias("after"), dates.dates_equal(F.col("day"), mid).alias("same"))
    )


@query(f"{_EV} SELECT tm_ns - tm_ns % 60000000000 AS minute_ns, count(*) AS n FROM ev GROUP BY ALL")
def minute_truncation(spark, d):
    return _events(spark, d).groupBy(minute_floor(F.col("tm_ns")).alias("minute_ns")).agg(F.count("*").alias("n"))


_NAMES = "CASE evtnum " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ff.EVTNUM_NAMES.items()) + " ELSE 'Ev.' || evtnum END"


@query(f"""SELECT source_id, seq, tm_ns | pti AS prim, {_NAMES} AS name, CASE WHEN pti IN (0, 1) THEN 0.0 WHEN pti IN (2, 3) AND NOT isnan(v0) THEN v0 END AS value, CASE WHEN pti = 3 THEN v1 ELSE 0 END AS whole,
CASE pti WHEN 0 THEN false WHEN 4 THEN true END AS flag, evtnum BETWEEN -1048576 AND 1048575 AS valid FROM frames""")
def frame_fields(spark, d):
    pti, evtnum = F.col("pti"), F.col("evtnum")
    value = ff.get_v0(pti, F.col("v0"))
    return table(spark, d, "frames").select(
        "source_id", "seq", ff.prim(F.col("tm_ns"), pti).alias("prim"), ff.evtnum_name(evtnum).alias("name"), F.when(~F.isnan(value), value).alias("value"),
        ff.get_v1(pti, F.col("v1")).alias("whole"), ff.get_bool(pti).alias("flag"), ff.valid_evtnum(evtnum).alias("valid"),
    )


@query("SELECT pti, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS n_bytes, CAST(sum(octet_length(raw)) AS BIGINT) AS n_raw FROM frames GROUP BY pti")
def wire_size(spark, d):
    size = ff.wire_size(F.col("pti"), F.col("ucount"))
    return table(spark, d, "frames").groupBy("pti").agg(F.count("*").alias("n"), F.sum(size).alias("n_bytes"), F.sum(F.octet_length("raw").cast("long")).alias("n_raw"))


@query("SELECT pti, count(*) AS n, count(*) AS n_same FROM frames GROUP BY pti")
def decode_frames(spark, d):
    """Every stored frame decoded from its bytes and compared with its columns."""
    f = table(spark, d, "frames").select("pti", "tm_ns", "evtnum", "v0", "v1", "ucount", "payload", "nbytes", ff.decode_raw("raw").alias("r"))
    same = F.lit(True)
    for c in ("tm_ns", "pti", "evtnum", "v0", "v1", "ucount", "payload", "nbytes"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(c))
    return f.groupBy("pti").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


@query("SELECT pti, count(*) AS n, count(*) AS n_same FROM frames GROUP BY pti")
def encode_frames(spark, d):
    """Every stored frame built again from its columns and compared with its bytes; of a NaN, which has many bit patterns,
    all but those eight bytes."""
    f = table(spark, d, "frames")
    built = f.select("pti", "v0", "raw", ff.encode_raw("tm_ns", "evtnum", "v0", "v1", "payload").alias("built"))
    rest = lambda c: F.concat(F.substring(c, 1, 8), F.expr(f"substring({c}, 17)"))
    same = F.when(F.isnan("v0"), rest("raw") == rest("built")).otherwise(F.col("raw") == F.col("built"))
    return built.groupBy("pti").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


@query("""SELECT DISTINCT stream_name, 'tseries.replay.' || stream_name || '.' || strftime(make_date(1970, 1, 1) + CAST(tm_ns // 86400000000000 AS INTEGER), '%Y/%m/%d') AS subject FROM frames""")
def replay_subjects(spark, d):
    day = dates.date_text(dates.date_of_ns(F.col("tm_ns")))
    return table(spark, d, "frames").select("stream_name", paths.replay_subject(F.col("stream_name"), day).alias("subject")).distinct()


@query("""SELECT file_id, CASE WHEN stream_name LIKE 'plantbus.archive.%' THEN split_part(stream_name, '.', 3) WHEN stream_name IS NOT NULL THEN '' END AS stream, regexp_replace(path || '/', '/$', '') AS path,
regexp_matches(split_part(path, '/', -1), '^([23][0-9]{3}|0[1-9]|[12][0-9]|3[01])$') AS is_date FROM archive_files""")
def path_functions(spark, d):
    f = table(spark, d, "archive_files")
    stream = F.when(F.col("stream_name").isNotNull(), paths.subject_stream(F.col("stream_name"), "plantbus"))
    return f.select("file_id", stream.alias("stream"), paths.chomp_slash(F.concat("path", F.lit("/"))).alias("path"), paths.is_date_dir(F.element_at(F.split("path", "/"), -1)).alias("is_date"))


@query()
def checksum64(spark, d):
    return grouping.checksums(table(spark, d, "frames"))


@query()
def stringify(spark, d):
    return table(spark, d, "frames").select("source_id", "seq", tx.stringify(F.col("seq") + 1).alias("line"))


@query()
def stringify_table(spark, d):
    return table(spark, d, "frames").select("source_id", "seq", tx.stringify_table().alias("line"))


@query()
def filter_frame_text(spark, d):
    return filters.filter_regex(table(spark, d, "frames"), ["EvJson", '"op":']).select("source_id", "seq")


@query()
def msgpack_json(spark, d):
    """Every payload shown as msgpack: those of all its event numbers."""
    packed = F.col("evtnum").isin(*tx.MSGPACK_EVTNUMS) & F.col("payload").isNotNull()
    return table(spark, d, "frames").where(packed).select("source_id", "seq", tx.msgpack_to_json("payload").alias("json"))
