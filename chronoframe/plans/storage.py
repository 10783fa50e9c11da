"""Queries over sources, sinks, streams, payload text and building of frames, with the SQL they equal. What a query stores on
the way goes to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe import generators as gen
from chronoframe.adapters import frames_from_events
from chronoframe.files import file_sizes
from chronoframe.functions import dates, paths
from chronoframe.functions import frames as ff
from chronoframe.functions import text as tx
from chronoframe.functions.times import floor_to
from chronoframe.operators import dedup as dd
from chronoframe.operators import filters, grouping, ordering, series
from chronoframe.operators.compaction import pack_files
from chronoframe.plans.tables import table
from chronoframe.schema import DAY_NS, HOUR_NS, MINUTE_NS, FrameError
from chronoframe.session import cut_lineage, scratch_path
from chronoframe.sources import frames as src
from chronoframe.streaming import archive as ar
from chronoframe.streaming.dedup import ROCKSDB, mark_duplicates_stream
from chronoframe.streaming.grouping import count_per_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EV = "WITH ev AS (SELECT event_id AS seq, (epoch_us(ts) * 1000) & (-8) AS tm_ns, user_id, event_type, value, props, ts FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return frames_from_events(table(spark, d, "events"))


def _hex(c: str):
    return F.lower(F.hex(c)).alias(c)


def _stored(spark: SparkSession, d: str, raw=None) -> str:
    """A folder with a file of bytes for every source."""
    root = scratch_path(spark, "frames")
    f = table(spark, d, "frames")
    src.write_sources(f if raw is None else f.withColumn("raw", raw), root).write.format("noop").mode("overwrite").save()
    return root


def _source(root: str):
    """The source a file was named for."""
    return F.url_decode(F.substring_index("source_id", "/", -1)).alias("source_id")


_COLUMNS = ["seq", "byte_offset", "nbytes", "tm_ns", "pti", "evtnum", "ucount"]
_LIST = ", ".join(_COLUMNS)


@query(f"SELECT source_id, {_LIST}, CASE WHEN NOT isnan(v0) THEN v0 END AS v0, CAST(v1 AS VARCHAR) AS v1, lower(hex(payload)) AS payload, lower(hex(raw)) AS raw FROM frames")
def source_scan(spark, d):
    """Every source written to its own file and read back: all columns."""
    root = _stored(spark, d)
    return src.read_frames(spark, root).select(_source(root), *_COLUMNS, F.when(~F.isnan("v0"), F.col("v0")).alias("v0"), F.col("v1").cast("string").alias("v1"), _hex("payload"), _hex("raw"))


@query("SELECT source_id, seq, lower(hex(raw)) AS raw FROM frames")
def source_raw(spark, d):
    """Bytes only: nothing else is decoded."""
    root = _stored(spark, d)
    return src.read_frames(spark, root, ["source_id", "seq", "raw"]).select(_source(root), "seq", _hex("raw"))


@query("SELECT source_id, seq, byte_offset, tm_ns FROM frames")
def source_split(spark, d):
    """Files cut in pieces wherever a frame starts about every 2 KB."""
    root = _stored(spark, d)
    return src.read_frames(spark, root, ["source_id", "seq", "byte_offset", "tm_ns"], split_bytes=2048).select(_source(root), "seq", "byte_offset", "tm_ns")


@query("SELECT source_id, seq, nbytes FROM (SELECT *, max(seq) OVER (PARTITION BY source_id) AS final FROM frames) WHERE seq < final")
def source_droptail(spark, d):
    """Files whose last frame is cut short: it is left out."""
    f = table(spark, d, "frames")
    final = f.groupBy("source_id").agg(F.max("seq").alias("final"))
    root = scratch_path(spark, "frames")
    cut = f.join(final, "source_id").withColumn("raw", F.when(F.col("seq") == F.col("final"), F.expr("substring(raw, 1, length(raw) - 3)")).otherwise(F.col("raw")))
    src.write_sources(cut, root).write.format("noop").mode("overwrite").save()
    return src.read_frames(spark, root, ["source_id", "seq", "nbytes"]).select(_source(root), "seq", "nbytes")


@query(f"SELECT stream_name, tm_ns, lower(hex(raw)) AS raw FROM frames WHERE tm_ns >= (SELECT max(tm_ns) - max(tm_ns) % {DAY_NS} FROM frames)")
def source_pruned(spark, d):
    """The last day of an archive by YYYY/MM/DD/stream: other days' files are not opened."""
    f = table(spark, d, "frames")
    root = scratch_path(spark, "archive")
    place = F.concat_ws("/", dates.date_text(dates.date_of_ns(F.col("tm_ns"))), F.col("stream_name"), F.xxhash64("source_id").cast("string"))
    src.write_sources(f, root, place).write.format("noop").mode("overwrite").save()
    last = f.agg(F.max(floor_to(F.col("tm_ns"), DAY_NS))).collect()[0][0]
    stream = F.element_at(F.split("source_id", "/"), -2).alias("stream_name")
    return src.read_frames(spark, root, ["source_id", "tm_ns", "raw"], layout="day").where(F.col("tm_ns") >= (last if last is not None else 0)).select(stream, "tm_ns", _hex("raw"))


@query("SELECT source_id, CAST(sum(nbytes) AS BIGINT) AS n_bytes FROM frames GROUP BY source_id")
def source_files(spark, d):
    """The files of a folder with their sizes."""
    root = _stored(spark, d)
    files = file_sizes(root, recursive=False)
    return spark.createDataFrame(files, "source_id string, n_bytes long").select(_source(root), "n_bytes")


@query("SELECT * FROM (VALUES ('too large', 'FrameTooLarge'), ('cut off', 'TooShort'), ('no data allowed', 'NoDataAllowed'), ('out of range', 'EvtnumOutOfRange'), ('duplicate', 'DuplicateDetected'), ('window', 'ValueError'), ('no folder', 'FileNotFoundError')) AS t(\"case\", error)")
def typed_errors(spark, d):
    """What readers, builders and checks refuse, and how."""
    f = table(spark, d, "frames")
    root = _stored(spark, d)
    one = f.where("pti = 2").limit(1)
    twice = one.withColumn("seq", F.lit(0).cast("long")).unionByName(one.withColumn("seq", F.lit(1).cast("long")))
    cut = scratch_path(spark, "frames")
    src.write_sources(f.withColumn("raw", F.expr("substring(raw, 1, 9)")).where("nbytes > 9 and seq = 0"), cut).write.format("noop").mode("overwrite").save()
    from chronoframe import codec

    cases = {
        "too large": lambda: src.read_frames(spark, root, ["seq"], max_frame_bytes=15).count(),
        "cut off": lambda: src.read_frames(spark, cut, ["seq"], mode="FAILFAST").count(),
        "no data allowed": lambda: codec.pack(0, 3, payload=b"x"),
        "out of range": lambda: codec.pack(0, 1 << 20),
        "duplicate": lambda: dd.require_unique(twice),
        "window": lambda: dd.mark_duplicates(f, 1),
        "no folder": lambda: src.list_files(f"{root}/none"),
    }
    known = [*(c.__name__ for c in FrameError.__subclasses__()), "ValueError", "FileNotFoundError"]
    rows = []
    for name, act in cases.items():
        try:
            act()
            rows.append((name, "none"))
        except Exception as e:  # noqa: BLE001 - the name is the result
            said = type(e).__name__
            rows.append((name, said if said in known else next((k for k in known if k in str(e)), said)))
    return spark.createDataFrame(rows, "case string, error string")


@query("SELECT lower(hex(raw)) AS raw, count(*) AS n FROM frames GROUP BY ALL")
def sink_round_trip(spark, d):
    """All frames through the sink, overwritten once, and back."""
    root = scratch_path(spark, "sink")
    f = table(spark, d, "frames")
    src.write_frames(f.where("pti = 7"), root)
    src.write_frames(f, root, "overwrite")
    return src.read_frames(spark, root, ["raw"]).groupBy(_hex("raw")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE idx AS (
SELECT source_id, seq, tm_ns, byte_offset, tm_ns - tm_ns % {MINUTE_NS} + {MINUTE_NS} AS due FROM frames WHERE seq = 0
UNION ALL SELECT source_id, seq, tm_ns, byte_offset, due FROM (
  SELECT f.source_id, f.seq, f.tm_ns, f.byte_offset, f.tm_ns - f.tm_ns % {MINUTE_NS} + {MINUTE_NS} AS due, row_number() OVER (PARTITION BY f.source_id ORDER BY f.seq) AS k
  FROM idx JOIN frames f ON f.source_id = idx.source_id AND f.seq > idx.seq AND f.tm_ns > idx.due) WHERE k = 1)
SELECT source_id, tm_ns, byte_offset FROM idx""")
def index_files(spark, d):
    """Index files written beside their sources and read back as frames."""
    root = _stored(spark, d)
    index = grouping.time_index(src.read_frames(spark, root, ["source_id", "seq", "tm_ns", "byte_offset"]))
    written = cut_lineage(grouping.write_indexes(index).select("path"))
    at = scratch_path(spark, "indexes")

    def load(batches):
        from chronoframe.files import resolve

        for b in batches:
            blobs = []
            for p in b.column("path").to_pylist():
                store, inside = resolve(p)
                with store.open_input_stream(inside) as f:
                    blobs.append(f.read())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([0] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["source_id", "seq", "raw"])

    src.write_sources(written.mapInArrow(load, "source_id string, seq long, raw binary"), at, F.regexp_replace(F.substring_index("source_id", "/", -1), r"\.idx$", "")).write.format("noop").mode("overwrite").save()
    return src.read_frames(spark, at, ["source_id", "tm_ns", "v1"]).select(_source(at), "tm_ns", F.col("v1").alias("byte_offset"))


@query("SELECT source_id, seq, lower(hex(raw)) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS place FROM frames) WHERE place >= 2 AND place < 7")
def raw_slice(spark, d):
    """Bytes of the frames [2, 7) of every source."""
    return ordering.slice_frames(table(spark, d, "frames"), 2, 5).select("source_id", "seq", _hex("raw"))


@query("SELECT source_id, seq FROM frames ORDER BY tm_ns, source_id, seq LIMIT 500 OFFSET 100")
def head_in_time(spark, d):
    """500 frames in order of time after the first 100."""
    return ordering.head(table(spark, d, "frames").select("source_id", "seq", "tm_ns"), 500, 100, "source_id").select("source_id", "seq")


# --- streams


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """The events as archive messages, of every kind the archiver meets."""
    ev = frames_from_events(table(spark, d, "events"), raw=True)
    where = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("svc.archive."), "stream_name")).when(F.col("seq") % 7 == 1, F.concat(F.lit("other.archive."), "stream_name")).otherwise(F.concat(F.lit("svc.archive."), "stream_name", F.lit("."), F.col("seq").cast("string"), F.lit(".x")))
    return ev.select(where.alias("subject"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("reply."), F.col("seq").cast("string"))).alias("reply"), F.when(F.col("seq") % 11 == 0, F.lit(b"")).otherwise(F.col("raw")).alias("data"))


_MESSAGES = _EV + """, m AS (SELECT *, CASE WHEN seq % 7 = 0 THEN '' ELSE seq || '.x' END AS id, strftime(make_timestamp(tm_ns // 1000), '%Y/%m/%d') AS day FROM ev WHERE seq % 7 <> 1 AND seq % 11 <> 0)"""


def _archive(spark: SparkSession, d: str, layout: str) -> tuple[str, str]:
    """(archive, acknowledgements) of the messages stored by a stream that takes what is there and stops."""
    base = scratch_path(spark, "archive")
    _messages(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("subject string, reply string, data binary").parquet(f"{base}/in")
    query = ar.archive(stream, f"{base}/out", f"{base}/ck", "svc", lambda df, n: df.write.mode("overwrite").parquet(f"{base}/acks/{n}"), every=None, layout=layout)
    query.awaitTermination()
    return f"{base}/out", f"{base}/acks/*"


@query(f"{_MESSAGES} SELECT day, event_type AS stream, id, tm_ns | 7 AS tm_ns, CAST(17 + octet_length(encode(props)) AS INTEGER) AS n_bytes FROM m")
def archive_stored(spark, d):
    """What a stream of messages left in the archive."""
    out, _ = _archive(spark, d, "parquet")
    return ar.read_archive(spark, out).select(F.concat_ws("/", "year", "month", "day").alias("day"), "stream", "id", "tm_ns", F.octet_length("raw").alias("n_bytes"))


@query(f"{_MESSAGES} SELECT 'reply.' || seq AS subject, id AS data FROM m WHERE seq % 2 = 0 UNION ALL SELECT 'svc.storage-ack.' || event_type, id FROM m WHERE seq % 2 = 0")
def archive_acks(spark, d):
    """Acknowledgements sent once messages were stored."""
    return spark.read.schema("subject string, data string").parquet(_archive(spark, d, "parquet")[1])


@query(f"{_MESSAGES} SELECT day, event_type AS stream, count(*) AS n, CAST(sum(17 + octet_length(encode(props))) AS BIGINT) AS n_bytes FROM m GROUP BY ALL")
def archive_frame_files(spark, d):
    """The archive as frame files by day and stream, read by the frame source."""
    out, _ = _archive(spark, d, "frames")
    f = src.read_frames(spark, out, ["source_id", "nbytes"], layout="day")
    parts = F.split("source_id", "/")
    return f.groupBy(F.concat_ws("/", *(F.element_at(parts, k) for k in (-5, -4, -3))).alias("day"), F.element_at(parts, -2).alias("stream")).agg(F.count("*").alias("n"), F.sum("nbytes").alias("n_bytes"))


@query(f"{_MESSAGES}, x AS (SELECT DISTINCT day FROM m) SELECT day, day >= '2024/01/05' AND day < '2024/01/20' AS picked FROM x")
def archive_days(spark, d):
    """The days of an archive, and which of them an interval picks."""
    days = ar.available_days(_archive(spark, d, "frames")[0])
    picked = set(ar.intersect_days(days, "2024/01/05", "2024/01/20"))
    return spark.createDataFrame([(x, x in picked) for x in days], "day string, picked boolean")


@query("SELECT source_id, seq, tm_ns, lower(hex(raw)) AS raw FROM frames")
def follow_stream(spark, d):
    """Frames of all files, followed in two steps as the files grow."""
    root, out = scratch_path(spark, "frames"), scratch_path(spark, "followed")
    f = table(spark, d, "frames")
    for part in (f.where("seq < 5"), f):
        src.write_sources(part, root).write.format("noop").mode("overwrite").save()
        followed = ar.follow(spark, root, "begin", ["source_id", "seq", "tm_ns", "raw"])
        followed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(_source(root), "seq", "tm_ns", _hex("raw"))


@query("SELECT source_id, seq, coalesce(seq - lag(seq) OVER (PARTITION BY source_id, raw ORDER BY seq) <= 100, false) AS is_dup FROM frames")
def dedup_stream(spark, d):
    """Duplicates among the 100 frames before, on a stream."""
    out = scratch_path(spark, "deduped")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        table(spark, d, "frames").select("source_id", "seq", "raw").write.parquet(f"{out}-in")
        stream = spark.readStream.schema("source_id string, seq long, raw binary").parquet(f"{out}-in")
        marked = mark_duplicates_stream(stream, 100).select("source_id", "seq", "is_dup")
        marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(out)


@query(f"SELECT stream_name, tm_ns - tm_ns % {MINUTE_NS} AS start_ns, count(*) AS n FROM frames GROUP BY ALL")
def count_stream(spark, d):
    """Frames per stream and minute, counted on a stream; late ones count."""
    out = scratch_path(spark, "counted")
    table(spark, d, "frames").select("stream_name", "tm_ns").write.parquet(f"{out}-in")
    stream = spark.readStream.schema("stream_name string, tm_ns long").parquet(f"{out}-in")
    counts = count_per_stream(stream, by="stream_name")
    counts.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("stream_name", (F.unix_micros(F.col("start").cast("timestamp")) * 1000).alias("start_ns"), "n")


@query("""SELECT 'tseries.replay.all.' || strftime(make_date(1970, 1, 1) + CAST(tm_ns // 86400000000000 AS INTEGER), '%Y/%m/%d') AS subject, lower(hex(raw)) AS data, count(*) AS n FROM frames GROUP BY ALL""")
def replay_messages(spark, d):
    """All streams merged by time, as messages; each frame is sent once."""
    f = table(spark, d, "frames")
    return ar.replay("all", f.where("pti < 7"), f.where("pti = 7")).groupBy("subject", _hex("data")).agg(F.count("*").alias("n"))


# --- text

_TIME = "strftime(make_timestamp(tm_ns // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN tm_ns % 1000000000 = 0 THEN '' ELSE rtrim(printf('.%09d', tm_ns % 1000000000), '0') END || 'Z'"
_NAME = "CASE evtnum " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ff.EVTNUM_NAMES.items()) + " ELSE 'Ev.' || evtnum END"
_FLOAT = "CASE WHEN isnan(v0) THEN 'NaN' WHEN isinf(v0) THEN CASE WHEN v0 > 0 THEN '+Inf' ELSE '-Inf' END ELSE regexp_replace(CAST(v0 AS VARCHAR), '\\.0$', '') END"
_HEADER = f"'{tx.HEADER_WORD} ' || {_TIME} || ' EVTNUM ' || {_NAME} || ' [' || nbytes || ' bytes] (UCOUNT ' || ucount || ')' || CASE WHEN pti IN (2, 3) THEN ' V0:' || {_FLOAT} ELSE '' END || CASE WHEN pti IN (1, 3) THEN ' V1:' || v1 ELSE '' END"


@query(f"SELECT source_id, seq, printf('%06d ', seq + 1) || {_HEADER} AS line FROM frames")
def header_lines(spark, d):
    """Numbered header line of every frame."""
    return table(spark, d, "frames").select("source_id", "seq", tx.header_text(F.col("seq") + 1).alias("line"))


@query(f"{_EV}, f AS (SELECT seq, tm_ns, 7 AS pti, 14 AS evtnum, 17 + octet_length(encode(props)) AS nbytes, 1 + octet_length(encode(props)) AS ucount, value AS v0, user_id AS v1, props FROM ev) SELECT seq, {_HEADER} || '  ' || props AS line, {_TIME} || ' evtnum EvJson  ' || props AS row FROM f")
def json_lines(spark, d):
    """Display and table lines of frames with JSON payloads."""
    return _events(spark, d).select("seq", tx.stringify().alias("line"), tx.stringify_table().alias("row"))


@query(f"SELECT printf('%06d ', row_number() OVER (ORDER BY source_id, seq)) || {_HEADER} AS value FROM frames")
def display_lines(spark, d):
    """The lines of all sources, numbered across them."""
    return tx.display(table(spark, d, "frames"), skip_payload=True)


@query(rf"""{_EV} SELECT seq, '{{' || chr(10) || '          "k": ' || regexp_extract(props, '([0-9]+)', 1) || chr(10) || '      }}' AS pretty FROM ev""")
def pretty_props(spark, d):
    """JSON payloads indented."""
    return _events(spark, d).select("seq", tx.pretty_json("props").alias("pretty"))


@query("""WITH ev AS (SELECT event_id, event_type, user_id FROM events) SELECT event_id AS seq, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json, 9 AS evtnum FROM ev""")
def msgpack_frames(spark, d):
    """Frames whose payload is the msgpack of columns, shown as canonical JSON."""
    ev = table(spark, d, "events").withColumn("tm", F.lit(8).cast("long"))
    f = ff.to_msgpack_frames(ev, "tm", ["user_id", "event_type", "event_id"], seq="event_id")
    return f.select("seq", tx.msgpack_to_json("payload").alias("json"), "evtnum")


_LOG = {"Structs": {"LogEntry": {"Fields": [
    {"Zid": 0, "FieldTagName": "lsn", "FieldFullType": {"Str": "int64"}}, {"Zid": 1, "FieldTagName": "op", "FieldFullType": {"Str": "string"}},
    {"Zid": 2, "FieldTagName": "args", "FieldFullType": {"Str": "Map", "Domain": {"Str": "string"}, "Range": {"Str": "string"}}},
]}}}


@query("SELECT k AS seq, CASE WHEN k > 0 THEN CAST(k AS VARCHAR) END AS lsn, '0x' || printf('%x', k) AS op, '{' || CASE WHEN k > 0 THEN '\"lsn\":' || k || ',' ELSE '' END || '\"op\":\"0x' || printf('%x', k) || '\"}' AS json FROM (SELECT unnest(range(2000)) AS k)")
def schema_payloads(spark, d):
    """Payloads numbered by field, as JSON by their schema document and as typed columns."""
    f = gen.log_entries(spark, 2000)
    j = f.select("seq", tx.schema_to_json(_LOG)("payload").alias("json"))
    return j.select("seq", "json", F.from_json("json", tx.schema_struct(_LOG, "LogEntry")).alias("x")).select("seq", F.col("x.lsn").cast("string").alias("lsn"), "x.op", "json")


@query(rf"""{_EV} SELECT seq, CASE WHEN regexp_matches(event_type, '^(cl)(ick)') THEN 'cl ick' ELSE regexp_extract(props, '"(k)": ([0-9]+)', 1) || ' ' || regexp_extract(props, '"(k)": ([0-9]+)', 2) END AS sub FROM ev""")
def sub_last_tested(spark, d):
    """Capture groups of the pattern that was tested last, any of two."""
    text = F.concat_ws(" ", "stream_name", "props")
    return filters.filter_sub(_events(spark, d), ["^(cl)(ick)", '"(k)": ([0-9]+)'], match_any=True, text=text).select("seq", "sub")


@query(f"{_EV} SELECT seq, 'k' AS field, regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS found FROM ev")
def escaped_field_grep(spark, d):
    """Fields of JSON inside JSON strings: the escaped form."""
    inner = F.concat(F.lit('{"x":"{\\"k\\":\\"'), F.regexp_extract("props", "([0-9]+)", 1), F.lit('\\"}"}'))
    return filters.grep_fields(_events(spark, d).select("seq", inner.alias("value")), "k").select("seq", "field", "found")


@query("SELECT value, count(*) AS n FROM (SELECT event_type AS value FROM events) WHERE regexp_matches(value, 'ck|gn') GROUP BY ALL")
def pattern_file(spark, d):
    """Lines of text files (empty ones left out) that match any pattern of a file."""
    root = scratch_path(spark, "lines")
    table(spark, d, "events").select(F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "\n").otherwise("")).alias("value")).write.text(f"{root}/text")
    spark.createDataFrame([("ck",), ("",), ("gn",)], "value string").coalesce(1).write.text(f"{root}/patterns")
    patterns = [r.value for r in src.read_lines(spark, f"{root}/patterns").collect()]
    lines = src.read_lines(spark, f"{root}/text")
    return filters.filter_regex(lines, patterns, match_any=True, text=F.col("value")).groupBy("value").agg(F.count("*").alias("n"))


# --- building frames

_KIND = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 14 END"


@query(f"""WITH e AS (SELECT event_id AS seq, epoch_us(ts) * 1000 + 5 AS tm, {_KIND} AS evtnum, value, user_id, props FROM events)
SELECT seq, tm & (-8) AS tm_ns, CASE WHEN evtnum = 14 THEN 7 ELSE evtnum END AS pti, evtnum, CASE WHEN evtnum IN (2, 3) THEN value END AS v0, CASE WHEN evtnum IN (1, 3) THEN CAST(user_id AS VARCHAR) END AS v1,
CASE WHEN evtnum = 14 THEN octet_length(encode(props)) + 1 ELSE 0 END AS ucount, CASE evtnum WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 16 WHEN 3 THEN 24 ELSE 17 + octet_length(encode(props)) END AS nbytes, CASE WHEN evtnum = 14 THEN props END AS payload, true AS same FROM e""")
def built_frames(spark, d):
    """Frames of several types built from columns, and their bytes decoded again."""
    kind = F.expr(_KIND)
    ev = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + 5).alias("tm"), kind.alias("e"), "value", "user_id", F.when(kind == 14, F.col("props")).alias("p"))
    f = ff.to_frames(ev, "tm", "e", "value", "user_id", "p", seq="event_id")
    r = f.withColumn("r", ff.decode_raw("raw"))
    same = F.lit(True)
    for c in ("tm_ns", "pti", "evtnum", "v0", "v1", "ucount", "payload", "nbytes"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(c))
    return r.select("seq", "tm_ns", F.col("pti").cast("int").alias("pti"), "evtnum", "v0", F.col("v1").cast("string").alias("v1"), "ucount", "nbytes", F.col("payload").cast("string").alias("payload"), same.alias("same"))


@query(f"SELECT source_id, seq, (tm_ns + {HOUR_NS + 3}) & (-8) AS tm_ns, CAST(CASE WHEN pti = 3 THEN seq ELSE v1 END AS VARCHAR) AS v1, pti FROM frames")
def moved_frames(spark, d):
    """Every frame with another time and, where it carries both numbers, another v1, read from its new bytes."""
    f = ff.set_time(table(spark, d, "frames"), F.col("tm_ns") + (HOUR_NS + 3))
    r = ff.set_v1(f, F.col("seq")).select("source_id", "seq", ff.decode_raw("raw").alias("r"))
    return r.select("source_id", "seq", "r.tm_ns", F.col("r.v1").cast("string").alias("v1"), "r.pti")


@query("""SELECT name, count(*) AS n, CAST(sum(v0) AS DOUBLE) AS v0, CAST(CAST(sum(v1) AS BIGINT) AS VARCHAR) AS v1, CAST(sum(tm) AS BIGINT) AS seconds FROM (
SELECT 'floats' AS name, k AS v0, NULL AS v1, k AS tm FROM (SELECT unnest(range(500)) AS k)
UNION ALL SELECT 'pairs', k, 0, k FROM (SELECT unnest(range(500)) AS k)
UNION ALL SELECT 'repeats', k, NULL, k FROM (SELECT unnest([0, 0, 0, 0, 0, 1, 2, 2, 2]) AS k)
UNION ALL SELECT 'mixed', CASE WHEN k % 3 = 2 THEN k END, CASE WHEN k % 3 = 2 THEN k END, k FROM (SELECT unnest(range(500)) AS k)) GROUP BY ALL""")
def generated_frames(spark, d):
    """Frames of the generators, summed up from their bytes."""
    made = {"floats": gen.floats(spark, 500), "pairs": gen.pairs(spark, 500), "repeats": gen.repeats(spark, [5, 1, 3]), "mixed": gen.mixed(spark, 500)}
    out = None
    for name, f in made.items():
        r = f.select(ff.decode_raw("raw").alias("r")).select("r.*").agg(F.count("*").alias("n"), F.sum("v0").alias("v0"), F.sum("v1").alias("v1"), F.sum(F.call_function("div", F.col("tm_ns") - gen.START_NS, F.lit(10**9))).alias("seconds"))
        r = r.select(F.lit(name).alias("name"), "n", "v0", F.col("v1").cast("string").alias("v1"), "seconds")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"{_EV} SELECT seq, list_aggregate(list(seq) OVER w, 'string_agg', ',') AS last, coalesce((list(seq) OVER w)[2], -1) AS second FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def ring_of_three(spark, d):
    """The three latest events of each user, oldest first, and the second of them."""
    r = ordering.last_n(_events(spark, d).select("v1", "seq"), 3, ["v1"])
    return r.select("seq", F.array_join(F.transform("last", lambda x: x["seq"].cast("string")), ",").alias("last"), F.coalesce(ordering.kth("last", 1)["seq"], F.lit(-1)).alias("second"))


@query(f"{_EV}, s AS (SELECT * FROM ev WHERE event_type <> 'view') SELECT p.seq, s.seq AS f_seq FROM (SELECT seq, tm_ns, user_id FROM ev WHERE event_type = 'view') p ASOF LEFT JOIN s ON s.user_id = p.user_id AND p.tm_ns >= s.tm_ns")
def series_lookup(spark, d):
    """Views looked up in a kept series of each user's other events."""
    ev = _events(spark, d).select("seq", "tm_ns", "stream_name", F.col("v1").alias("user_id"))
    kept = series.Series(ev.where("stream_name <> 'view'").drop("stream_name"), ["user_id"])
    return kept.at(ev.where("stream_name = 'view'").drop("stream_name")).select("seq", "f_seq")


@query("SELECT DISTINCT stream_name, substr(stream_name, 1, 1) || '/' || substr(stream_name, 2, 1) || '/' || substr(stream_name, 3, 1) || '/' || stream_name || '/' AS dirs FROM frames WHERE length(stream_name) >= 3")
def spread_dirs(spark, d):
    return table(spark, d, "frames").select("stream_name", paths.xtra_dirs(F.col("stream_name")).alias("dirs")).distinct().where("dirs is not null")


@query("SELECT DISTINCT CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS utc, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) - 28800 AS west, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) - 18000 AS east, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS london FROM events")
def zone_times(spark, d):
    """Days as UTC instants and as wall time in the known zones (winter)."""
    ts = dates.to_timestamp_utc(F.col("day"))
    seconds = lambda c: F.unix_seconds(c)
    days = _events(spark, d).select(dates.date_of_ns(F.col("tm_ns")).alias("day")).distinct()
    return days.select(seconds(ts).alias("utc"), *(seconds(dates.local_time(ts, z)).alias(n) for z, n in zip(dates.ZONES, ("west", "east", "london"))))


# --- packs of whole files


@query("SELECT event_id, event_type, user_id FROM events")
def packed_lines(spark, d):
    """Many small files of JSON lines joined into packs per event type, and the packs read back."""
    root = scratch_path(spark, "lines")
    ev = table(spark, d, "events").select("event_id", "event_type", "user_id", F.col("event_type").alias("kind"))
    ev.repartition("kind").write.option("maxRecordsPerFile", 50).partitionBy("kind").json(f"{root}/in")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{root}/in")
    pack_files(files, F.regexp_extract("path", "kind=([a-z]+)", 1), f"{root}/packs", pack_bytes=1 << 16).write.format("noop").mode("overwrite").save()
    return spark.read.schema("event_id long, event_type string, user_id long").option("recursiveFileLookup", "true").json(f"{root}/packs")


@query("SELECT event_id, props FROM events")
def packed_zstandard(spark, d):
    """Small zstandard files joined frame by frame, and the packs decompressed."""
    root = scratch_path(spark, "zstandard")
    lines = table(spark, d, "events").select(F.concat_ws("\t", "event_id", "props").alias("line"), F.call_function("div", F.col("event_id"), F.lit(50)).alias("file"))
    texts = lines.groupBy("file").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("text"))

    def squeeze(batches):
        import zstandard

        for b in batches:
            made = [zstandard.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in b.column("file").to_pylist()]), pa.array([len(m) for m in made], pa.int64()), pa.array(made, pa.binary())], ["path", "length", "content"])

    files = texts.mapInArrow(squeeze, "path string, length long, content binary")
    packed = pack_files(files, F.lit("all"), f"{root}/packs", kind="zstd", pack_bytes=1 << 14)

    def open_packs(batches):
        import zstandard

        from chronoframe.files import resolve

        for b in batches:
            for p in b.column("path").to_pylist():
                store, at = resolve(p)
                with store.open_input_stream(at) as f:
                    data = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
                rows = [x.split("\t", 1) for x in data.decode().split("\n") if x]
                yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["event_id", "props"])

    return packed.select("path").mapInArrow(open_packs, "event_id long, props string")
