"""Queries of the streaming operators (ST), the stream sources and sinks (S-05, S-12 to S-14) and UD-06, UD-07."""

from pyspark.sql import functions as F

from riskloom.plans.registry import register
from riskloom.sources.ingest import scratch
from riskloom.sources.tables import table
from riskloom.streaming import features as V


def _events(spark, d, kind=None):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.where(F.col("event_type") == kind) if kind else rows


def _stamp(*cols):
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in cols]


_JSON = "CASE WHEN event_id % 50 = 0 THEN '{broken' ELSE to_json(named_struct('customerId', if(event_id % 50 = 7, '', CAST(user_id AS STRING)), 'eventTime', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'amount', if(event_id % 50 = 9, -1.0D, value), 'op_type', if(event_id % 50 = 11, 'MERGE', 'INSERT'))) END"
_SCHEMA = "customerId STRING, eventTime TIMESTAMP, amount DOUBLE"


def _lines(spark, d):
    return table(spark, d, "events").select("event_id", "ts", F.expr(_JSON).alias("value"))


def _fed(spark, lines, parts=3):
    """A folder of text files, one for each of some ranges of time, written one after the other; and the ends of the ranges."""
    path, lines = scratch(spark, "stream"), lines.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = lines.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high + 1 - low) * i // parts for i in range(parts + 1)] if high is not None else [0, 1]
    for a, b in zip(edges, edges[1:]):
        lines.where((F.col("ts") >= a) & (F.col("ts") < b)).select("value").coalesce(1).write.mode("append").text(path)
    return path, edges


def _stream(spark, d):
    """The events as a stream of text files, a batch each, in the order of time."""
    return V.event_source(spark, _fed(spark, _lines(spark, d))[0])


def _closed(size, delay):
    """SQL: windows of the good records that the watermark has passed."""
    good = "SELECT CAST(user_id AS VARCHAR) AS c, date_trunc('second', ts) AS t FROM events WHERE event_id % 50 NOT IN (0, 7)"
    return f"WITH g AS ({good}), w AS (SELECT c AS customerId, time_bucket(INTERVAL {size}, t, TIMESTAMP '1970-01-01') AS s, count(*) AS n FROM g GROUP BY 1, 2), k AS (SELECT * FROM w WHERE s + INTERVAL {size} <= (SELECT max(t) FROM g) - INTERVAL {delay} SECOND)"


_START, _END = "strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start", "strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end"


@register("st01_parse_events", "SELECT event_id FROM events WHERE event_id % 50 NOT IN (0, 7)")
def st01(spark, d):
    good, _ = V.parse_events(_lines(spark, d).select(F.concat(F.regexp_replace("value", r"\}$", ""), F.lit(',"event_id":'), "event_id", F.lit("}")).alias("value")), _SCHEMA + ", event_id BIGINT", ["customerId", "eventTime"])
    return good.select("event_id")


@register("s05_event_source", "SELECT count(*) AS n FROM events WHERE event_id % 50 NOT IN (0, 7)")
def s05(spark, d):
    good, _ = V.parse_events(_stream(spark, d), _SCHEMA, ["customerId", "eventTime"])
    path = scratch(spark, "out")
    V.run_available(good, path)
    return spark.read.parquet(f"{path}/data").agg(F.count("*").alias("n"))


def _windows(spark, d, delay):
    good, _ = V.parse_events(_stream(spark, d), _SCHEMA, ["customerId", "eventTime"])
    timed = V.with_event_time(good, "eventTime", delay)
    path = scratch(spark, "out")
    V.run_available(V.tumbling_feature(timed, "customerId", "eventTime", "1 hour", "amount"), path)
    return spark.read.parquet(f"{path}/data").select("customerId", *_stamp("window_start", "window_end"), "n")


@register("st02_watermark_0s", _closed("1 HOUR", 0) + f" SELECT customerId, {_START}, {_END}, n FROM k")
def st02(spark, d):
    return _windows(spark, d, "0 seconds")


@register("st03_watermark_5s", _closed("1 HOUR", 5) + f" SELECT customerId, {_START}, {_END}, n FROM k")
def st03(spark, d):
    return _windows(spark, d, "5 seconds")


@register("st04_late_data_drop", _closed("1 DAY", 0) + f" SELECT customerId, {_START}, n FROM k")
def st04(spark, d):
    """Daily windows of all events; a later file repeats the events of the first days and changes no closed window."""
    path, out = scratch(spark, "late"), scratch(spark, "out")

    def run():
        good, _ = V.parse_events(V.event_source(spark, path, files_per_trigger=1_000_000), _SCHEMA, ["customerId", "eventTime"])
        V.run_available(V.tumbling_feature(V.with_event_time(good, "eventTime", "0 seconds"), "customerId", "eventTime", "1 day", "amount"), out)

    lines = _lines(spark, d)
    lines.select("value").write.text(path)
    run()
    early = table(spark, d, "events").where("ts < timestamp_ntz'2024-01-05'").select("event_id")
    lines.join(early, "event_id", "left_semi").select("value").write.mode("append").text(path)
    run()
    return spark.read.parquet(f"{out}/data").select("customerId", *_stamp("window_start"), "n")


def _sliding_sql(kind, size, slide, total=False):
    extra = ", round(sum(value), 3) AS total" if total else ""
    return f"SELECT user_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n{extra} FROM events, unnest(generate_series(time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01') - INTERVAL {size} + INTERVAL {slide}, time_bucket(INTERVAL {slide}, ts, TIMESTAMP '1970-01-01'), INTERVAL {slide})) t(w) WHERE event_type = '{kind}' GROUP BY ALL"


@register("st05_credit_query_3m", _sliding_sql("view", "90 DAY", "1 HOUR"))
def st05(spark, d):
    return V.sliding_feature(_events(spark, d, "view"), "user_id", "ts", "90 days", "1 hour").select("user_id", *_stamp("window_start"), "n")


@register("st06_apply_freq_1m", _sliding_sql("signup", "30 DAY", "1 HOUR"))
def st06(spark, d):
    return V.sliding_feature(_events(spark, d, "signup"), "user_id", "ts", "30 days", "1 hour").select("user_id", *_stamp("window_start"), "n")


@register("st07_overdue_6m", _sliding_sql("error", "180 DAY", "1 DAY", True))
def st07(spark, d):
    return V.sliding_feature(_events(spark, d, "error"), "user_id", "ts", "180 days", "1 day", "value").select("user_id", *_stamp("window_start"), "n", F.round("total", 3).alias("total"))


@register("st13_window_parameters", _sliding_sql("purchase", "12 HOUR", "4 HOUR", True))
def st13(spark, d):
    return V.sliding_feature(_events(spark, d, "purchase"), "user_id", "ts", "12 hours", "4 hours", "value").select("user_id", *_stamp("window_start"), "n", F.round("total", 3).alias("total"))


def _sliding_stream(spark, d, kind, size, slide, amount=None):
    """The events of a kind in three batches by time, then those of the first third again, which are late by then."""
    rows = table(spark, d, "events").where(F.col("event_type") == kind)
    lines = rows.select("ts", F.to_json(F.struct("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "value")).alias("value"))
    path, edges = _fed(spark, lines)
    first = F.unix_micros(F.col("ts").cast("timestamp")) < edges[1] - 86_400_000_000
    lines.where(first).select("value").coalesce(1).write.mode("append").text(path)
    good, _ = V.parse_events(V.event_source(spark, path), "user_id BIGINT, ts TIMESTAMP, value DOUBLE", ["user_id", "ts"])
    out = scratch(spark, "out")
    with V.large_state(spark):
        V.run_available(V.sliding_stream(V.with_event_time(good, "ts", "0 seconds"), "user_id", "ts", size, slide, amount), out)
    return spark.read.parquet(f"{out}/data").select("user_id", *_stamp("window_start"), "n", *([F.round("total", 3).alias("total")] if amount else []))


def _sliding_closed(kind, size, slide, total=False):
    """SQL: the sliding windows that end by the last event of the kind."""
    return f"SELECT * FROM ({_sliding_sql(kind, size, slide, total)}) WHERE CAST(window_start AS TIMESTAMP) + INTERVAL {size} <= (SELECT date_trunc('second', max(ts)) FROM events WHERE event_type = '{kind}')"


@register("st05_credit_query_3m_stream", _sliding_closed("view", "90 DAY", "1 HOUR"))
def st05_stream(spark, d):
    return _sliding_stream(spark, d, "view", "90 days", "1 hour")


@register("st06_apply_freq_1m_stream", _sliding_closed("signup", "30 DAY", "1 HOUR"))
def st06_stream(spark, d):
    return _sliding_stream(spark, d, "signup", "30 days", "1 hour")


@register("st07_overdue_6m_stream", _sliding_closed("error", "180 DAY", "1 DAY", True))
def st07_stream(spark, d):
    return _sliding_stream(spark, d, "error", "180 days", "1 day", "value")


@register("st13_window_parameters_stream", _sliding_closed("purchase", "12 HOUR", "4 HOUR", True))
def st13_stream(spark, d):
    return _sliding_stream(spark, d, "purchase", "12 hours", "4 hours", "value")


_HOUR = "SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, round(sum(value), 3) AS total, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase'{} GROUP BY 1, 2"


def _hourly(rows):
    return V.tumbling_feature(rows, "user_id", "ts", "1 hour", "value").select("user_id", *_stamp("window_start"), F.round("total", 3).alias("total"), "n", F.round("mean", 6).alias("mean"))


@register("st08_transaction_1h", _HOUR.format(""))
def st08(spark, d):
    return _hourly(_events(spark, d, "purchase"))


@register("st09_stream_filter", _HOUR.format(" AND value >= 20 AND user_id > 0"))
def st09(spark, d):
    return _hourly(_events(spark, d, "purchase").where("user_id > 0 AND value >= 20"))


@register("ud06_mergeable_aggregate", _HOUR.format(""))
def ud06(spark, d):
    minutes = V.tumbling_feature(_events(spark, d, "purchase"), "user_id", "ts", "1 minute", "value")
    hours = minutes.groupBy("user_id", F.date_trunc("hour", "window_start").alias("window_start")).agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    return hours.select("user_id", *_stamp("window_start"), F.round("t", 3).alias("total"), "n", F.round(F.col("t") / F.col("n"), 6).alias("mean"))


_BAD = "SELECT event_id, 'SCHEMA' AS rule, 'payload' AS field FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'SCHEMA', 'op_type' FROM events WHERE event_id % 50 = 11 UNION ALL SELECT event_id, 'COMPLETENESS', 'customerId' FROM events WHERE event_id % 50 = 7 UNION ALL SELECT event_id, 'ACCURACY', 'amount' FROM events WHERE event_id % 50 = 9"


@register("st10_stream_quality", f"SELECT rule, field, count(*) AS n FROM ({_BAD}) GROUP BY 1, 2")
def st10(spark, d):
    return V.stream_quality(_lines(spark, d)).groupBy("rule", "field").agg(F.count("*").alias("n"))


@register("ud07_one_to_many", f"SELECT count(*) AS n FROM ({_BAD})")
def ud07(spark, d):
    return V.stream_quality(_lines(spark, d)).agg(F.count("*").alias("n"))


@register("st11_shape_alert", "SELECT doc_id, length(substr(text, 1, 500)) AS size, 'HIGH' AS severity FROM documents")
def st11(spark, d):
    return V.shape_alert(table(spark, d, "documents").withColumnRenamed("text", "payload")).select("doc_id", F.length("payload").cast("long").alias("size"), "severity")


@register("st12_latest_window", "SELECT user_id, strftime(max(time_bucket(INTERVAL 1 HOUR, ts)), '%Y-%m-%d %H:%M:%S') AS window_start FROM events WHERE event_type = 'purchase' GROUP BY 1")
def st12(spark, d):
    hourly = V.tumbling_feature(_events(spark, d, "purchase"), "user_id", "ts", "1 hour", "value")
    return V.latest_window(hourly, "user_id").select("user_id", *_stamp("window_start"))


def _feature_stream(spark, d):
    good, _ = V.parse_events(_stream(spark, d), _SCHEMA, ["customerId", "eventTime"])
    return V.tumbling_feature(V.with_event_time(good, "eventTime", "0 seconds"), "customerId", "eventTime", "1 hour", "amount")


@register("s12_latest_feature_sink", _closed("1 HOUR", 0) + f", l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY customerId ORDER BY s DESC) = 1) SELECT customerId, {_START}, n FROM l")
def s12(spark, d):
    path, features = scratch(spark, "latest"), _feature_stream(spark, d)
    V.upsert_latest_features(features, "customerId", path)
    return V.latest_features(spark, path, features.schema).select("customerId", *_stamp("window_start"), "n")


@register("s13_feature_history_sink", _closed("1 HOUR", 0) + f" SELECT customerId, {_START}, n FROM k")
def s13(spark, d):
    path = scratch(spark, "history")
    V.append_feature_history(_feature_stream(spark, d), ["customerId", "window_end"], path)
    return spark.read.parquet(f"{path}/history").select("customerId", *_stamp("window_start"), "n")


@register("s14_alert_sink", f"SELECT rule, field, 'HIGH' AS severity, count(*) AS n FROM ({_BAD}) GROUP BY 1, 2")
def s14(spark, d):
    path = scratch(spark, "alerts")
    V.write_alerts(V.stream_quality(_stream(spark, d)).withColumn("at", F.lit("2024-01-31").cast("timestamp")), path, "at")
    return spark.read.parquet(f"{path}/data").groupBy("rule", "field", "severity").agg(F.count("*").alias("n"))
