"""Sources, windows, quality rules and sinks of event streams."""

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

# Fixed values of the change-stream rules.
OPERATIONS, REQUIRED, NOT_NEGATIVE = ("INSERT", "UPDATE", "DELETE"), ("customerId", "eventTime"), ("amount", "overdueDays")


def event_source(spark: SparkSession, path: str | None = None, kafka: dict | None = None, files_per_trigger: int = 1) -> DataFrame:
    """A stream of ``value`` texts: Kafka from the earliest offsets, or a folder of text files."""
    if kafka:
        return spark.readStream.format("kafka").options(startingOffsets="earliest", **kafka).load().select(F.col("value").cast("string"))
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def parse_events(df: DataFrame, schema: str, required: list[str], col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones as their texts: not an object, or a required field missing or empty. Extra fields are ignored."""
    parsed = df.select(F.col(col).alias("_raw"), F.from_json(col, schema).alias("_e"))
    good = F.lit(True)
    for name in required:
        good = good & F.col(f"_e.{name}").isNotNull() & (F.col(f"_e.{name}").cast("string") != "")
    good = F.coalesce(F.col("_e").isNotNull() & good, F.lit(False))
    return parsed.where(good).select("_e.*"), parsed.where(~good).select(F.col("_raw").alias(col))


def with_event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """A timestamp column with its watermark; rows without a time cannot enter windows."""
    return df.withColumn(col, F.col(col).cast("timestamp")).where(F.col(col).isNotNull()).withWatermark(col, delay)


def tumbling_feature(df: DataFrame, key: str, at: str, size: str, amount: str) -> DataFrame:
    """Total, count and mean per key and window."""
    made = df.groupBy(F.window(at, size), key).agg(F.sum(amount).alias("total"), F.count("*").alias("n"), F.avg(amount).alias("mean"))
    return made.select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total", "n", "mean")


def panes_of(df: DataFrame, key: str, at: str, slide: str, amount: str | None) -> DataFrame:
    """Count and sum per key and pane of the slide's width; an event is in one pane, whatever the window's size."""
    return df.groupBy(F.window(at, slide), key).agg(F.count("*").alias("n"), F.sum(F.col(amount) if amount else F.lit(0)).alias("total"))


def sliding_feature(df: DataFrame, key: str, at: str, size: str, slide: str, amount: str | None = None) -> DataFrame:
    """Batch form: count (and sum) per key and sliding window.

    A pane enters the windows from ``size - slide`` before it and leaves them behind it, so a key's count changes at two places
    for each of its panes. Running sums over these changes hold between them, and only the windows that come out are made from
    them; no pane is copied into its windows. A key has a row for each pane and change at most, however many events it has.
    """
    size_, slide_ = F.expr(f"INTERVAL {size}"), F.expr(f"INTERVAL {slide}")
    panes = panes_of(df, key, at, slide, amount).select(key, F.col("window.start").alias("_p"), "n", "total")
    change = F.explode(F.array(*(F.struct(where.alias("at"), (sign * F.col("n")).alias("n"), (sign * F.col("total")).alias("total")) for where, sign in ((F.col("_p") - size_ + slide_, 1), (F.col("_p") + slide_, -1)))))
    changes = panes.select(key, change.alias("_c")).groupBy(key, F.col("_c.at").alias("_at")).agg(F.sum("_c.n").alias("n"), F.sum("_c.total").alias("total"))
    w = Window.partitionBy(key).orderBy("_at")
    held = changes.withColumns({"n": F.sum("n").over(w), "total": F.sum("total").over(w), "_next": F.lead("_at").over(w)}).where("n > 0")
    made = held.withColumn("window_start", F.explode(F.sequence(F.col("_at"), F.col("_next") - slide_, slide_)))
    return made.select(key, "window_start", (F.col("window_start") + size_).alias("window_end"), "n", *(["total"] if amount else []))


def milliseconds(spark: SparkSession, interval: str) -> int:
    """Length of a day-time interval."""
    return spark.range(1).select((F.unix_millis(F.lit("1970-01-01 00:00:00 UTC").cast("timestamp") + F.expr(f"INTERVAL {interval}"))).alias("ms")).first().ms


class ClosedWindows(StatefulProcessor):
    """Keeps the closed panes (key, start in ms, count, sum) of a bucket of keys and gives the windows that the watermark has passed,
    as runs: the windows of a key that end from ``low`` to ``high`` and hold the same panes."""

    def __init__(self, size: int, slide: int):
        self.size, self.slide = size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getValueState("panes", "key array<string>, start array<bigint>, n array<bigint>, total array<double>, last bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        yield self.closed([f for f in rows if len(f)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self.closed([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def closed(self, got: list[pd.DataFrame], watermark: int) -> pd.DataFrame:
        upto = watermark // self.slide * self.slide
        key, start, n, total, last = self.panes.get() if self.panes.exists() else ([], [], [], [], None)
        if not got and (last is None or upto <= last):  # the rows of this batch came first
            return runs_of(*(np.array([], kind) for kind in (object, np.int64, np.int64, np.float64)), 0, None, self.size, self.slide, upto)
        known = len(key)
        key, start, n, total = (np.concatenate([np.array(old, kind), *(f[c].to_numpy(kind) for f in got)]) for old, c, kind in ((key, "key", object), (start, "pane", np.int64), (n, "n", np.int64), (total, "total", np.float64)))
        out = runs_of(key, start, n, total, known, last, self.size, self.slide, upto)
        keep = start >= upto + self.slide - self.size  # some later window has them
        if keep.any():
            last = upto if last is None else max(upto, last)
            self.panes.update((key[keep].tolist(), start[keep].tolist(), n[keep].tolist(), total[keep].tolist(), last))
            self.handle.registerTimer(last + self.slide - 1)
        else:
            self.panes.clear()
        return out


def runs_of(key: np.ndarray, start: np.ndarray, n: np.ndarray, total: np.ndarray, known: int, last: int | None, size: int, slide: int, upto: int) -> pd.DataFrame:
    """key, low, high, n and total of the windows with panes that end by ``upto``; those of the first ``known`` panes' keys only if they end after ``last``.

    A key's windows change where a pane enters (the end of the first window that holds it) and where it leaves; from one change to
    the next they hold the same panes, whose sums are taken apart for each run."""
    code, names = pd.factorize(key)
    since = np.full(len(names), np.iinfo(np.int64).min)
    since[code[:known]] = last if known else 0
    order = np.lexsort((start, code))
    code, start, n, total = (x[order] for x in (code, start, n, total))
    at, who = np.concatenate([start + slide, start + size + slide]), np.concatenate([code, code])
    order = np.lexsort((at, who))
    at, who = at[order], who[order]
    same = who[1:] == who[:-1]
    low, high, who = np.maximum(at[:-1], since[who[:-1]] + slide), np.minimum(at[1:] - slide, upto), who[:-1]
    some = same & (low <= high)
    low, high, who = low[some], high[some], who[some]
    base = start.min() if len(start) else 0
    width = (start.max() - base) // slide + size // slide + 2 if len(start) else 1
    place = code * width + (start - base) // slide
    begin = np.searchsorted(place, who * width + np.maximum((low - size - base) // slide, 0))
    end = np.searchsorted(place, who * width + (low - slide - base) // slide, side="right")
    ends = np.column_stack([begin, end]).ravel()
    counts, sums = (np.add.reduceat(np.append(x, x.dtype.type(0)), ends)[::2] if len(ends) else x[:0] for x in (n, total))
    full = begin < end
    return pd.DataFrame({"key": names[who[full]], "low": low[full], "high": high[full], "n": counts[full], "total": sums[full]})


@contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """State on local disks with its changes in the checkpoint folder, for queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliding_stream(df: DataFrame, key: str, at: str, size: str, slide: str, amount: str | None = None, buckets: int = 512) -> DataFrame:
    """Stream form, in append mode: a window's row comes when the watermark of ``at`` has passed its end. Start it within ``large_state``.

    Two stateful steps. The first keeps open panes and gives them on when they close; an event whose pane has closed is late and
    dropped. The second keeps the closed panes of the last ``size`` and, woken by the watermark, gives all windows that ended
    since, as runs of windows with the same panes, which Spark expands. Panes that no later window has are dropped. Its state is
    held for buckets of keys, since a call and a state for each key cost far more than the key's panes; the number of buckets
    stays as it began. The state so holds a value for each pane with events, not one for each of the ``size / slide`` windows.
    """
    size_, slide_ = (milliseconds(df.sparkSession, x) for x in (size, slide))
    if size_ % slide_:
        raise ValueError("the size is a multiple of the slide")
    panes = panes_of(df, key, at, slide, amount).select(F.to_json(F.struct(F.col(key).alias("k"))).alias("key"), F.window_time("window").alias("closed_at"), F.unix_millis("window.start").alias("pane"), "n", F.col("total").cast("double").alias("total"))
    dealt = panes.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    runs = dealt.groupBy("bucket").transformWithStateInPandas(ClosedWindows(size_, slide_), "key string, low long, high long, n long, total double", "Append", "EventTime")
    told = runs.select(F.from_json("key", StructType([StructField("k", df.schema[key].dataType)]))["k"].alias(key), "low", "high", "n", "total")
    rows = told.select(key, F.explode(F.sequence("low", "high", F.lit(slide_))).alias("_end"), "n", "total")
    return rows.select(key, F.timestamp_millis(F.col("_end") - size_).alias("window_start"), F.timestamp_millis("_end").alias("window_end"), "n", *(["total"] if amount else []))


def rolling_feature(df: DataFrame, key: str, at: str, days: int, amount: str, block_hours: int = 24) -> DataFrame:
    """Batch form: count and sum over the days up to each event, both ends included.

    A key's time is cut into blocks. What an event sees is the part of its own block before it, whole blocks between, whose
    totals are few, and the end of the block that many days before. The last is found by sending every row to the later block
    too, moved by the days, so a part holds a block's rows of a key and as many moved ones, never all rows of a key.
    """
    block, reach = block_hours * 3_600_000_000, days * 86_400_000_000
    if reach % block:
        raise ValueError("days are a multiple of the block")
    many = reach // block
    held = df.withColumns({"_s": F.unix_micros(F.col(at).cast("timestamp")), "_v": F.col(amount)}).withColumn("_b", F.floor(F.col("_s") / block))
    sums = held.groupBy(key, "_b").agg(F.count("*").alias("_n"), F.sum("_v").alias("_t"))
    between = Window.partitionBy(key).orderBy("_b").rangeBetween(1 - many, -1)
    totals = sums.select(key, "_b", F.coalesce(F.sum("_n").over(between), F.lit(0)).alias("_n"), F.sum("_t").over(between).alias("_t"), (F.col("_b") * block).alias("_s"), F.lit("total").alias("_is"))
    moved = held.select(key, (F.col("_s") + reach).alias("_s"), "_v", (F.col("_b") + many).alias("_b"), F.lit("moved").alias("_is"))
    both = held.withColumn("_is", F.lit("own")).unionByName(moved, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True)
    part = Window.partitionBy(key, "_b")
    before, after = (part.orderBy("_s").rangeBetween(*x) for x in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    own, far = F.when(F.col("_is") == "own", F.struct("_v")), F.when(F.col("_is") == "moved", F.struct("_v"))
    count = F.count(own).over(before) + F.count(far).over(after) + F.max("_n").over(part)
    parts = F.array(F.sum(own["_v"]).over(before), F.sum(far["_v"]).over(after), F.max("_t").over(part))
    seen = both.withColumns({"n": count, "_p": F.filter(parts, lambda x: x.isNotNull())}).where("_is = 'own'")
    return seen.withColumn("total", F.expr("CASE size(_p) WHEN 1 THEN _p[0] WHEN 2 THEN _p[0] + _p[1] WHEN 3 THEN _p[0] + _p[1] + _p[2] END")).select(*df.columns, "n", "total")


def latest_window(features: DataFrame, key: str) -> DataFrame:
    """The row of the newest window per key."""
    rest = [c for c in features.columns if c != key]
    return features.groupBy(key).agg(F.max_by(F.struct(*rest), "window_end").alias("r")).select(key, "r.*")


def stream_quality(df: DataFrame, col: str = "value") -> DataFrame:
    """Violations (rule, field, payload) of change records; one record may have many."""
    root = F.from_json(F.col(col), "map<string,string>")
    number = lambda f: F.get_json_object(col, f"$.{f}").try_cast("double")

    def violation(test: Column, rule: str, field: str) -> Column:
        return F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field")))

    op = F.col("_m")["op_type"]
    broken = F.col("_m").isNull()
    rules = [violation(broken, "SCHEMA", "payload"), violation(~broken & (op.isNull() | ~op.isin(*OPERATIONS)), "SCHEMA", "op_type")]
    rules += [violation(~broken & (F.coalesce(F.col("_m")[f], F.lit("")) == ""), "COMPLETENESS", f) for f in REQUIRED]
    rules += [violation(~broken & F.coalesce(number(f) < 0, F.lit(False)), "ACCURACY", f) for f in NOT_NEGATIVE]
    found = df.withColumn("_m", root).withColumn("_v", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())))
    return found.select("_v.rule", "_v.field", F.col(col).alias("payload"))


def shape_alert(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload cut to 500 characters, severity HIGH."""
    return df.withColumn(payload, F.substring(payload, 1, 500)).withColumn("severity", F.lit("HIGH"))


def run_available(stream: DataFrame, path: str, mode: str = "append", batch=None):
    """Runs a stream over what is there, to a Parquet folder or a function of each batch; the checkpoint lies beside."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("parquet").option("path", f"{path}/data").start()
    query.awaitTermination()
    return query


def _path(spark: SparkSession, *parts: object):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, parts)))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _ledger(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest committed list of bucket versions (before a batch): its batch, and bucket to the batch that wrote it; (-1, {}) without one."""
    folder, files = _path(spark, path, "ledger")
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    numbers = [int(x) for x in names if x.isdigit() and (before is None or int(x) < before)]
    if not numbers:
        return -1, {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{path}/ledger/{max(numbers)}").collect()  # as many as buckets
    return max(numbers), {r.bucket: r.version for r in rows}


def _bucket_paths(path: str, versions: dict[int, int]) -> list[str]:
    return [f"{path}/state/{v}/bucket={b}" for b, v in versions.items()]


def merge_latest(batch: DataFrame, number: int, key: str, path: str, buckets: int = 32, hours: int = 24) -> None:
    """Keeps the newest window per key in buckets by the key's hash.

    A batch reads and rewrites only the buckets that it touches, as new files, then commits a list of bucket versions: readers
    see the old list or the new one, and a batch that is run again starts from the list before it. Bucket versions that neither
    the new list nor the one before names are deleted. A row also holds when it was written; rows written more than ``hours``
    ago are gone for readers, and for good when their bucket is next rewritten. The number of buckets stays as it began.
    """
    spark = batch.sparkSession
    rows = latest_window(batch.where(F.col(key).isNotNull()), key).withColumns({"written_at": F.current_timestamp(), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    aside = f"{path}/batch/{number}"
    rows.write.mode("overwrite").parquet(aside)
    rows = spark.read.schema(rows.schema).parquet(aside)
    touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most as many as buckets
    last, versions = _ledger(spark, path, number)
    old = {b: v for b, v in versions.items() if b in touched}
    if old:
        stored = spark.read.schema(rows.drop("bucket").schema).parquet(*_bucket_paths(path, old)).where(_fresh(F.current_timestamp(), hours))
        rows = latest_window(rows.drop("bucket").unionByName(stored), key).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    if touched:
        rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/{number}")
    now = versions | {b: number for b in touched}
    ledger = spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1)
    ledger.write.mode("overwrite").parquet(f"{path}/ledger/_{number}")
    (aside_, files), (final, _) = _path(spark, path, "ledger", f"_{number}"), _path(spark, path, "ledger", number)
    files.delete(final, True)
    files.rename(aside_, final)
    earlier = _ledger(spark, path, last)[1] if last >= 0 else {}
    for b, v in earlier.items():  # not named by the new list nor the one before
        if versions.get(b) != v and now.get(b) != v:
            old_path, files = _path(spark, path, "state", v, f"bucket={b}")
            files.delete(old_path, True)
    files.delete(_path(spark, aside)[0], True)


def upsert_latest_features(stream: DataFrame, key: str, path: str, buckets: int = 32, hours: int = 24):
    """Runs a stream of features into ``merge_latest``."""
    return run_available(stream, path, "append", lambda batch, number: merge_latest(batch, number, key, path, buckets, hours))


def _fresh(as_of: Column, hours: int) -> Column:
    return F.col("written_at") > as_of - F.make_interval(hours=F.lit(hours))


def latest_features(spark: SparkSession, path: str, schema, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """What the sink serves: a row per key, of those written within the last hours. ``schema``: that of the features."""
    _, versions = _ledger(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    kept = StructType([*schema.fields, StructField("written_at", TimestampType())])
    rows = spark.read.schema(kept).parquet(*_bucket_paths(path, versions))
    return rows.where(_fresh(F.current_timestamp() if as_of is None else as_of, hours)).select(schema.names)


def write_history(batch: DataFrame, number: int, keys: list[str], path: str, at: str = "window_end") -> None:
    """Appends features so that a key is stored once, whatever batches bring it, and how often.

    Rows lie by day of ``at`` (one of the keys, so equal keys share a day) and by batch. A batch reads the stored keys of its
    own days only and drops what another batch has stored; run again, it replaces its own files. Of equal keys within a batch
    any one row stays; rows with a null key are dropped, as the surveyed sink does.
    """
    if at not in keys:
        raise ValueError(f"{at} is not one of the keys")
    spark = batch.sparkSession
    rows = batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).dropDuplicates(keys).withColumn("day", F.to_date(at))
    days = [r.day for r in rows.select("day").distinct().collect()]  # what a watermark leaves open
    folders = [(day, *_path(spark, path, "history", f"day={day}")) for day in days]
    stored = [f"{path}/history/day={day}" for day, folder, files in folders if files.exists(folder)]
    if stored:
        held = spark.read.schema(StructType([*batch.select(keys).schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/history").parquet(*stored)
        rows = rows.join(held.where(F.col("batch") != number).select(keys), keys, "left_anti")
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/history")


def append_feature_history(stream: DataFrame, keys: list[str], path: str, at: str = "window_end"):
    """Runs a stream of features into ``write_history``."""
    return run_available(stream, path, "append", lambda batch, number: write_history(batch, number, keys, path, at))


def write_alerts(stream: DataFrame, path: str, at: str):
    """Alerts by month, with default severity."""
    shaped = shape_alert(stream).withColumn("month", F.date_format(at, "yyyy-MM"))
    query = shaped.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).partitionBy("month").format("parquet").option("path", f"{path}/data").start()
    query.awaitTermination()
    return query


def live(features: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows whose window ended within the last hours: the age limit on reading."""
    return features.where(F.col("window_end") >= as_of - F.make_interval(hours=F.lit(hours)))
