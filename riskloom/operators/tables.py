"""Filters, lookups, versions, pages and other operators on whole frames."""

from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskloom.sources.ingest import held, scratch


def filter_samples(df: DataFrame, spec: dict) -> DataFrame:
    """A pair of texts is an inclusive range, a list the allowed values; null never passes."""
    tests = [F.col(c).between(F.lit(v[0]), F.lit(v[1])) if isinstance(v, tuple) else F.col(c).isin(*v) for c, v in spec.items()]
    return df.where(reduce(and_, tests)) if tests else df


def filter_log(df: DataFrame, start: str | None = None, end: str | None = None, day_col: str = "day", **equal) -> DataFrame:
    """Equality for the parameters given, and a range of days."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    tests += [F.col(day_col) >= start] * bool(start) + [F.col(day_col) <= end] * bool(end)
    return df.where(reduce(and_, tests)) if tests else df


def match_any(df: DataFrame, must: Column, should: list[Column]) -> DataFrame:
    """Rows that meet ``must`` and at least one of ``should``."""
    return df.where(must & reduce(or_, (F.coalesce(s, F.lit(False)) for s in should)))


def search_log(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows of which any of the columns equals the word."""
    return df.where(reduce(or_, (F.coalesce(F.col(c).cast("string") == word, F.lit(False)) for c in columns)))


_TYPES = {"INTEGER": "int", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean"}


def map_features(df: DataFrame, mappings: list[tuple], keep: list[str]) -> DataFrame:
    """(source, name, type, default): renamed, cast, default where null or unreadable."""
    return df.select(*keep, *(F.coalesce(F.col(s).cast("string").try_cast(_TYPES[t]), F.lit(v).cast(_TYPES[t])).alias(n) for s, n, t, v in mappings))


def trace_report(log: DataFrame, level: int) -> DataFrame:
    """Level 1: result; 2: with score; 3: with rules and time; 4: with every input."""
    if level not in (1, 2, 3, 4):
        raise ValueError("level is 1 to 4")
    columns = ["trace_id", "decision_result"] + ["total_score"] * (level >= 2) + ["hit_rules", "duration_ms"] * (level >= 3)
    entries = F.transform("hit_rules", lambda r: F.struct(r.alias("rule"), F.lit("RULE").alias("kind"))).alias("hit_rules")
    extra = [F.to_json(F.struct(*(c for c in log.columns if c not in columns))).alias("inputs")] * (level == 4)
    return log.select(*(entries if c == "hit_rules" else c for c in columns), *extra)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; rows equal in that order are interchangeable."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def version_history(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most the first n rows per key, numbered by ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows of the highest version per key."""
    return df.join(df.groupBy(*keys).agg(F.max(version).alias(version)), [*keys, version])


def _name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str) -> DataFrame:
    """Adds ``out``, a struct of columns of the row before in the order within the keys; null for a key's first row.

    Rows are dealt by ranges of keys and order, so a key with very many rows is in many tasks. Each range looks within itself; the
    first rows of a key's later ranges get the last row of the range before, from a table of the keys that lie in several ranges,
    which are no more than the ranges. The dealt rows are a table, since ranges dealt anew might have other edges.
    """
    part, own, near, edge = (_name(df, n) for n in ("range", "own", "near", "edge"))
    dealt = held(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()).withColumn(own, F.struct(*(F.col(f"`{c}`") for c in columns))), "ranges")
    ends = dealt.groupBy(*keys, part).agg(F.max_by(own, F.struct(*order)).alias(edge))
    spread = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(part, edge))).alias(near)).where(F.size(near) > 1)  # at most one per range
    carried = spread.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.posexplode(F.slice(near, 1, F.size(near) - 1)).alias("_i", "_e"), F.col(near).alias("_all"))
    carried = carried.select(*(f"_k{i}" for i in range(len(keys))), F.get("_all", F.col("_i") + 1)[part].alias("_p"), F.col(f"_e.{edge}").alias("_last"))
    first = Window.partitionBy(*keys, part).orderBy(*order)
    seen = dealt.withColumn(near, F.lag(own).over(first)).withColumn(edge, F.row_number().over(first) == 1)
    on = reduce(and_, (seen[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)), seen[part] == carried["_p"])
    both = seen.join(F.broadcast(carried), on, "left")
    return both.select(*(seen[c] for c in df.columns), F.when(seen[edge], F.col("_last")).otherwise(seen[near]).alias(out))


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``previous_<column>`` from the row before."""
    was = _name(df, "was")
    rows = previous_row(df, keys, order, columns, was)
    return rows.select(*df.columns, *(F.col(was)[c].alias(f"previous_{c}") for c in columns))


def duplicates(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Second and later rows of a non-null value: those with a row before."""
    was = _name(df, "was")
    return previous_row(df.where(F.col(col).isNotNull()), [col], order, [col], was).where(F.col(was).isNotNull()).select(df.columns)


def page(df: DataFrame, order: list[Column], number: int, size: int, shallow: int = 50_000) -> tuple[DataFrame, int]:
    """Rows of one page (from 1) and the number of all rows.

    Down to ``shallow`` rows the first rows of the order are taken. Beyond, the rows are dealt by ranges of the order into a
    table with a folder for each range; their counts tell which ranges hold the page, and only these are opened and sorted.
    """
    start = (number - 1) * size
    if start + size <= shallow:
        return df.orderBy(*order).offset(start).limit(size), df.count()
    spark, part, path = df.sparkSession, _name(df, "range"), scratch(df.sparkSession, "pages")
    df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()).write.partitionBy(part).parquet(path)
    dealt = spark.read.schema(StructType([*df.schema.fields, StructField(part, IntegerType())])).parquet(path)
    before, kept, first = 0, [], None
    for row in sorted(dealt.groupBy(part).count().collect()):  # a row for each range
        if before < start + size and before + row[1] > start:
            first = before if first is None else first
            kept.append(row[0])
        before += row[1]
    rows = dealt.where(F.col(part).isin(kept)).select(df.columns)
    return rows.orderBy(*order).offset(start - (first or 0)).limit(size), before


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_anti")


def lookup_tiered(df: DataFrame, hot: DataFrame, cold: DataFrame, key: str, variables: list[str]) -> DataFrame:
    """Each variable from the hot store, else the cold one, with the store that answered; one row per key in a store."""
    h = hot.select(key, *(F.col(v).alias(f"_h_{v}") for v in variables))
    c = cold.select(key, *(F.col(v).alias(f"_c_{v}") for v in variables))
    both = df.join(h, key, "left").join(c, key, "left")
    for v in variables:
        both = both.withColumn(v, F.coalesce(f"_h_{v}", f"_c_{v}")).withColumn(f"{v}_source", F.when(F.col(f"_h_{v}").isNotNull(), "HOT").when(F.col(f"_c_{v}").isNotNull(), "COLD").otherwise("NONE"))
    return both.drop(*(f"_{s}_{v}" for s in "hc" for v in variables))


def enterprise_profile(base: DataFrame, key: str, **sources: DataFrame) -> DataFrame:
    """Left joins of named sources (one row per key) with ``coverage``, the share of sources that know the key."""
    out, flags = base, []
    for name, source in sources.items():
        out = out.join(source.withColumn(f"_has_{name}", F.lit(1)), key, "left")
        flags.append(f"_has_{name}")
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f), F.lit(0)) for f in flags))
    return out.withColumn("coverage", (total / len(flags)).cast("double")).drop(*flags)


def feature_vector(features: DataFrame, key: str, kind: str, value: str, order: str, types: list[str]) -> DataFrame:
    """The latest value of each type side by side."""
    return features.groupBy(key).pivot(kind, types).agg(F.max_by(value, order))


def federated_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Join of frames from two sources; each side keeps its own pushed filters."""
    return left.join(right, on)


def incremental_extract(df: DataFrame, ts_col: str, day: str) -> DataFrame:
    """Rows of one day, as a range on the raw column so that the filter reaches the source."""
    start = F.lit(day).cast("date").cast(df.schema[ts_col].dataType)
    return df.where((F.col(ts_col) >= start) & (F.col(ts_col) < F.date_add(F.lit(day).cast("date"), 1).cast(df.schema[ts_col].dataType)))


def scan_recent_months(df: DataFrame, month_col: str, as_of: str, n: int) -> DataFrame:
    """Rows of the last n months (yyyy-MM texts), the month of ``as_of`` included."""
    first = F.date_format(F.add_months(F.lit(as_of).cast("date"), 1 - n), "yyyy-MM")
    return df.where((F.col(month_col) >= first) & (F.col(month_col) <= as_of[:7]))


def top_terms(df: DataFrame, col: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def top_percent(df: DataFrame, score: str, percent: float, tie: str) -> DataFrame:
    """The rows of the highest scores, floor(percent of all) but at least one; ties by the tie column.

    The scores are counted first, so only the rows at the cutting score are ranked.
    """
    total = df.count()
    keep = max(1, int(total * percent / 100)) if total else 0
    counts = df.groupBy(score).agg(F.count("*").alias("_m"))
    above = ordered_running(counts, score, ["_m"], descending=True).withColumnRenamed("_m_before", "_before")
    cut = above.where(F.col("_before") < keep).select(score, (F.lit(keep) - F.col("_before")).alias("_room"), "_m")
    whole = cut.where("_m <= _room").select(score)
    part = df.join(cut.where("_m > _room").select(score, "_room"), score).withColumn("_n", F.row_number().over(Window.partitionBy(score).orderBy(tie))).where("_n <= _room")
    return df.join(whole, score, "left_semi").unionByName(part.select(df.columns))


def ordered_running(df: DataFrame, order: str | list[str], sums: list[str], descending: bool = False) -> DataFrame:
    """Adds ``<c>_before``: the sum over rows earlier in the order, of distinct order values, for whole-number columns.

    The rows are dealt by ranges of the order and sorted once; each range sums up as it streams by, in batches, so neither a
    window nor a task's memory holds a range. The ranges' totals, one row for each, are summed apart and sent back. The dealt rows are
    a table, since ranges dealt anew might have other edges.
    """
    order = [order] if isinstance(order, str) else order
    way = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    dealt = df.repartitionByRange(*way).sortWithinPartitions(*way).withColumn("_range", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = dict.fromkeys(sums, 0)
        for batch in batches:
            added = []
            for c in sums:
                own = pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False)
                after = np.cumsum(own) + upto[c]
                added.append(pa.array(after - own))
                upto[c] = int(after[-1]) if len(after) else upto[c]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f"{c}_before" for c in sums)])

    summed = held(dealt.mapInArrow(run, StructType([*dealt.schema.fields, *(StructField(f"{c}_before", LongType()) for c in sums)])), "ranges")
    totals = summed.groupBy("_range").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    past = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", *(F.coalesce(F.sum(f"_{c}").over(past), F.lit(0)).alias(f"_{c}_base") for c in sums))  # a row for each range
    out = summed.join(F.broadcast(base), "_range")
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}_base") for c in sums}).drop("_range", *(f"_{c}_base" for c in sums))
