"""Set operations, reconciliation and row checks between frames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def temporal_violations(repay: DataFrame, loans: DataFrame) -> DataFrame:
    """Instalments due before their loan was applied for."""
    return repay.join(loans.select(F.col("application_no").alias("loan_id"), "apply_date"), "loan_id").where(F.col("due_date") < F.col("apply_date"))


def consistency_check(df: DataFrame, reference: DataFrame, column: str, reference_column: str) -> DataFrame:
    """Rows whose non-null value is not in the reference column."""
    known = reference.select(F.col(reference_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def _columns(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column_name string, kind string")


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or of another type."""
    both = _columns(old).withColumnRenamed("kind", "old").join(_columns(new).withColumnRenamed("kind", "new"), "column_name", "full")
    change = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "TYPE_CHANGED")
    return both.withColumn("change", change).where("change is not null")


def _paths(df: DataFrame, key: str, col: str, depth: int = 6) -> DataFrame:
    """(key, path, value) of the leaves of a JSON object; objects are opened level by level, arrays are leaves."""
    level = df.select(key, F.lit("").alias("path"), F.col(col).alias("value"))
    leaves = None
    for _ in range(depth):
        opened = level.select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
        opened = opened.select(key, F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "name").alias("path"), "value")
        inner = F.startswith(F.ltrim("value"), F.lit("{"))
        flat = opened.where(F.coalesce(~inner, F.lit(True)))
        leaves = flat if leaves is None else leaves.union(flat)
        level = opened.where(inner)
    return leaves.union(level.select(key, "path", "value"))


def artefact_diff(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Leaves of two JSON objects per key that were added, removed or modified; nesting beyond six levels compares as text."""
    a = _paths(df, key, old).withColumnRenamed("value", "old_value").withColumn("_a", F.lit(1))
    b = _paths(df, key, new).withColumnRenamed("value", "new_value").withColumn("_b", F.lit(1))
    change = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "MODIFIED")
    return a.join(b, [key, "path"], "full").withColumn("change", change).where("change is not null").drop("_a", "_b")


def reconcile_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, n) against (name, n): within 5 % passes, within 15 % warns; a missing side counts 0."""
    both = expected.withColumnRenamed("n", "expected").join(actual.withColumnRenamed("n", "actual"), "name", "full").na.fill(0)
    off = F.abs(F.col("expected") - F.col("actual"))
    return both.withColumn("status", F.when(off <= F.col("expected") * 0.05, "PASS").when(off <= F.col("expected") * 0.15, "WARN").otherwise("FAIL"))


def reconcile_rows(a: DataFrame, b: DataFrame, key: str, fraction: float) -> DataFrame:
    """Keys of a hash-chosen fraction whose rows differ or are on one side only."""
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(fraction * 1_000_000)
    columns = sorted(c for c in a.columns if c != key)
    left = a.where(chosen).select(key, F.xxhash64(*columns).alias("_a"))
    right = b.where(chosen).select(key, F.xxhash64(*columns).alias("_b"))
    status = F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(F.col("_a") != F.col("_b"), "DIFFERENT")
    return left.join(right, key, "full").select(key, status.alias("status")).where("status is not null")
