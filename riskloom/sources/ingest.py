"""Sources and sinks besides plain tables: JSON lines, change streams, logs and report files."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared checkpoint folder; a local one only in local mode without that setting, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def held(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, read from there and deleted when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def route_changes(changes: DataFrame, routes: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``topic`` by (database, table); changes without a route are dropped. The routes are a short list by nature."""
    table = changes.sparkSession.createDataFrame(routes, "database string, table string, topic string")
    return changes.join(F.broadcast(table), ["database", "table"])


def flatten_change(df: DataFrame, col: str, schema: str) -> DataFrame:
    """``op_type`` and the fields of the row after the change, or before it where there is none after."""
    parsed = df.select(F.from_json(col, f"op_type string, before struct<{_struct(schema)}>, after struct<{_struct(schema)}>").alias("c"))
    return parsed.select("c.op_type", F.coalesce("c.after", "c.before").alias("r")).select("op_type", "r.*")


def _struct(schema: str) -> str:
    return ", ".join(":".join(field.split(None, 1)) for field in schema.split(", "))


ACCESS = r'^(\S+) (\S+) (\S+) \[([^\]]*)\] "(\S+) +(\S*?)(?: +\S*)?" (\S*) (\S*)(?: "([^"]*)")?'


def parse_access_log(df: DataFrame, col: str) -> DataFrame:
    """Nine fields of an access-log line; code and size as numbers, null where unreadable."""
    names = ["remote", "host", "user", "time", "method", "path", "code", "size", "referer"]
    out = df.withColumns({n: F.regexp_extract(col, ACCESS, i + 1) for i, n in enumerate(names)})
    return out.withColumn("code", F.col("code").try_cast("int")).withColumn("size", F.col("size").try_cast("bigint"))


def parse_app_log(df: DataFrame, col: str, source: str, collected: Column) -> DataFrame:
    """Fields of a JSON log line with where and when it was collected."""
    return df.withColumn("_j", F.from_json(col, "level string, message string, time string")).select("*", "_j.*").drop("_j").withColumn("source", F.lit(source)).withColumn("collected", collected)


def export_report(sections: dict[str, DataFrame], path: str) -> None:
    """A folder with one CSV file per section; sections are aggregates."""
    for name, df in sections.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
