"""Data quality, classification, lineage and retention."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators.tables import duplicates
from riskloom.sources.ingest import held

# Keywords of column names, in the order in which they are tried, and the masks of the matching kinds.
KEYWORDS = [("bank_card", "TOP_SECRET"), ("bankcard", "TOP_SECRET"), ("card_no", "TOP_SECRET"), ("cardno", "TOP_SECRET"), ("password", "TOP_SECRET"), ("secret", "TOP_SECRET"),
            ("id_card", "CONFIDENTIAL"), ("idcard", "CONFIDENTIAL"), ("identity", "CONFIDENTIAL"), ("phone", "CONFIDENTIAL"), ("mobile", "CONFIDENTIAL"), ("tel", "CONFIDENTIAL"), ("email", "CONFIDENTIAL"), ("address", "CONFIDENTIAL"), ("name", "CONFIDENTIAL"), ("customer_name", "CONFIDENTIAL"),
            ("amount", "INTERNAL"), ("income", "INTERNAL"), ("salary", "INTERNAL"), ("balance", "INTERNAL"), ("debt", "INTERNAL"), ("score", "INTERNAL")]
RANKS = {"PUBLIC": 1, "INTERNAL": 2, "CONFIDENTIAL": 3, "TOP_SECRET": 4}
MASK_OF = {"card_no": "bank_card", "cardno": "bank_card", "bank_card": "bank_card", "bankcard": "bank_card", "id_card": "id_card", "idcard": "id_card", "phone": "mobile", "mobile": "mobile", "tel": "mobile", "email": "email", "address": "address", "name": "name"}
_REFERENCES: dict[str, tuple[DataFrame, str]] = {}


def register_reference(key: str, df: DataFrame, column: str) -> None:
    """Makes a column known to REF: rules."""
    _REFERENCES[key] = (df, column)


def violated(rule: dict) -> Column:
    """Truth of a row's violation of a rule {expression, column}; null passes all but NOT NULL."""
    col, text = F.col(rule["column"]), rule["expression"].strip()
    if text.upper() == "NOT NULL":
        return col.isNull()
    if text.startswith((">=", "<=")):
        number = col.cast("string").try_cast("double")
        bad = number < float(text[2:]) if text[0] == ">" else number > float(text[2:])
        return F.coalesce(bad, F.lit(False))
    if text.upper().startswith("REGEX:"):
        return F.coalesce(~col.cast("string").rlike(f"^(?:{text[6:].strip()})$"), F.lit(False))
    if text.upper().startswith("ENUM:"):
        return F.coalesce(~col.cast("string").isin(*(w.strip() for w in text[5:].split(","))), F.lit(False))
    raise ValueError(f"unknown rule {text}")


def check_quality(df: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """Violation rows (key, rule, dimension, column, severity). Row rules share one scan; UNIQUE and REF: rules add one each."""
    out = None
    per_row = [r for r in rules if not r["expression"].upper().startswith(("UNIQUE", "REF:"))]
    if per_row:
        found = [F.when(violated(r), F.struct(F.lit(r["ruleId"]).alias("rule"), F.lit(r["dimension"]).alias("dimension"), F.lit(r["column"]).alias("column"), F.lit(r["severity"]).alias("severity"))) for r in per_row]
        out = df.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select(key, "v.*")
    for r in rules:
        if r in per_row:
            continue
        if r["expression"].upper().startswith("UNIQUE"):
            bad = duplicates(df.select(*dict.fromkeys([key, r["column"]])), r["column"], [key])
        else:
            reference, column = _REFERENCES[r["expression"][4:].strip()]
            bad = df.where(F.col(r["column"]).isNotNull()).join(reference.select(F.col(column).alias(r["column"])).distinct(), r["column"], "left_anti")
        rows = bad.select(key, F.lit(r["ruleId"]).alias("rule"), F.lit(r["dimension"]).alias("dimension"), F.lit(r["column"]).alias("column"), F.lit(r["severity"]).alias("severity"))
        out = rows if out is None else out.union(rows)
    return out


def check_timeliness(arrivals: DataFrame, rules: dict[str, str], name: str = "table", at: str = "arrived") -> DataFrame:
    """Arrivals later than SLA:HH:mm, or in an hour of the day past SLA:Xh."""
    late = F.lit(False)
    for table, text in rules.items():
        limit = text[4:]
        over = F.hour(at) >= int(limit[:-1]) if limit.lower().endswith("h") else F.date_format(at, "HH:mm") > limit
        late = late | ((F.col(name) == table) & over)
    return arrivals.where(late)


def quality_summary(violations: DataFrame, rows: int, thresholds: dict[str, float]) -> DataFrame:
    """Violations per rule with their share of the checked rows against the rule's threshold (the largest share allowed)."""
    allowed = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    counts = violations.groupBy("rule", "dimension").agg(F.count("*").alias("violations"))
    return counts.withColumn("share", F.col("violations") / F.lit(max(rows, 1))).withColumn("passed", F.col("share") <= F.coalesce(allowed[F.col("rule")], F.lit(0.0)))


def range_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Negative values per column, in one pass."""
    counts = df.agg(*(F.count_if(F.col(c) < 0).alias(c) for c in columns))
    return counts.unpivot([], columns, "column", "negative")


def rollup_status(checks: DataFrame) -> DataFrame:
    """FAIL over WARN over PASS; SKIP only where all checks were skipped."""
    rank = F.when(F.col("status") == "FAIL", 3).when(F.col("status") == "WARN", 2).when(F.col("status") == "PASS", 1).otherwise(0)
    worst = F.max(rank)
    return checks.groupBy("name").agg(F.when(worst == 3, "FAIL").when(worst == 2, "WARN").when(worst == 1, "PASS").otherwise("SKIP").alias("status"))


def sensitivity(col: Column) -> Column:
    """Level of a column name: that of the first keyword it contains."""
    low, out = F.lower(col), None
    for word, level in KEYWORDS:
        out = (F if out is None else out).when(F.contains(low, F.lit(word)), level)
    return out.otherwise("PUBLIC")


def classify_columns(names: DataFrame, col: str = "column_name") -> DataFrame:
    level = sensitivity(F.col(col))
    high = level.isin(*(k for k, r in RANKS.items() if r >= 3))
    return names.withColumn("level", level).withColumn("encrypt", high).withColumn("mask", high)


def mask_frame(df: DataFrame) -> DataFrame:
    """String columns with a sensitive name are masked by the kind of their first matching keyword."""
    masks: dict[str, Callable] = {}
    for name, kind in df.dtypes:
        word = next((w for w, _ in KEYWORDS if w in name.lower()), None)
        if kind == "string" and word in MASK_OF:
            masks[name] = S.MASKS[MASK_OF[word]]
    return df.select(*(masks[c](F.col(c)).alias(c) if c in masks else F.col(c) for c in df.columns))


def lineage_edges(scripts: DataFrame, name: str, text: str) -> DataFrame:
    """(src, dst, transform) of INSERT statements: every table after FROM or JOIN feeds the target."""
    statement = scripts.select(F.col(name).alias("transform"), F.explode(F.split(text, ";")).alias("s"))
    target = F.regexp_extract("s", r"(?i)INSERT\s+(?:OVERWRITE\s+)?(?:INTO\s+)?(?:TABLE\s+)?(\S+)", 1)
    sources = F.regexp_extract_all("s", F.lit(r"(?i)\b(?:FROM|JOIN)\s+([^\s(,]+)"), F.lit(1))
    clean = lambda c: F.lower(F.regexp_replace(c, r"[`\)]", ""))
    rows = statement.where(target != "").select(F.explode(sources).alias("src"), target.alias("dst"), "transform")
    return rows.select(clean(F.col("src")).alias("src"), clean(F.col("dst")).alias("dst"), "transform").where("src <> ''").distinct()


def neighbours(edges: DataFrame, node: str, down: bool = True) -> DataFrame:
    own, other = ("src", "dst") if down else ("dst", "src")
    return edges.where(F.col(own) == node).select(F.col(other).alias("node")).distinct()


def lineage_closure(edges: DataFrame, node: str, down: bool = True) -> DataFrame:
    """All nodes reachable from a node, with the distance; a visited node is not entered again, so cycles end. Joins merge, so no level passes through the driver."""
    own, other = ("src", "dst") if down else ("dst", "src")
    links = held(edges.select(F.col(own).alias("node"), F.col(other).alias("next")).distinct(), "edges")
    seen = new = edges.sparkSession.createDataFrame([(node,)], "node string")
    out, depth = None, 0
    while True:
        depth += 1
        new = held(links.join(new.hint("merge"), "node").select(F.col("next").alias("node")).distinct().join(seen.hint("merge"), "node", "left_anti"), "level")
        level, seen = new.withColumn("depth", F.lit(depth)), seen.union(new)
        if out is not None and new.isEmpty():
            return out
        out = level if out is None else out.union(level)


def catalogue(spark: SparkSession, frames: dict[str, DataFrame], layer: dict[str, str]) -> DataFrame:
    """table, layer, column and type of frames."""
    rows = [(t, layer.get(t, "ODS"), c, k) for t, df in frames.items() for c, k in df.dtypes]
    return spark.createDataFrame(rows, "table_name string, layer string, column_name string, kind string")


def find_tables(metadata: DataFrame, layer: str | None = None, tag: str | None = None, source: str | None = None) -> DataFrame:
    tests = [F.col("layer") == layer] * bool(layer) + [F.array_contains("tags", tag)] * bool(tag) + [F.col("source") == source] * bool(source)
    return metadata.where(reduce(lambda a, b: a & b, tests)) if tests else metadata


def tier_partitions(parts: DataFrame, as_of: str) -> DataFrame:
    """Partitions (layer, created) per tier."""
    return parts.groupBy(S.storage_tier(F.col("layer"), F.col("created"), as_of).alias("tier")).agg(F.count("*").alias("n"))


def retain(df: DataFrame, keys: list[str], order: list[Column], n: int, at: str, oldest: str) -> DataFrame:
    """At most n newest versions per key, none from before ``oldest``."""
    kept = df.where(F.col(at) >= F.lit(oldest).cast("timestamp_ntz"))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
