"""Reports over decision logs and facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import normalise_result


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _is(word: str) -> Column:
    return normalise_result(F.col("decision_result")) == word


def business_report(facts: DataFrame, overdue_days: int = 90) -> DataFrame:
    """Totals, approval rate, amounts and the share of bad amounts. facts: status, loan_amount, overdue_days."""
    bad = F.sum(F.when(F.col("overdue_days") >= overdue_days, F.col("loan_amount")))
    approved = F.count_if(F.col("status") == "APPROVED")
    return facts.agg(F.count("*").alias("total"), approved.alias("approved"), _rate(approved, F.count("*")).alias("approve_rate"), F.sum("loan_amount").cast("double").alias("amount"), F.coalesce(F.try_divide(bad.cast("double"), F.sum("loan_amount").cast("double")), F.lit(0.0)).alias("bad_share"))


def channel_report(facts: DataFrame) -> DataFrame:
    approved = F.count_if(F.col("status") == "APPROVED")
    return facts.groupBy("channel").agg(F.count("*").alias("n"), _rate(approved, F.count("*")).alias("conversion"), F.sum("loan_amount").cast("double").alias("amount")).orderBy(F.desc("n"), "channel")


def quality_report(metrics: DataFrame) -> DataFrame:
    """Mean score and violations per dimension, and over all: from 95 PASS, from 80 WARNING, else FAIL."""
    status = lambda c: F.when(c >= 95, "PASS").when(c >= 80, "WARNING").otherwise("FAIL")
    each = metrics.groupBy("dimension").agg(F.avg("score").alias("score"), F.sum("violations").alias("violations"))
    return each.union(each.agg(F.lit("OVERALL"), F.avg("score"), F.sum("violations"))).withColumn("status", status(F.col("score")))


def rule_hits(log: DataFrame) -> DataFrame:
    """Decisions that each rule hit and their share of all; a rule listed twice in one decision counts once."""
    total = log.agg(F.count("*").alias("total"))
    hits = log.select(F.explode(F.array_distinct("hit_rules")).alias("rule")).groupBy("rule").agg(F.count("*").alias("hits"))
    return hits.join(F.broadcast(total), F.lit(True)).select("rule", "hits", (F.col("hits") / F.col("total")).alias("hit_rate"))


def hit_rank(log: DataFrame, n: int = 10) -> DataFrame:
    return rule_hits(log).orderBy(F.desc("hits"), "rule").limit(n)


def daily_stats(log: DataFrame, start: str, end: str, fill: bool = False) -> DataFrame:
    """Counts by result and the mean score per day; ``fill`` adds the days without decisions."""
    days = log.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("day").agg(
        F.count("*").alias("total"), F.count_if(_is("PASS")).alias("passed"), F.count_if(_is("REJECT")).alias("rejected"), F.count_if(_is("MANUAL")).alias("manual"), F.avg("total_score").cast("double").alias("mean_score"))
    if not fill:
        return days
    every = log.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return every.join(days, "day", "left").na.fill(0, ["total", "passed", "rejected", "manual"])


def risk_distribution(log: DataFrame, level: Column) -> DataFrame:
    return log.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def pass_rate_trend(log: DataFrame, granularity: str) -> DataFrame:
    """Share of passes in percent, two decimals, by day, week or month."""
    period = F.date_format(F.date_trunc(granularity, F.col("ts")), "yyyy-MM-dd")
    return log.groupBy(period.alias("period")).agg(F.count("*").alias("total"), F.round(F.count_if(_is("PASS")) * 100 / F.count("*"), 2).alias("pass_rate"))


def log_stats(log: DataFrame, start: str, end: str) -> DataFrame:
    day = F.col("operated_at").cast("date")
    return log.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy(day.alias("day"), "action").agg(F.count("*").alias("n"))


def score_histogram(log: DataFrame, score: str, low: float = 0, high: float = 100, step: float = 20) -> DataFrame:
    """Counts of equal bins, the last one closed, empty ones included; scores outside are left out."""
    last = int((high - low) / step) - 1
    inside = log.where(F.col(score).between(low, high)).groupBy(F.least(F.floor((F.col(score) - low) / step), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return log.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin")).join(inside, "bin", "left").na.fill(0, ["n"])


def score_bands(log: DataFrame, score: str, edges: list[float], words: list[str]) -> DataFrame:
    """Bands [edge, next edge) against results."""
    band = F.lit(0)
    for edge in edges:
        band = band + F.when(F.col(score) >= edge, 1).otherwise(0)
    return log.groupBy(band.alias("band")).pivot("decision_result", words).agg(F.count(F.lit(1))).na.fill(0)


def time_trends(log: DataFrame, pattern: str) -> DataFrame:
    """Rates and means by a date pattern: yyyy-MM-dd for days, HH for the hour of the day."""
    return log.groupBy(F.date_format("ts", pattern).alias("period")).agg(F.count("*").alias("n"), (F.count_if(_is("PASS")) / F.count("*")).alias("pass_rate"), F.avg("duration_ms").alias("mean_duration"))


def overview(log: DataFrame) -> DataFrame:
    n = F.count("*")
    return log.agg(n.alias("total"), *(F.count_if(_is(w)).alias(w.lower()) for w in ("PASS", "REJECT", "MANUAL")), _rate(F.count_if(_is("PASS")), n).alias("pass_rate"), _rate(F.count_if(_is("REJECT")), n).alias("reject_rate"), F.avg("duration_ms").alias("mean_duration"))


def percentile_index(df: DataFrame, keys: list[str], col: str, percents: list[int]) -> DataFrame:
    """The element at int(n p / 100), the last at most, of each group's sorted values; ranks come from counts per value."""
    from pyspark.sql import Window

    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_to": upto, "_all": F.sum("_n").over(w)})
    at = {p: F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1) for p in percents}
    return ranked.groupBy(*keys).agg(*(F.max(F.when((at[p] < F.col("_to")) & (at[p] >= F.col("_to") - F.col("_n")), F.col(col))).alias(f"p{p}") for p in percents))


def p99_latency(log: DataFrame, approximate: bool = False) -> DataFrame:
    """Nearest-rank 99th percentile of the duration."""
    return log.agg((F.approx_percentile("duration_ms", 0.99) if approximate else F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ms)")).cast("bigint").alias("p99"))


def today_overview(log: DataFrame, day: str) -> DataFrame:
    n = F.count("*")
    return log.where(F.col("day") == F.lit(day).cast("date")).agg(n.alias("total"), _rate(F.count_if(_is("PASS")), n).alias("pass_rate"), _rate(F.count_if(_is("REJECT")), n).alias("reject_rate"))


def entity_credit_summary(log: DataFrame, since: str) -> DataFrame:
    """Per customer: decisions, passes, amounts and the largest number of the JSON snapshot."""
    from riskloom.functions.scalars import json_number

    return log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("customer_id").agg(F.count("*").alias("n"), F.count_if(_is("PASS")).alias("passed"), F.sum("total_score").cast("double").alias("amount"), F.max(json_number(F.col("snapshot"), "overdue")).alias("max_overdue"))


def risk_signals(log: DataFrame, since: str) -> DataFrame:
    """One row per customer and kind of signal with its count and level."""
    counts = log.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).groupBy("customer_id").agg(F.count_if(_is("REJECT")).alias("rejected"), F.count_if(F.col("duration_ms") > 90).alias("slow"))
    rows = counts.unpivot("customer_id", ["rejected", "slow"], "kind", "n").where("n > 0")
    return rows.withColumn("level", F.when(F.col("n") >= 5, "HIGH").when(F.col("n") >= 2, "MEDIUM").otherwise("LOW"))


def tier_stats(customers: DataFrame, loans: DataFrame, repay: DataFrame) -> DataFrame:
    """Per tier: customers, mean income, loans, share of instalments overdue. customers carry ``tier``."""
    n = loans.groupBy("customer_id").agg(F.count("*").alias("loans"))
    r = repay.groupBy("customer_id").agg(F.count("*").alias("paid"), F.count_if(F.col("overdue_days") > 0).alias("late"))
    both = customers.join(n, "customer_id", "left").join(r, "customer_id", "left").na.fill(0, ["loans", "paid", "late"])
    return both.groupBy("tier").agg(F.count("*").alias("customers"), F.avg("annual_income").cast("double").alias("mean_income"), F.sum("loans").alias("loans"), _rate(F.sum("late"), F.sum("paid")).alias("late_share"))


def monthly_distribution(**dated: tuple[DataFrame, str]) -> DataFrame:
    """Rows of each kind per month side by side."""
    out = None
    for kind, (df, col) in dated.items():
        months = df.groupBy(F.date_format(col, "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = months if out is None else out.unionByName(months)
    return out.groupBy("month").pivot("kind", list(dated)).agg(F.sum("n")).na.fill(0)


def profile_column(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count_distinct(col).alias("distinct"), F.count(col).alias("filled"))


def decision_qps(log: DataFrame, day: str) -> DataFrame:
    """Decisions per second of a day, one at least."""
    return log.where(F.col("day") == F.lit(day).cast("date")).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 86400)).cast("bigint").alias("qps"))
