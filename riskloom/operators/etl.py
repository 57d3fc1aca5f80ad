"""The layered daily ETL: detail, summary and application tables, each a function of DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scalars as S


def safe_rate(part: Column, whole: Column, default: float = 0.0) -> Column:
    """Division before the cast, so that a large count cannot overflow the rate's type; ``default`` for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(default)).cast("decimal(5,4)")


def write_partition(df: DataFrame, path: str, dt: str, name: str = "dt") -> None:
    """Replaces one day's partition and leaves the others."""
    df.withColumn(name, F.lit(dt)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def read_layer(spark: SparkSession, path: str, dt: str, name: str = "dt") -> DataFrame:
    """One day's partition; the filter prunes the others."""
    return spark.read.option("recursiveFileLookup", "false").parquet(path).where(F.col(name) == dt)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stops a run on an empty input."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def loan_detail(apps: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """Applications with labels and the customer's attributes; unknown customers leave nulls."""
    own = customers.select("customer_id", S.age_years(F.col("birth_date"), as_of).alias("customer_age"), F.col("gender").alias("customer_gender"), F.col("education").alias("customer_education"))
    return apps.withColumn("product_name", S.decode(F.col("product_id"), S.PRODUCTS, S.OTHER_PRODUCT)).join(own, "customer_id", "left")


def credit_events(reports: DataFrame, repay: DataFrame, apps: DataFrame) -> DataFrame:
    """Queries, overdue instalments, applications and repayments as one table of events."""
    queries = reports.select(S.event_id("CQ", F.col("id")).alias("event_id"), "customer_id", F.lit("CREDIT_QUERY").alias("event_type"), F.col("query_date").alias("event_date"), F.col("query_institution").alias("institution"))
    overdue = repay.where("overdue_days > 0").select(S.event_id("OD", F.col("id")).alias("event_id"), "customer_id", F.lit("OVERDUE").alias("event_type"), F.col("due_date").alias("event_date"), "loan_id", F.col("repay_amount").alias("amount"), "overdue_days")
    applied = apps.select(S.event_id("AP", F.col("application_no")).alias("event_id"), "customer_id", F.lit("APPLY").alias("event_type"), F.col("apply_date").alias("event_date"), F.col("application_no").alias("loan_id"), F.col("loan_amount").alias("amount"), F.col("channel").alias("institution"))
    repaid = repay.select(S.event_id("RP", F.col("id")).alias("event_id"), "customer_id", F.lit("REPAY").alias("event_type"), F.col("due_date").alias("event_date"), "loan_id", F.col("repay_amount").alias("amount"), "overdue_days")
    out = queries
    for more in (overdue, applied, repaid):
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumn("overdue_days", F.coalesce("overdue_days", F.lit(0)))


def customer_credit_summary(events: DataFrame, as_of: str) -> DataFrame:
    """Look-back counts and amounts per customer, in one aggregation; days after ``as_of`` do not count."""
    day = F.lit(as_of).cast("date")

    def within(kind: str, days: int) -> Column:
        return (F.col("event_type") == kind) & (F.col("event_date") >= F.date_sub(day, days))

    counts = [F.count_if(within(kind, days)).alias(f"{name}_{m}m") for kind, name, ms in (("APPLY", "loan_count", (1, 3, 6, 12)), ("CREDIT_QUERY", "credit_query_count", (1, 3)), ("OVERDUE", "overdue_count", (1, 3, 6, 12)), ("APPLY", "apply_count", (1, 3))) for m, days in ((1, 30), (3, 90), (6, 180), (12, 365)) if m in ms]
    year, repaid = within("APPLY", 365), F.col("event_type") == "REPAY"
    money = F.coalesce(F.sum(F.when(year, F.col("amount"))), F.lit(0).cast("decimal(18,2)"))
    return events.where(F.col("event_date") < F.date_add(day, 1)).groupBy("customer_id").agg(
        *counts,
        money.alias("loan_amount_total_12m"),
        F.coalesce(F.max(F.when(within("OVERDUE", 365), F.col("overdue_days"))), F.lit(0)).alias("max_overdue_days_12m"),
        safe_rate(F.count_if(repaid & (F.col("overdue_days") == 0)), F.count_if(repaid), 1.0).alias("repay_on_time_rate_12m"),
        F.coalesce(F.avg(F.when(year, F.col("amount"))), F.lit(0)).cast("decimal(18,2)").alias("avg_loan_amount_12m"),
    )


def product_summary(detail: DataFrame) -> DataFrame:
    approved = F.count_if(F.col("status") == "APPROVED")
    return detail.groupBy("product_id", "product_name").agg(
        F.count("*").alias("apply_count"),
        approved.alias("approve_count"),
        F.count_if(F.col("status") == "REJECTED").alias("reject_count"),
        safe_rate(approved, F.count("*")).alias("approve_rate"),
        F.coalesce(F.sum("loan_amount"), F.lit(0)).alias("total_loan_amount"),
        F.coalesce(F.avg("loan_amount"), F.lit(0)).alias("avg_loan_amount"),
        F.coalesce(F.avg("loan_term"), F.lit(0)).alias("avg_loan_term"),
    )


def product_overdue(detail: DataFrame, repay: DataFrame, days: int) -> DataFrame:
    """Loans of each product with an instalment overdue for ``days`` or more."""
    late = repay.where(F.col("overdue_days") >= days).select(F.col("loan_id").alias("application_no")).distinct().withColumn("late", F.lit(1))
    joined = detail.join(late, "application_no", "left")
    return joined.groupBy("product_id").agg(F.count("late").alias("overdue_count"), safe_rate(F.count("late"), F.count("*")).alias("overdue_rate"))


def channel_summary(detail: DataFrame, start: str) -> DataFrame:
    """Per channel, with all customers and those whose first application lies in the period from ``start``."""
    first = detail.groupBy("customer_id").agg(F.min("apply_date").alias("first_date"))
    period = detail.where(F.col("apply_date") >= start).join(first, "customer_id")
    approved = F.count_if(F.col("status") == "APPROVED")
    return period.groupBy("channel").agg(
        F.count("*").alias("apply_count"), approved.alias("approve_count"), safe_rate(approved, F.count("*")).alias("approve_rate"), F.coalesce(F.sum("loan_amount"), F.lit(0)).alias("total_loan_amount"),
        F.count_distinct("customer_id").alias("customer_count"), F.count_distinct(F.when(F.col("first_date") >= start, F.col("customer_id"))).alias("new_customer_count"))


def credit_wide(profile: DataFrame, summary: DataFrame, as_of: str) -> DataFrame:
    """Profiles with their summary, zeros where there is none, and the risk level."""
    zero = ["loan_count_12m", "credit_query_count_1m", "credit_query_count_3m", "overdue_count_3m", "overdue_count_6m", "max_overdue_days_12m", "apply_count_1m"]
    both = profile.join(summary, "customer_id", "left").na.fill(0, zero)
    return both.select(
        "customer_id", F.lit(as_of).alias("stat_date"), S.age_years(F.col("birth_date"), as_of).alias("age"), "gender", S.decode(F.col("education"), S.EDUCATION, F.col("education")).alias("education"), "annual_income",
        "loan_count_12m", "credit_query_count_3m", "overdue_count_6m", "max_overdue_days_12m", "apply_count_1m", F.coalesce("repay_on_time_rate_12m", F.lit(1).cast("decimal(5,4)")).alias("repay_on_time_rate"),
        S.risk_level(F.col("overdue_count_3m"), F.col("credit_query_count_1m"), F.col("credit_query_count_3m")).alias("risk_level"))


def decision_analysis(log: DataFrame) -> DataFrame:
    word = S.normalise_result(F.col("decision_result"))
    return log.groupBy("flow_id", "flow_version").agg(
        F.count("*").alias("decision_count"), F.count_if(word == "PASS").alias("pass_count"), F.count_if(word == "REJECT").alias("reject_count"), F.count_if(word == "MANUAL").alias("manual_review_count"),
        safe_rate(F.count_if(word == "PASS"), F.count("*")).alias("pass_rate"), F.coalesce(F.avg("total_score"), F.lit(0)).alias("avg_score"), F.coalesce(F.avg("duration_ms").cast("bigint"), F.lit(0)).alias("avg_duration_ms"))


def amortise(loans: DataFrame, key: str, principal: str, months: str, yearly_rate: float) -> DataFrame:
    """One row per instalment of a level payment: interest and principal in cents; the last one takes the rest.

    The rounding carries over from month to month, so the schedule is a fold over the months of each loan. Amounts are decimals
    within it: half cents round up, which doubles do not always do.
    """
    cents, monthly = "decimal(18,2)", f"CAST({yearly_rate / 12:.12f} AS DECIMAL(14,12))"
    paid = S.monthly_payment(F.col(principal).cast("double"), F.col(months), yearly_rate).cast(cents)
    interest = f"CAST(round(s.left * {monthly}, 2) AS {cents})"
    part = f"CAST(if(m = {months}, s.left, _pay - {interest}) AS {cents})"
    step = f"(s, m) -> named_struct('left', CAST(s.left - {part} AS {cents}), 'rows', concat(s.rows, array(named_struct('month', m, 'interest', {interest}, 'principal', {part}))))"
    empty = f"cast(array() as array<struct<month: int, interest: {cents}, principal: {cents}>>)"
    fold = F.expr(f"aggregate(sequence(1, {months}), named_struct('left', cast({principal} as {cents}), 'rows', {empty}), {step}, s -> s.rows)")
    rows = loans.where(F.col(months) > 0).withColumn("_pay", paid).select(key, F.explode(fold).alias("r"))
    return rows.select(key, "r.month", F.col("r.interest").cast("double").alias("interest"), F.col("r.principal").cast("double").alias("principal"))


def run_day(sources: dict[str, DataFrame], as_of: str) -> dict[str, DataFrame]:
    """All tables of a day from the four sources: detail, events, summaries and the wide table."""
    detail = loan_detail(sources["app"], sources["cust"], as_of)
    events = credit_events(sources["report"], sources["repay"], sources["app"])
    summary = customer_credit_summary(events, as_of)
    return {"detail": detail, "events": events, "summary": summary, "products": product_summary(detail), "wide": credit_wide(sources["cust"], summary, as_of)}
