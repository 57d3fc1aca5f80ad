"""Queries of the reports (A-09 to A-30) and T-01."""

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import reports as R
from riskloom.plans.registry import register
from riskloom.sources.bindings import ctes, frame
from riskloom.sources.tables import table

_PASS, _MAN = "decision_result = 'PASS'", "decision_result IN ('MANUAL', 'REVIEW')"
_FACT = ", x AS (SELECT loan_id, max(overdue_days) AS overdue_days FROM repay GROUP BY 1), fact AS (SELECT app.*, coalesce(overdue_days, 0) AS overdue_days FROM app LEFT JOIN x ON loan_id = application_no) "


def _facts(spark, d):
    late = frame(spark, d, "repay").groupBy(F.col("loan_id").alias("application_no")).agg(F.max("overdue_days").alias("overdue_days"))
    return frame(spark, d, "app").join(late, "application_no", "left").na.fill(0, ["overdue_days"])


def _log(spark, d):
    return frame(spark, d, "log")


def _text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@register("a09_business_report", ctes("app", "repay") + _FACT + "SELECT count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'APPROVED') / count(*) AS approve_rate, sum(loan_amount)::DOUBLE AS amount, (sum(loan_amount) FILTER (overdue_days >= 40))::DOUBLE / sum(loan_amount)::DOUBLE AS bad_share FROM fact")
def a09(spark, d):
    return R.business_report(_facts(spark, d), 40)


@register("a10_channel_report", ctes("app") + "SELECT channel, count(*) AS n, count(*) FILTER (status = 'APPROVED') / count(*) AS conversion, sum(loan_amount)::DOUBLE AS amount FROM app GROUP BY 1")
def a10(spark, d):
    return R.channel_report(frame(spark, d, "app"))


_MET = "SELECT concat('D', event_id % 5) AS dimension, CAST(70 + event_id % 5 * 7 AS DOUBLE) AS score, event_id % 3 AS violations FROM events"


@register("a11_quality_report", f"WITH e AS (SELECT dimension, avg(score) AS score, sum(violations)::BIGINT AS violations FROM ({_MET}) GROUP BY 1), u AS (SELECT * FROM e UNION ALL SELECT 'OVERALL', avg(score), sum(violations)::BIGINT FROM e) SELECT *, CASE WHEN score >= 95 THEN 'PASS' WHEN score >= 80 THEN 'WARNING' ELSE 'FAIL' END AS status FROM u")
def a11(spark, d):
    return R.quality_report(table(spark, d, "events").selectExpr("concat('D', event_id % 5) AS dimension", "CAST(70 + event_id % 5 * 7 AS DOUBLE) AS score", "event_id % 3 AS violations"))


_HITS = ", h AS (SELECT rule, count(*) AS hits FROM (SELECT unnest(list_distinct(hit_rules)) AS rule FROM log) GROUP BY 1)"


@register("a12_rule_hits", ctes("log") + _HITS + "SELECT rule, hits, hits / (SELECT count(*) FROM log) AS hit_rate FROM h")
def a12(spark, d):
    return R.rule_hits(_log(spark, d))


@register("t01_hit_rank", ctes("log") + _HITS + "SELECT rule, hits, hits / (SELECT count(*) FROM log) AS hit_rate FROM h ORDER BY hits DESC, rule LIMIT 3")
def t01(spark, d):
    return R.hit_rank(_log(spark, d), 3)


_DAY = f"count(*) AS total, count(*) FILTER ({_PASS}) AS passed, count(*) FILTER (decision_result = 'REJECT') AS rejected, count(*) FILTER ({_MAN}) AS manual, round(sum(total_score)::DOUBLE / count(*), 2) AS mean_score"


@register("a13_daily_stats", ctes("log") + f"SELECT day::VARCHAR AS day, {_DAY} FROM log WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1")
def a13(spark, d):
    return _text(R.daily_stats(_log(spark, d), "2024-01-05", "2024-01-12"), "day").withColumn("mean_score", F.round("mean_score", 2))


@register("a14_daily_stats_filled", ctes("log") + f", s AS (SELECT day, {_DAY} FROM log GROUP BY 1) SELECT strftime(g, '%Y-%m-%d') AS day, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, coalesce(rejected, 0) AS rejected, coalesce(manual, 0) AS manual, mean_score FROM generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-01-04', INTERVAL 1 DAY) t(g) LEFT JOIN s ON s.day = g::DATE")
def a14(spark, d):
    return _text(R.daily_stats(_log(spark, d), "2023-12-28", "2024-01-04", fill=True), "day").withColumn("mean_score", F.round("mean_score", 2))


@register("a15_risk_distribution", ctes("log") + "SELECT CASE WHEN total_score >= 650 THEN 'A' WHEN total_score >= 550 THEN 'B' WHEN total_score >= 500 THEN 'C' ELSE 'D' END AS level, count(*) AS n FROM (SELECT total_score + 400 AS total_score FROM log) GROUP BY 1")
def a15(spark, d):
    return R.risk_distribution(_log(spark, d), S.grade(F.col("total_score") + 400))


@register("a16_pass_rate_trend", ctes("log") + f"SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, count(*) AS total, round(count(*) FILTER ({_PASS}) * 100.0::DOUBLE / count(*), 2) AS pass_rate FROM log GROUP BY 1")
def a16(spark, d):
    return R.pass_rate_trend(_log(spark, d), "week")


@register("a17_log_stats", ctes("audit") + "SELECT CAST(operated_at AS DATE)::VARCHAR AS day, action, count(*) AS n FROM audit WHERE CAST(operated_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-14' GROUP BY 1, 2")
def a17(spark, d):
    return _text(R.log_stats(frame(spark, d, "audit"), "2024-01-10", "2024-01-14"), "day")


@register("a18_score_histogram", ctes("log") + "SELECT b::INT AS bin, count(total_score) AS n FROM range(5) t(b) LEFT JOIN log ON total_score BETWEEN 0 AND 100 AND least(floor(total_score / 20), 4) = b GROUP BY 1")
def a18(spark, d):
    return R.score_histogram(_log(spark, d), "total_score")


@register("a19_score_bands", ctes("log") + f"SELECT ((total_score >= 30)::INT + (total_score >= 80)::INT + (total_score >= 200)::INT) AS band, count(*) FILTER ({_PASS}) AS PASS, count(*) FILTER (decision_result = 'REJECT') AS REJECT FROM log GROUP BY 1")
def a19(spark, d):
    return R.score_bands(_log(spark, d), "total_score", [30, 80, 200], ["PASS", "REJECT"])


@register("a20_time_trends", ctes("log") + f"SELECT strftime(ts, '%H') AS period, count(*) AS n, count(*) FILTER ({_PASS}) / count(*) AS pass_rate, avg(duration_ms) AS mean_duration FROM log GROUP BY 1")
def a20(spark, d):
    return R.time_trends(_log(spark, d), "HH")


@register("a21_overview", ctes("log") + f"SELECT count(*) AS total, count(*) FILTER ({_PASS}) AS pass, count(*) FILTER (decision_result = 'REJECT') AS reject, count(*) FILTER ({_MAN}) AS manual, count(*) FILTER ({_PASS}) / count(*) AS pass_rate, count(*) FILTER (decision_result = 'REJECT') / count(*) AS reject_rate, avg(duration_ms) AS mean_duration FROM log")
def a21(spark, d):
    return R.overview(_log(spark, d))


@register("a22_percentile_index", "SELECT event_type, list_sort(list(value))[1 + least(count(*) * 50 // 100, count(*) - 1)] AS p50, list_sort(list(value))[1 + least(count(*) * 95 // 100, count(*) - 1)] AS p95 FROM events GROUP BY 1")
def a22(spark, d):
    return R.percentile_index(table(spark, d, "events"), ["event_type"], "value", [50, 95])


@register("a23_p99_latency", ctes("log") + "SELECT quantile_disc(duration_ms, 0.99) AS p99 FROM log")
def a23(spark, d):
    return R.p99_latency(_log(spark, d))


@register("a24_today_overview", ctes("log") + f"SELECT count(*) AS total, count(*) FILTER ({_PASS}) / count(*) AS pass_rate, count(*) FILTER (decision_result = 'REJECT') / count(*) AS reject_rate FROM log WHERE day = DATE '2024-01-15'")
def a24(spark, d):
    return R.today_overview(_log(spark, d), "2024-01-15")


@register("a25_entity_credit_summary", ctes("log") + f"SELECT customer_id, count(*) AS n, count(*) FILTER ({_PASS}) AS passed, sum(total_score)::DOUBLE AS amount, max(k)::DOUBLE AS max_overdue FROM log WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def a25(spark, d):
    log = _log(spark, d).withColumn("snapshot", F.to_json(F.struct(F.col("k").alias("overdue"))))
    return R.entity_credit_summary(log, "2024-01-10")


@register("a26_risk_signals", ctes("log") + ", c AS (SELECT customer_id, count(*) FILTER (decision_result = 'REJECT') AS rejected, count(*) FILTER (duration_ms > 90) AS slow FROM log WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), u AS (SELECT customer_id, 'rejected' AS kind, rejected AS n FROM c UNION ALL SELECT customer_id, 'slow', slow FROM c) SELECT *, CASE WHEN n >= 5 THEN 'HIGH' WHEN n >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM u WHERE n > 0")
def a26(spark, d):
    return R.risk_signals(_log(spark, d), "2024-01-20")


@register("a27_tier_stats", ctes("app", "cust", "repay") + """, n AS (SELECT customer_id, count(*) AS loans FROM app GROUP BY 1), r AS (SELECT customer_id, count(*) AS paid, count(*) FILTER (overdue_days > 0) AS late FROM repay GROUP BY 1)
SELECT industry AS tier, count(*) AS customers, round(sum(annual_income)::DOUBLE / count(*), 3) AS mean_income, sum(coalesce(loans, 0))::BIGINT AS loans, sum(coalesce(late, 0)) / sum(coalesce(paid, 0)) AS late_share FROM cust LEFT JOIN n USING (customer_id) LEFT JOIN r USING (customer_id) GROUP BY 1""")
def a27(spark, d):
    out = R.tier_stats(frame(spark, d, "cust").withColumnRenamed("industry", "tier"), frame(spark, d, "app"), frame(spark, d, "repay"))
    return out.withColumn("mean_income", F.round("mean_income", 3))


@register("a28_monthly_distribution", ctes("app", "repay", "report", "log") + ", u AS (SELECT strftime(apply_date, '%Y-%m') AS month, 1 AS a, 0 AS b, 0 AS c, 0 AS e FROM app UNION ALL SELECT strftime(due_date, '%Y-%m'), 0, 1, 0, 0 FROM repay UNION ALL SELECT strftime(query_date, '%Y-%m'), 0, 0, 1, 0 FROM report UNION ALL SELECT strftime(day, '%Y-%m'), 0, 0, 0, 1 FROM log) SELECT month, sum(a)::BIGINT AS app, sum(b)::BIGINT AS repay, sum(c)::BIGINT AS report, sum(e)::BIGINT AS log FROM u GROUP BY 1")
def a28(spark, d):
    return R.monthly_distribution(app=(frame(spark, d, "app"), "apply_date"), repay=(frame(spark, d, "repay"), "due_date"), report=(frame(spark, d, "report"), "query_date"), log=(_log(spark, d), "day"))


@register("a29_profile_column", "SELECT min(p_size) AS low, max(p_size) AS high, count(DISTINCT p_size) AS distinct, count(p_size) AS filled FROM part")
def a29(spark, d):
    return R.profile_column(table(spark, d, "part"), "p_size")


@register("a30_decision_qps", ctes("log") + "SELECT greatest(1, floor(count(*) / 86400))::BIGINT AS qps FROM log WHERE day = DATE '2024-01-15'")
def a30(spark, d):
    return R.decision_qps(_log(spark, d), "2024-01-15")
