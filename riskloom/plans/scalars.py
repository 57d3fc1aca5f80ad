"""Queries of the projections (P), scalar functions (F) and the function surface (UD)."""

from pyspark.sql import functions as F

from riskloom.functions import expressions as X
from riskloom.functions import scalars as S
from riskloom.operators import etl, tables
from riskloom.plans.registry import register
from riskloom.sources.bindings import AS_OF, ctes, frame
from riskloom.sources.tables import table


@register("p01_decode", ctes("app") + """
SELECT application_no, CASE product_id WHEN 'P001' THEN '消费贷' WHEN 'P002' THEN '经营贷' WHEN 'P003' THEN '信用贷' ELSE '其他产品' END AS product_name FROM app""")
def p01(spark, d):
    return frame(spark, d, "app").select("application_no", S.decode(F.col("product_id"), S.PRODUCTS, S.OTHER_PRODUCT).alias("product_name"))


@register("p02_age_years", ctes("cust") + "SELECT customer_id, CAST(2001 - year(birth_date) AS INT) AS age FROM cust")
def p02(spark, d):
    return frame(spark, d, "cust").select("customer_id", S.age_years(F.col("birth_date"), AS_OF).alias("age"))


@register("p03_age_clamped", ctes("cust") + """
SELECT customer_id, coalesce(greatest(18, least(65, CAST(date_diff('year', birth_date, DATE '2001-08-01') - CASE WHEN strftime(birth_date, '%m%d') > '0801' THEN 1 ELSE 0 END AS INT))), 30)::INT AS age
FROM (SELECT customer_id, birth_date FROM cust WHERE birth_date IS NOT NULL) UNION ALL SELECT customer_id, 30 FROM cust WHERE birth_date IS NULL""")
def p03(spark, d):
    return frame(spark, d, "cust").select("customer_id", S.age_clamped(F.col("birth_date"), AS_OF).alias("age"))


@register("p04_province", ctes("cust") + """, a AS (SELECT customer_id, CASE customer_id % 3 WHEN 0 THEN address WHEN 1 THEN replace(address, '市', '') ELSE replace(replace(address, '市', ''), '省', '') END AS address FROM cust)
SELECT customer_id, CASE WHEN address LIKE '%市%' THEN '直辖市' WHEN address LIKE '%省%' THEN substr(address, 1, instr(address, '省')) ELSE substr(address, 1, 3) END AS province FROM a""")
def p04(spark, d):
    return _addresses(spark, d).select("customer_id", S.province(F.col("address")).alias("province"))


@register("p05_city", ctes("cust") + """, a AS (SELECT customer_id, CASE customer_id % 3 WHEN 0 THEN address WHEN 1 THEN replace(address, '区', '') ELSE replace(replace(address, '市', ''), '区', '') END AS address FROM cust)
SELECT customer_id, CASE WHEN address LIKE '%区%' THEN substr(address, instr(address, '市') + 1, instr(address, '区') - instr(address, '市')) WHEN address LIKE '%市%' THEN substr(address, 1, instr(address, '市')) ELSE substr(address, 1, 6) END AS city FROM a""")
def p05(spark, d):
    return _addresses(spark, d, "区").select("customer_id", S.city(F.col("address")).alias("city"))


def _addresses(spark, d, drop="市"):
    other = "省" if drop == "市" else "市"
    a = F.col("address")
    return frame(spark, d, "cust").withColumn("address", F.when(F.col("customer_id") % 3 == 0, a).when(F.col("customer_id") % 3 == 1, F.replace(a, F.lit(drop), F.lit(""))).otherwise(F.replace(F.replace(a, F.lit("市"), F.lit("")), F.lit(other if drop == "市" else "区"), F.lit(""))))


_CREDIT = ctes("app", "cust", "repay") + """, n AS (SELECT customer_id, count(*) AS loans FROM app GROUP BY 1), o AS (SELECT customer_id, count(*) AS overdue FROM repay WHERE overdue_days > 40 GROUP BY 1),
c AS (SELECT customer_id, coalesce(loans, 0) AS loans, coalesce(overdue, 0) AS overdue FROM cust LEFT JOIN n USING (customer_id) LEFT JOIN o USING (customer_id)),
s AS (SELECT *, greatest(300, least(950, 750 - overdue * 30 + least(loans, 10) * 5))::BIGINT AS score FROM c) """


def _credit(spark, d):
    loans = frame(spark, d, "app").groupBy("customer_id").agg(F.count("*").alias("loans"))
    overdue = frame(spark, d, "repay").where("overdue_days > 40").groupBy("customer_id").agg(F.count("*").alias("overdue"))
    base = frame(spark, d, "cust").select("customer_id").join(loans, "customer_id", "left").join(overdue, "customer_id", "left").na.fill(0, ["loans", "overdue"])
    return base.withColumn("score", S.credit_score(F.col("loans"), F.col("overdue")).cast("long"))


@register("p06_risk_level", ctes("repay", "report") + """, o AS (SELECT customer_id, count(*) AS o FROM repay WHERE overdue_days > 45 GROUP BY 1), q AS (SELECT customer_id, count(*) FILTER (query_date >= DATE '2001-07-02') AS q1, count(*) AS q3 FROM report GROUP BY 1)
SELECT customer_id, CASE WHEN coalesce(o, 0) >= 3 OR coalesce(q1, 0) >= 5 THEN 'HIGH' WHEN coalesce(o, 0) >= 1 OR coalesce(q3, 0) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM o FULL JOIN q USING (customer_id)""")
def p06(spark, d):
    o = frame(spark, d, "repay").where("overdue_days > 45").groupBy("customer_id").agg(F.count("*").alias("o"))
    q = frame(spark, d, "report").groupBy("customer_id").agg(F.count_if(F.col("query_date") >= "2001-07-02").alias("q1"), F.count("*").alias("q3"))
    return o.join(q, "customer_id", "full").select("customer_id", S.risk_level(F.col("o"), F.col("q1"), F.col("q3")).alias("risk_level"))


@register("p07_credit_score", _CREDIT + "SELECT customer_id, score FROM s")
def p07(spark, d):
    return _credit(spark, d).select("customer_id", "score")


@register("p08_risk_from_score", _CREDIT + "SELECT customer_id, CASE WHEN overdue >= 3 OR score < 500 THEN 'HIGH' WHEN overdue >= 1 OR score < 650 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s")
def p08(spark, d):
    return _credit(spark, d).select("customer_id", S.risk_from_score(F.col("overdue"), F.col("score")).alias("level"))


@register("p09_grade", _CREDIT + "SELECT customer_id, CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN score >= 650 THEN 'A' WHEN score >= 550 THEN 'B' WHEN score >= 500 THEN 'C' ELSE 'D' END AS grade FROM s")
def p09(spark, d):
    return _credit(spark, d).select("customer_id", S.grade(F.col("score")).alias("grade"))


@register("p10_infer_tier", ctes("app", "cust") + """SELECT application_no, CASE WHEN status = 'REJECTED' OR (i > 0 AND i < 30000) THEN CASE WHEN i < 10000 THEN 'ANOMALY' ELSE 'HIGH_RISK' END WHEN i > 200000 THEN 'PREMIUM' WHEN i > 80000 THEN 'NORMAL' ELSE 'HIGH_RISK' END AS tier
FROM (SELECT application_no, status, coalesce(annual_income, 0) * 30 AS i FROM app LEFT JOIN cust USING (customer_id))""")
def p10(spark, d):
    both = frame(spark, d, "app").join(frame(spark, d, "cust"), "customer_id", "left")
    return both.select("application_no", S.infer_tier(F.col("annual_income") * 30, F.col("status")).alias("tier"))


_LAYERS = "CASE o_orderkey % 6 WHEN 0 THEN 'ods' WHEN 1 THEN 'DWD' WHEN 2 THEN 'DWS' WHEN 3 THEN 'ADS' WHEN 4 THEN 'ES_LOG' ELSE 'TMP' END"
_TIER = "CASE WHEN age <= hot THEN 'HOT' WHEN age <= warm THEN 'WARM' WHEN age <= cold THEN 'COLD' WHEN age > cold THEN 'ARCHIVE' ELSE 'HOT' END"
_POLICY = "(VALUES ('ODS', 30, 180, 730), ('DWD', 90, 365, 1095), ('DWS', 180, 730, 1095), ('ADS', 365, 1095, 1825), ('ES_LOG', 7, 90, 365)) AS p(l, hot, warm, cold)"
_AGED = f"(SELECT o_orderkey, upper({_LAYERS}) AS l, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age FROM orders) a LEFT JOIN {_POLICY} USING (l)"


@register("p11_storage_tier", f"SELECT o_orderkey, CASE WHEN hot IS NULL THEN 'HOT' ELSE {_TIER} END AS tier FROM {_AGED}")
def p11(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.storage_tier(F.expr(_LAYERS), F.col("o_orderdate").cast("date"), AS_OF).alias("tier"))


@register("p12_archive_threshold", f"SELECT l AS layer, strftime(DATE '2001-08-01' - cold, '%Y-%m-%d') AS threshold, count(*) FILTER (age > cold) AS n FROM {_AGED} WHERE hot IS NOT NULL GROUP BY ALL")
def p12(spark, d):
    rows = table(spark, d, "orders").select(F.upper(F.expr(_LAYERS)).alias("layer"), F.col("o_orderdate").cast("date").alias("created"))
    aged = rows.withColumn("threshold", S.archive_threshold(F.col("layer"), AS_OF)).where("threshold is not null")
    return aged.groupBy("layer", F.col("threshold").cast("string").alias("threshold")).agg(F.count_if(F.col("created") < F.col("threshold")).alias("n"))


@register("p13_normalise_result", ctes("log", "app") + """SELECT r AS word, CASE WHEN r IN ('PASS','APPROVED') THEN 'PASS' WHEN r IN ('REJECT','REJECTED') THEN 'REJECT' WHEN r IN ('MANUAL','REVIEW') THEN 'MANUAL' ELSE 'OTHER' END AS result, count(*) AS n
FROM (SELECT decision_result AS r FROM log UNION ALL SELECT status FROM app) GROUP BY ALL""")
def p13(spark, d):
    words = frame(spark, d, "log").select(F.col("decision_result").alias("word")).union(frame(spark, d, "app").select("status"))
    return words.groupBy("word", S.normalise_result(F.col("word")).alias("result")).agg(F.count("*").alias("n"))


@register("p14_filter_samples", ctes("app") + "SELECT application_no, status FROM app WHERE apply_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND product_id IN ('P001', 'P003') AND channel IN ('1-URGENT', '2-HIGH') AND status IN ('APPROVED', 'REJECTED')")
def p14(spark, d):
    spec = {"apply_date": ("1996-01-01", "1998-12-31"), "product_id": ["P001", "P003"], "channel": ["1-URGENT", "2-HIGH"], "status": ["APPROVED", "REJECTED"]}
    return tables.filter_samples(frame(spark, d, "app"), spec).select("application_no", "status")


@register("p15_filter_log", ctes("log") + "SELECT trace_id, customer_id FROM log WHERE flow_id = 'F1' AND decision_result = 'PASS' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def p15(spark, d):
    return tables.filter_log(frame(spark, d, "log"), start="2024-01-05", end="2024-01-20", flow_id="F1", decision_result="PASS", customer_id=None).select("trace_id", "customer_id")


@register("p16_risk_signal_filter", ctes("log") + "SELECT trace_id FROM log WHERE flow_id = 'F1' AND (decision_result = 'REJECT' OR total_score < 60 OR duration_ms > 90)")
def p16(spark, d):
    should = [F.col("decision_result") == "REJECT", F.col("total_score") < 60, F.col("duration_ms") > 90]
    return tables.match_any(frame(spark, d, "log"), F.col("flow_id") == "F1", should).select("trace_id")


@register("p17_search_log", ctes("log") + "SELECT trace_id FROM log WHERE CAST(trace_id AS VARCHAR) = '7' OR CAST(customer_id AS VARCHAR) = '7' OR decision_result = '7' OR flow_id = '7'")
def p17(spark, d):
    return tables.search_log(frame(spark, d, "log"), ["trace_id", "customer_id", "decision_result", "flow_id"], "7").select("trace_id")


@register("p18_map_features", ctes("log") + "SELECT trace_id, coalesce(CAST(total_score AS DOUBLE), 0.0) AS score, coalesce(TRY_CAST(decision_result AS INT), -1) AS code, coalesce(TRY_CAST(CASE WHEN decision_result = 'PASS' THEN 'true' ELSE 'x' END AS BOOLEAN), false) AS passed FROM log")
def p18(spark, d):
    log = frame(spark, d, "log").withColumn("flag", F.when(F.col("decision_result") == "PASS", "true").otherwise("x"))
    return tables.map_features(log, [("total_score", "score", "DOUBLE", 0.0), ("decision_result", "code", "INTEGER", -1), ("flag", "passed", "BOOLEAN", False)], ["trace_id"])


@register("p19_trace_report", ctes("log") + "SELECT trace_id, decision_result, total_score, duration_ms, array_to_string(list_transform(hit_rules, lambda x: x || ':RULE'), ',') AS hit_rules FROM log")
def p19(spark, d):
    """Level 3, its entries as texts."""
    out = tables.trace_report(frame(spark, d, "log"), 3)
    return out.withColumn("hit_rules", F.array_join(F.transform("hit_rules", lambda h: F.concat_ws(":", h["rule"], h["kind"])), ","))


@register("p20_score_columns", ctes("scored") + "SELECT id, CAST(round(CAST(CAST(value AS DECIMAL(10,2)) * 2 AS DOUBLE), 1) AS DOUBLE) AS score, CAST(CASE WHEN CAST(value AS DECIMAL(10,2)) >= 250 THEN 1 ELSE 0 END AS INT) AS label FROM scored")
def p20(spark, d):
    score, label = S.score_label(F.col("value").cast("decimal(10,2)") / F.lit(500))
    return frame(spark, d, "scored").select("id", score.cast("double").alias("score"), label.alias("label"))


@register("f01_between", ctes("log") + "SELECT trace_id, total_score BETWEEN 100 AND 200 AS hit FROM log")
def f01(spark, d):
    return frame(spark, d, "log").select("trace_id", S.between(F.col("total_score"), F.lit(100), F.lit(200)).alias("hit"))


@register("f02_in_list", ctes("log") + "SELECT trace_id, decision_result IN ('PASS', 'REVIEW') AS hit FROM log")
def f02(spark, d):
    return frame(spark, d, "log").select("trace_id", S.in_list(F.col("decision_result"), "PASS , REVIEW").alias("hit"))


@register("f03_days_between", ctes("cust") + "SELECT customer_id, CAST(coalesce(abs(date_diff('day', birth_date, DATE '2001-08-01')), -1) AS INT) AS days FROM cust")
def f03(spark, d):
    return frame(spark, d, "cust").select("customer_id", S.days_between(F.col("birth_date").cast("string"), F.lit(AS_OF)).alias("days"))


@register("f04_in_province", ctes("cust") + "SELECT customer_id, contains(address, 'CHINA') AS hit FROM cust")
def f04(spark, d):
    return frame(spark, d, "cust").select("customer_id", S.in_province(F.col("address"), F.lit("CHINA省")).alias("hit"))


@register("f05_overdue_count", ctes("repay") + "SELECT id, overdue_days >= 30 AS hit FROM repay")
def f05(spark, d):
    return frame(spark, d, "repay").select("id", S.at_least(F.col("overdue_days").cast("string"), F.lit(30)).alias("hit"))


@register("f06_credit_query_count", ctes("report") + "SELECT customer_id, count(*) >= 10 AS hit FROM report GROUP BY 1")
def f06(spark, d):
    return frame(spark, d, "report").groupBy("customer_id").agg(F.count("*").alias("n")).select("customer_id", S.at_least(F.col("n"), F.lit(10)).alias("hit"))


def _mask(name, sql, column, mask):
    @register(name, ctes("cust") + f"SELECT customer_id, {sql} AS masked FROM cust")
    def query(spark, d):
        return frame(spark, d, "cust").select("customer_id", mask(F.col(column)).alias("masked"))


_mask("f07_mask_id_card", "substr(id_card, 1, 3) || repeat('*', length(id_card) - 7) || right(id_card, 4)", "id_card", S.mask_id_card)
_mask("f08_mask_mobile", "substr(phone, 1, 3) || '****' || right(phone, 4)", "phone", S.mask_mobile)
_mask("f09_mask_bank_card", "substr(id_card, 1, 4) || repeat('*', length(id_card) - 8) || right(id_card, 4)", "id_card", S.mask_bank_card)
_mask("f10_mask_name", "substr(customer_name, 1, 1) || repeat('*', length(customer_name) - 1)", "customer_name", S.mask_name)
_mask("f11_mask_email", "'u***' || substr(email, instr(email, '@'))", "email", S.mask_email)
_mask("f12_mask_address", "substr(address, 1, 6) || repeat('*', length(address) - 6)", "address", S.mask_address)
_mask("f13_mask_custom", "substr(customer_name, 1, 2) || repeat('*', length(customer_name) - 5) || right(customer_name, 3)", "customer_name", lambda c: S.mask_custom(c, 2, 3))


@register("f14_auto_mask", ctes("cust") + "SELECT customer_id, '[' || substr(id_card, 1, 3) || '***********' || right(id_card, 4) || '] ' || substr(phone, 1, 3) || '****' || right(phone, 4) || ' u***@mail.example.com' AS masked FROM cust")
def f14(spark, d):
    text = F.concat(F.lit("["), F.col("id_card"), F.lit("] "), F.col("phone"), F.lit(" "), F.col("email"))
    return frame(spark, d, "cust").select("customer_id", S.auto_mask(text).alias("masked"))


@register("f15_encrypt_field", ctes("cust") + "SELECT customer_id, phone AS back, true AS coded FROM cust")
def f15(spark, d):
    key = F.lit("0123456789abcdef0123456789abcdef")
    coded = S.encrypt_field(F.col("phone"), key)
    return frame(spark, d, "cust").withColumn("c", coded).select("customer_id", S.decrypt_field(F.col("c"), key).alias("back"), F.startswith("c", F.lit("v1:")).alias("coded"))


@register("f16_is_encrypted", ctes("cust") + "SELECT customer_id, true AS coded, false AS plain FROM cust")
def f16(spark, d):
    coded = S.encrypt_field(F.col("phone"), F.lit("0123456789abcdef"))
    return frame(spark, d, "cust").select("customer_id", S.is_encrypted(coded).alias("coded"), S.is_encrypted(F.col("phone")).alias("plain"))


@register("f17_snapshot_hash", ctes("log") + """SELECT trace_id, substr(sha256('{"flow_id":"' || flow_id || '","trace_id":' || trace_id || '}'), 1, 16) AS h FROM log""")
def f17(spark, d):
    return frame(spark, d, "log").select("trace_id", S.snapshot_hash(trace_id=F.col("trace_id"), flow_id=F.col("flow_id")).alias("h"))


@register("f18_feature_row_key", ctes("cust") + "SELECT customer_id, reverse(CAST(customer_id AS VARCHAR)) || '_overdue_6m' AS row_key FROM cust")
def f18(spark, d):
    return frame(spark, d, "cust").select("customer_id", S.feature_row_key(F.col("customer_id"), "overdue", "6m").alias("row_key"))


@register("f19_json_number", ctes("audit") + "SELECT id, TRY_CAST(json_extract_string(snapshot, '$.score') AS DOUBLE) AS score, TRY_CAST(json_extract_string(snapshot, '$.durationMs') AS DOUBLE) AS duration FROM audit")
def f19(spark, d):
    return frame(spark, d, "audit").select("id", S.json_number(F.col("snapshot"), "score").alias("score"), S.json_number(F.col("snapshot"), "durationMs").alias("duration"))


@register("f20_monthly_payment", ctes("app") + "SELECT application_no, round(loan_amount::DOUBLE * 0.01 * pow(1.01, loan_term) / (pow(1.01, loan_term) - 1), 2) AS payment FROM app")
def f20(spark, d):
    return frame(spark, d, "app").select("application_no", S.monthly_payment(F.col("loan_amount").cast("double"), F.col("loan_term"), 0.12).alias("payment"))


_SCHEDULE = """, p AS (SELECT application_no, loan_term, loan_amount, CAST(round(loan_amount::DOUBLE * 0.01 * power(1.01, loan_term) / (power(1.01, loan_term) - 1), 2) AS DECIMAL(18,2)) AS pay FROM app),
s AS (SELECT application_no, loan_term, pay, 0 AS month, loan_amount AS rest, CAST(0 AS DECIMAL(18,2)) AS interest, CAST(0 AS DECIMAL(18,2)) AS principal FROM p
UNION ALL SELECT application_no, loan_term, pay, month + 1, CAST(rest - CASE WHEN month + 1 = loan_term THEN rest ELSE pay - i END AS DECIMAL(18,2)), i, CAST(CASE WHEN month + 1 = loan_term THEN rest ELSE pay - i END AS DECIMAL(18,2)) FROM (SELECT *, CAST(round(rest * CAST(0.01 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS i FROM s WHERE month < loan_term))
SELECT application_no, CAST(month AS INT) AS month, interest::DOUBLE AS interest, principal::DOUBLE AS principal FROM s WHERE month > 0"""


@register("f21_amortise", ctes("app") + _SCHEDULE)
def f21(spark, d):
    return etl.amortise(frame(spark, d, "app"), "application_no", "loan_amount", "loan_term", 0.12)


@register("f22_percent_text", ctes("app") + "SELECT product_id, printf('%.1f%%', 100.0 * count(*) FILTER (status = 'APPROVED') / count(*)) AS share FROM app GROUP BY 1")
def f22(spark, d):
    return frame(spark, d, "app").groupBy("product_id").agg(S.percent_text(F.count_if(F.col("status") == "APPROVED") / F.count("*")).alias("share"))


@register("f23_parse_timestamp", ctes("log") + "SELECT trace_id, CASE WHEN trace_id % 3 = 2 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM log")
def f23(spark, d):
    stamp = F.when(F.col("trace_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("trace_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise("soon")
    return frame(spark, d, "log").select("trace_id", F.date_format(S.parse_timestamp(stamp), "yyyy-MM-dd HH:mm:ss").alias("t"))


@register("f24_event_id", ctes("report") + "SELECT 'CQ_' || id AS event_id, '报告编号:' || report_no || ',逾期次数:' || overdue_count AS detail FROM report")
def f24(spark, d):
    return frame(spark, d, "report").select(S.event_id("CQ", F.col("id")).alias("event_id"), F.concat(F.lit("报告编号:"), "report_no", F.lit(",逾期次数:"), F.col("overdue_count").cast("string")).alias("detail"))


@register("ud01_sql_functions", ctes("log") + "SELECT trace_id, total_score BETWEEN 50 AND 150 AS a, decision_result IN ('PASS', 'REJECT') AS b, CAST(abs(date_diff('day', day, DATE '2024-02-01')) AS INT) AS c, total_score >= 100 AS e FROM log")
def ud01(spark, d):
    S.register_functions(spark)
    return frame(spark, d, "log").selectExpr("trace_id", "f_between(total_score, 50, 150) AS a", "f_in_list(decision_result, 'PASS, REJECT') AS b", "f_days_between(CAST(day AS STRING), '2024-02-01') AS c", "f_at_least(CAST(total_score AS STRING), 100) AS e")


@register("ud02_expression", ctes("log") + "SELECT trace_id, CAST(CASE WHEN total_score > 100 AND decision_result = 'PASS' THEN duration_ms * 2 ELSE CASE WHEN flow_id = 'F1' THEN 1 ELSE 0 END END AS BIGINT) AS v FROM log")
def ud02(spark, d):
    text = 'total_score > 100 && decision_result == "PASS" ? duration_ms * 2 : (flow_id == "F1" ? 1 : 0)'
    return frame(spark, d, "log").select("trace_id", X.expression(text).cast("long").alias("v"))


@register("ud03_register_mask", ctes("cust") + "SELECT customer_id, '****' || right(industry, 2) AS masked FROM cust")
def ud03(spark, d):
    if "industry" not in S._OWN_MASKS:
        S.register_mask("industry", lambda c: F.concat(F.lit("****"), F.right(c, F.lit(2))))
    return frame(spark, d, "cust").select("customer_id", S.mask_of("industry")(F.col("industry")).alias("masked"))
