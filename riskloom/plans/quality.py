"""Queries of quality and governance (Q) and UD-04."""

from pyspark.sql import functions as F

from riskloom.operators import etl as E
from riskloom.operators import quality as Q
from riskloom.operators import tables as T
from riskloom.plans.registry import register
from riskloom.sources.bindings import AS_OF, ctes, frame
from riskloom.sources.tables import table

_RULE = {"not_null": ("COMPLETENESS", "phone_or_null", "NOT NULL"), "low": ("ACCURACY", "annual_income", ">= 0"), "high": ("ACCURACY", "annual_income", "<= 9000"), "regex": ("ACCURACY", "phone", "REGEX: 138\\d{4}0\\d{3}"), "enum": ("ACCURACY", "education", "ENUM:大专,本科, 硕士"), "unique": ("UNIQUENESS", "industry", "UNIQUE"), "ref": ("CONSISTENCY", "province", "REF:nation.n_name")}
_SQL = {"not_null": "customer_id % 6 = 0", "low": "annual_income < 0", "high": "annual_income > 9000", "regex": "NOT regexp_full_match(phone, '138\\d{4}0\\d{3}')", "enum": "education NOT IN ('大专', '本科', '硕士')", "unique": "customer_id IN (SELECT customer_id FROM cust QUALIFY row_number() OVER (PARTITION BY industry ORDER BY customer_id) > 1)", "ref": "province NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3)"}


def _checked(spark, d, *names):
    Q.register_reference("nation.n_name", table(spark, d, "nation").where("n_regionkey < 3"), "n_name")
    rows = frame(spark, d, "cust").withColumn("phone_or_null", F.when(F.col("customer_id") % 6 != 0, F.col("phone")))
    rules = [{"ruleId": n, "dimension": _RULE[n][0], "column": _RULE[n][1], "expression": _RULE[n][2], "severity": "HIGH"} for n in names]
    return Q.check_quality(rows, rules, "customer_id")


def _violations(*names):
    return " UNION ALL ".join(f"SELECT customer_id, '{n}' AS rule, '{_RULE[n][0]}' AS dimension, '{_RULE[n][1]}' AS \"column\", 'HIGH' AS severity FROM cust WHERE {_SQL[n]}" for n in names)


def _one(name, *rules):
    @register(name, ctes("cust") + f"SELECT * FROM ({_violations(*rules)})")
    def query(spark, d):
        return _checked(spark, d, *rules)


_one("q01_completeness", "not_null")
_one("q02_accuracy_range", "low", "high")
_one("q03_accuracy_regex", "regex")
_one("q04_accuracy_enum", "enum")
_one("q05_uniqueness", "unique")
_one("q06_consistency", "ref")
_one("ud04_registered_reference", "ref", "not_null")
_one("q08_violation_rows", *_RULE)


@register("q07_timeliness", "SELECT event_id FROM events WHERE (event_type = 'view' AND strftime(ts, '%H:%M') > '06:30') OR (event_type = 'click' AND hour(ts) >= 8)")
def q07(spark, d):
    return Q.check_timeliness(table(spark, d, "events"), {"view": "SLA:06:30", "click": "SLA:8h"}, "event_type", "ts").select("event_id")


@register("q09_quality_summary", ctes("cust") + f", v AS (SELECT * FROM ({_violations('not_null', 'low', 'enum')})) SELECT rule, dimension, count(*) AS violations, count(*) / (SELECT count(*) FROM cust) AS share, count(*) / (SELECT count(*) FROM cust) <= CASE rule WHEN 'not_null' THEN 0.2 WHEN 'low' THEN 0.05 ELSE 0 END AS passed FROM v GROUP BY 1, 2")
def q09(spark, d):
    return Q.quality_summary(_checked(spark, d, "not_null", "low", "enum"), table(spark, d, "customer").count(), {"not_null": 0.2, "low": 0.05})


@register("q10_range_check", "SELECT 's_acctbal' AS \"column\", count(*) FILTER (s_acctbal < 0) AS negative FROM supplier UNION ALL SELECT 's_nationkey', count(*) FILTER (s_nationkey < 0) FROM supplier UNION ALL SELECT 's_suppkey', count(*) FILTER (s_suppkey < 0) FROM supplier")
def q10(spark, d):
    return Q.range_check(table(spark, d, "supplier").select(*(F.col(c).cast("double").alias(c) for c in ("s_acctbal", "s_nationkey", "s_suppkey"))), ["s_acctbal", "s_nationkey", "s_suppkey"])


@register("q11_require_rows", "SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-09' GROUP BY 1")
def q11(spark, d):
    day = T.incremental_extract(table(spark, d, "events"), "ts", "2024-01-09")
    return E.require_rows(day, "events of the day").groupBy("event_type").agg(F.count("*").alias("n"))


@register("q12_rollup_status", "WITH c AS (SELECT user_id AS name, CASE WHEN event_type = 'error' AND value > 150 THEN 'FAIL' WHEN value > 300 THEN 'WARN' WHEN event_type = 'signup' THEN 'SKIP' ELSE 'PASS' END AS status FROM events) SELECT name, CASE max(CASE status WHEN 'FAIL' THEN 3 WHEN 'WARN' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END) WHEN 3 THEN 'FAIL' WHEN 2 THEN 'WARN' WHEN 1 THEN 'PASS' ELSE 'SKIP' END AS status FROM c GROUP BY 1")
def q12(spark, d):
    status = F.expr("CASE WHEN event_type = 'error' AND value > 150 THEN 'FAIL' WHEN value > 300 THEN 'WARN' WHEN event_type = 'signup' THEN 'SKIP' ELSE 'PASS' END")
    return Q.rollup_status(table(spark, d, "events").select(F.col("user_id").alias("name"), status.alias("status")))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_LEVEL = "CASE " + " ".join(f"WHEN contains(lower(column_name), '{w}') THEN '{lv}'" for w, lv in Q.KEYWORDS) + " ELSE 'PUBLIC' END"
_COLS = "(SELECT DISTINCT table_name, column_name FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest(json_keys(to_json(x))) AS column_name FROM {t} x" for t in _TABLES) + "))"


def _catalogue(spark, d):
    return Q.catalogue(spark, {t: table(spark, d, t) for t in _TABLES}, {"events": "DWD"})


@register("q13_classify_columns", f"SELECT table_name, column_name, {_LEVEL} AS level FROM {_COLS}")
def q13(spark, d):
    return Q.classify_columns(_catalogue(spark, d)).select("table_name", "column_name", "level")


@register("q14_mask_frame", ctes("cust") + "SELECT customer_id, substr(customer_name, 1, 1) || repeat('*', length(customer_name) - 1) AS customer_name, substr(phone, 1, 3) || '****' || right(phone, 4) AS phone, substr(id_card, 1, 3) || repeat('*', length(id_card) - 7) || right(id_card, 4) AS id_card, 'u***' || substr(email, instr(email, '@')) AS email, gender FROM cust")
def q14(spark, d):
    return Q.mask_frame(frame(spark, d, "cust").select("customer_id", "customer_name", "phone", "id_card", "email", "gender"))


@register("q15_encryption_flags", f"SELECT table_name, column_name, {_LEVEL} IN ('CONFIDENTIAL', 'TOP_SECRET') AS encrypt, {_LEVEL} IN ('CONFIDENTIAL', 'TOP_SECRET') AS mask FROM {_COLS}")
def q15(spark, d):
    return Q.classify_columns(_catalogue(spark, d)).select("table_name", "column_name", "encrypt", "mask")


def _scripts(spark, d):
    """A script per event: a target of the day, fed from two tables by user."""
    text = F.concat(F.lit("INSERT OVERWRITE TABLE dwd.t"), F.col("user_id"), F.lit(" SELECT * FROM ods.a"), F.col("user_id") % 10, F.lit(" a JOIN `ods`.`b"), F.col("user_id") % 7, F.lit("` b ON a.k = b.k; INSERT INTO dws.s"), F.col("user_id") % 5, F.lit(" SELECT 1 FROM dwd.t"), F.col("user_id"), F.lit("; SELECT 2 FROM x")).cast("string")
    return table(spark, d, "events").select(F.lit("etl").alias("name"), text.alias("text"))


_EDGES = "WITH RECURSIVE u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT 'ods.a' || user_id % 10 AS src, 'dwd.t' || user_id AS dst FROM u UNION SELECT 'ods.b' || user_id % 7, 'dwd.t' || user_id FROM u UNION SELECT 'dwd.t' || user_id, 'dws.s' || user_id % 5 FROM u)"


def _edges(spark, d):
    return Q.lineage_edges(_scripts(spark, d), "name", "text")


@register("q16_lineage_edges", _EDGES + " SELECT src, dst, 'etl' AS transform FROM e")
def q16(spark, d):
    return _edges(spark, d)


@register("q17_neighbours", _EDGES + " SELECT DISTINCT dst AS node FROM e WHERE src = 'ods.a3'")
def q17(spark, d):
    return Q.neighbours(_edges(spark, d), "ods.a3")


@register("q18_lineage_closure", _EDGES + ", c AS (SELECT dst AS node FROM e WHERE src = 'ods.a3' UNION SELECT e.dst FROM c JOIN e ON e.src = c.node) SELECT node FROM c")
def q18(spark, d):
    return Q.lineage_closure(_edges(spark, d), "ods.a3").select("node")


@register("q19_infer_layer", _EDGES + " SELECT DISTINCT src, CASE substr(src, 1, 4) WHEN 'ods.' THEN 'ODS' WHEN 'dwd.' THEN 'DWD' ELSE 'UNKNOWN' END AS layer FROM e")
def q19(spark, d):
    from riskloom.functions.scalars import infer_layer

    return _edges(spark, d).select("src", infer_layer(F.col("src")).alias("layer")).distinct()


@register("q20_catalogue", "SELECT p_partkey FROM part WHERE p_size = 10 AND p_brand = 'Brand#11' OR (p_size = 10 AND p_brand = 'Brand#11')")
def q20(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("layer"), F.array("p_brand", "p_type").alias("tags"), F.lit("erp").alias("source"))
    return Q.find_tables(parts, layer="10", tag="Brand#11", source="erp").select("p_partkey")


@register("q21_tier_partitions", "SELECT CASE WHEN age <= 90 THEN 'HOT' WHEN age <= 365 THEN 'WARM' WHEN age <= 1095 THEN 'COLD' ELSE 'ARCHIVE' END AS tier, count(*) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age FROM orders) GROUP BY 1")
def q21(spark, d):
    return Q.tier_partitions(table(spark, d, "orders").select(F.lit("DWD").alias("layer"), F.col("o_orderdate").cast("date").alias("created")), AS_OF)


@register("q22_retain", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def q22(spark, d):
    return Q.retain(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3, "ts", "2024-01-10").select("event_id")


@register("q23_audit_query", ctes("audit") + "SELECT id FROM audit WHERE action = 'APPROVE' AND operator = 'op3' ORDER BY operated_at DESC, id LIMIT 15")
def q23(spark, d):
    rows, _ = T.page(T.filter_log(frame(spark, d, "audit"), action="APPROVE", operator="op3"), [F.desc("operated_at"), F.col("id")], 1, 15)
    return rows.select("id")
