"""Logical credit tables over the driver's tables: one list of column expressions serves Spark and the SQL checks."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.sources.tables import table

AS_OF = "2001-08-01"

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)", "duck": "CAST(json_extract_string(props, '$.k') AS BIGINT)"}
_LIST = {"spark": "array(concat('R', k % 7), concat('R', k % 5))", "duck": "[concat('R', k % 7), concat('R', k % 5)]"}

#: name -> (FROM clause, columns).
VIEWS = {
    "app": ("orders", [
        "o_orderkey AS application_no", "o_custkey AS customer_id", "concat('P00', o_orderkey % 3 + 1) AS product_id", "o_orderpriority AS channel",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amount", "CAST(12 * (o_orderkey % 3 + 1) AS INT) AS loan_term", "o_orderdate AS apply_time",
        "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'REJECTED' ELSE 'PENDING' END AS status", "CAST(o_orderdate AS DATE) AS apply_date"]),
    "cust": ("customer JOIN nation ON c_nationkey = n_nationkey", [
        "c_custkey AS customer_id", "c_name AS customer_name", "n_name AS province", "c_mktsegment AS industry", "CAST(c_acctbal AS DECIMAL(18,2)) AS annual_income",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(DATE '1950-01-01' + CAST(c_custkey * 37 % 15000 AS INT) AS DATE) END AS birth_date",
        "CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender", "CASE c_custkey % 4 WHEN 0 THEN '大专' WHEN 1 THEN '本科' WHEN 2 THEN '硕士' ELSE '其他' END AS education",
        "concat(n_name, '省', c_mktsegment, '市', c_custkey % 9, '区') AS address", "concat('138', lpad(CAST(c_custkey AS STRING), 8, '0')) AS phone",
        "concat('110101', lpad(CAST(c_custkey AS STRING), 12, '0')) AS id_card", "concat('u', c_custkey, '@mail.example.com') AS email"]),
    "repay": ("lineitem JOIN orders ON l_orderkey = o_orderkey", [
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey AS loan_id", "o_custkey AS customer_id", "l_linenumber AS installment_no", "CAST(l_extendedprice AS DECIMAL(18,2)) AS repay_amount",
        "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS principal", "CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS interest",
        "CAST(l_shipdate AS DATE) AS due_date", "CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) ELSE 0 END AS overdue_days", "l_linestatus AS state"]),
    "report": ("events", [
        "event_id AS id", "user_id AS customer_id", "CAST(DATE '2001-08-01' - CAST(event_id % 120 AS INT) AS DATE) AS query_date", "concat('INST', event_id % 5) AS query_institution",
        "concat('RPT', event_id) AS report_no", "CAST(event_id % 4 AS INT) AS overdue_count"]),
    "log": ("events", [
        "event_id AS trace_id", "user_id AS customer_id", "event_type", "ts", "CAST(ts AS DATE) AS day",
        "CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'view' THEN 'PASS' WHEN 'error' THEN 'REJECT' WHEN 'click' THEN 'REVIEW' ELSE 'MANUAL' END AS decision_result",
        "CAST(value AS DECIMAL(10,2)) AS total_score", "{k} AS duration_ms", "concat('F', user_id % 3) AS flow_id", "CAST(1 + user_id % 2 AS INT) AS flow_version", "{k} AS k", "{list} AS hit_rules"]),
    "audit": ("events", [
        "event_id AS id", "concat('op', user_id % 10) AS operator", "CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'REJECT' ELSE upper(event_type) END AS action",
        "event_type AS target_type", "user_id AS target_id", "CAST(event_id % 6 AS INT) AS target_version", "ts AS operated_at", "concat('{{\"score\": ', CAST(value AS DECIMAL(10,2)), ', \"durationMs\": ', {k}, '}}') AS snapshot"]),
    "scored": ("events", ["event_id AS id", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y", "CAST(value AS DECIMAL(10,2)) / 500 AS p", "CAST(ts AS DATE) AS day", "event_type", "value"]),
}
_FILTER = {"report": "event_type = 'view'"}
_TABLES = {"app": ["orders"], "cust": ["customer", "nation"], "repay": ["lineitem", "orders"]}


def _columns(name: str, engine: str) -> list[str]:
    return [c.replace("{list}", _LIST[engine].replace("k %", f"{_K[engine]} %")).replace("{k}", _K[engine]).replace("{{", "{").replace("}}", "}") if "{" in c else c for c in VIEWS[name][1]]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table as a DataFrame."""
    if name == "cust":
        c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
        source = c.join(n, c.c_nationkey == n.n_nationkey)
    elif name == "repay":
        item, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        source = item.join(order, item.l_orderkey == order.o_orderkey)
    else:
        source = table(spark, sf_dir, _TABLES.get(name, ["events"])[0])
    if name in _FILTER:
        source = source.where(_FILTER[name])
    return source.selectExpr(*_columns(name, "spark"))


def ctes(*names: str) -> str:
    """The same logical tables as common table expressions for DuckDB."""
    parts = []
    for name in names:
        where = f" WHERE {_FILTER[name]}" if name in _FILTER else ""
        columns = ", ".join(_columns(name, "duck")).replace("AS STRING)", "AS VARCHAR)")
        parts.append(f"{name} AS (SELECT {columns} FROM {VIEWS[name][0]}{where})")
    return "WITH RECURSIVE " + ", ".join(parts)
