"""Queries of the decision operators (R), experiments and backtests (X, A-31, A-32, T-03, T-04)."""

from pyspark.sql import functions as F

from riskloom.operators import decision as D
from riskloom.plans.registry import register
from riskloom.sources.bindings import ctes, frame


def _leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


_RULES = [
    {"ruleId": "R1", "priority": 1, "conditions": _leaf("total_score", "LT", 50), "actions": [{"type": "REJECT", "code": "LOW"}]},
    {"ruleId": "R2", "priority": 5, "conditions": {"operator": "AND", "operands": [_leaf("total_score", "BETWEEN", [40, 120]), _leaf("event_type", "IN", ["view", "error"])]}, "actions": [{"type": "REVIEW", "code": "MID"}]},
    {"ruleId": "R3", "priority": 5, "conditions": {"operator": "OR", "operands": [_leaf("duration_ms", "GTE", 80), {"operator": "NOT", "operands": [_leaf("flow_id", "NEQ", "F1")]}]}, "actions": [{"type": "PASS", "code": None}]},
]
_T = ["total_score < 50", "(total_score BETWEEN 40 AND 120 AND event_type IN ('view', 'error'))", "(duration_ms >= 80 OR flow_id = 'F1')"]
_CARD = {
    "scorecardId": "S", "initialScore": 100, "cutoff": {"reject": 130, "review": 130, "pass": 180},
    "characteristics": [
        {"name": "score", "field": "total_score", "bins": [{"range": [None, 50], "score": 10, "label": "low"}, {"range": [50, 150], "score": 40, "label": "mid"}, {"range": [150, None], "score": 70, "label": "high"}]},
        {"name": "time", "field": "duration_ms", "bins": [{"range": [0, 30], "score": 25, "label": "fast"}, {"range": [30, 80], "score": 5, "label": "slow"}]},
    ],
}
_CARD_SQL = ", sc AS (SELECT *, 100.0 + CASE WHEN total_score < 50 THEN 10 WHEN total_score < 150 THEN 40 ELSE 70 END + CASE WHEN duration_ms >= 0 AND duration_ms < 30 THEN 25 WHEN duration_ms >= 30 AND duration_ms < 80 THEN 5 ELSE 0 END AS total FROM log), sd AS (SELECT *, CASE WHEN total < 130 THEN 'REJECT' WHEN total < 180 THEN 'REVIEW' ELSE 'PASS' END AS decision FROM sc) "
_TABLE = {"columns": [{"name": "t", "field": "event_type"}, {"name": "f", "field": "flow_id"}], "rows": [
    {"conditions": ["error", "*"], "result": {"limit": 0, "word": "none"}}, {"conditions": ["*", "F1"], "result": {"limit": 10, "word": "some"}}, {"conditions": ["view", "F2"], "result": {"limit": 20, "word": "more"}}]}
_ROW = "CASE WHEN event_type = 'error' THEN 0 WHEN flow_id = 'F1' THEN 1 WHEN event_type = 'view' AND flow_id = 'F2' THEN 2 END"
_TREE = {"condition": _leaf("total_score", "GT", 100), "trueChild": {"condition": _leaf("event_type", "IN", ["view", "click"]), "trueChild": {"action": "PASS"}, "falseChild": {"action": "REVIEW"}}, "falseChild": {"action": "REJECT"}}
_TREE_SQL = "CASE WHEN total_score > 100 THEN CASE WHEN event_type IN ('view', 'click') THEN 'PASS' ELSE 'REVIEW' END ELSE 'REJECT' END"
FLOW = {
    "nodes": [
        {"id": "start", "type": "START"}, {"id": "rules", "type": "RULE_SET", "spec": {"hitPolicy": "FIRST_HIT", "rules": _RULES[:1]}}, {"id": "card", "type": "SCORECARD", "spec": _CARD},
        {"id": "no", "type": "ACTION", "action": "REJECT"}, {"id": "yes", "type": "ACTION", "action": "APPROVE"}],
    "edges": [
        {"from": "start", "to": "rules"}, {"from": "rules", "to": "no", "condition": _leaf("rules_result", "EQ", "REJECT")}, {"from": "rules", "to": "card"},
        {"from": "card", "to": "yes", "condition": _leaf("card_result", "EQ", "PASS")}, {"from": "card", "to": "no", "condition": _leaf("card_result", "EQ", "REJECT")}],
}
_FLOW_ACTION = "CASE WHEN total_score < 50 THEN 'REJECT' WHEN decision = 'PASS' THEN 'APPROVE' WHEN decision = 'REJECT' THEN 'REJECT' ELSE 'MANUAL' END"


def _log(spark, d):
    return frame(spark, d, "log")


@register("r01_comparisons", ctes("log") + "SELECT trace_id, total_score > 100 AS gt, total_score < 100 AS lt, total_score >= 100 AS gte, total_score <= 100 AS lte, event_type = 'view' AS eq, event_type <> 'view' AS neq, total_score BETWEEN 50 AND 100 AS btw, event_type IN ('view', 'click') AS isin FROM log")
def r01(spark, d):
    ops = {"gt": ("total_score", "GT", 100), "lt": ("total_score", "LT", 100), "gte": ("total_score", "GTE", 100), "lte": ("total_score", "LTE", 100), "eq": ("event_type", "EQ", "view"), "neq": ("event_type", "NEQ", "view"), "btw": ("total_score", "BETWEEN", [50, 100]), "isin": ("event_type", "IN", ["view", "click"])}
    return _log(spark, d).select("trace_id", *(D.condition(_leaf(*v)).alias(k) for k, v in ops.items()))


@register("r02_logic", ctes("log") + f"SELECT trace_id, {_T[1]} AND NOT ({_T[2]} OR {_T[0]}) AS hit FROM log")
def r02(spark, d):
    r = [x["conditions"] for x in _RULES]
    node = {"operator": "AND", "operands": [r[1], {"operator": "NOT", "operands": [{"operator": "OR", "operands": [r[2], r[0]]}]}]}
    return _log(spark, d).select("trace_id", D.condition(node).alias("hit"))


def _rules(policy):
    return {"ruleSetId": "RS", "hitPolicy": policy, "rules": _RULES}


@register("r03_first_hit", ctes("log") + f"SELECT trace_id, CASE WHEN {_T[0]} THEN 'R1' WHEN {_T[1]} THEN 'R2' WHEN {_T[2]} THEN 'R3' END AS rule FROM log")
def r03(spark, d):
    return D.apply_rule_set(_log(spark, d), _rules("FIRST_HIT")).select("trace_id", F.get("hits", F.lit(0))["rule"].alias("rule"))


@register("r04_all_hits", ctes("log") + f"SELECT trace_id, concat_ws(',', CASE WHEN {_T[0]} THEN 'R1' END, CASE WHEN {_T[1]} THEN 'R2' END, CASE WHEN {_T[2]} THEN 'R3' END) AS rules, concat_ws(',', CASE WHEN {_T[0]} THEN 'REJECT' END, CASE WHEN {_T[1]} THEN 'REVIEW' END, CASE WHEN {_T[2]} THEN 'PASS' END) AS actions FROM log")
def r04(spark, d):
    out = D.apply_rule_set(_log(spark, d), _rules("ALL"))
    return out.select("trace_id", F.array_join(F.transform("hits", lambda h: h["rule"]), ",").alias("rules"), F.array_join("actions", ",").alias("actions"))


@register("r05_priority", ctes("log") + f"SELECT trace_id, CASE WHEN {_T[1]} THEN 'R2' WHEN {_T[2]} THEN 'R3' WHEN {_T[0]} THEN 'R1' END AS rule FROM log")
def r05(spark, d):
    return D.apply_rule_set(_log(spark, d), _rules("PRIORITY")).select("trace_id", F.get("hits", F.lit(0))["rule"].alias("rule"))


@register("r06_rule_summary", ctes("log") + f"SELECT trace_id, ({_T[0]})::INT + ({_T[1]})::INT + ({_T[2]})::INT AS hit_count, ({_T[0]}) OR {_T[1]} OR {_T[2]} AS hit, 3 AS evaluated FROM log")
def r06(spark, d):
    return D.apply_rule_set(_log(spark, d), _rules("ALL")).select("trace_id", "hit_count", "hit", "evaluated")


@register("r07_scorecard", ctes("log") + _CARD_SQL + "SELECT trace_id, total::DOUBLE AS total, decision, CASE WHEN total_score < 50 THEN 'low' WHEN total_score < 150 THEN 'mid' ELSE 'high' END || '/' || CASE WHEN duration_ms < 30 THEN 'fast' WHEN duration_ms < 80 THEN 'slow' ELSE 'N/A' END AS labels FROM sd")
def r07(spark, d):
    return D.apply_scorecard(_log(spark, d), _CARD).select("trace_id", "total", "decision", F.array_join(F.transform("breakdown", lambda b: b["label"]), "/").alias("labels"))


@register("r08_decision_table", ctes("log") + f"SELECT trace_id, {_ROW} AS row, CASE {_ROW} WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 END AS \"limit\", CASE {_ROW} WHEN 0 THEN 'none' WHEN 1 THEN 'some' WHEN 2 THEN 'more' END AS word FROM log")
def r08(spark, d):
    return D.apply_decision_table(_log(spark, d), _TABLE).select("trace_id", "row", "limit", "word")


@register("r09_decision_tree", ctes("log") + f"SELECT trace_id, {_TREE_SQL} AS action FROM log")
def r09(spark, d):
    return D.apply_decision_tree(_log(spark, d), _TREE).select("trace_id", "action")


@register("r10_flow", ctes("log") + _CARD_SQL + f"SELECT trace_id, {_FLOW_ACTION} AS flow_action, CASE WHEN total_score < 50 THEN 'start>rules>no' WHEN decision = 'PASS' THEN 'start>rules>card>yes' WHEN decision = 'REJECT' THEN 'start>rules>card>no' ELSE 'start>rules>card' END AS path FROM sd")
def r10(spark, d):
    return D.apply_flow(_log(spark, d), FLOW).select("trace_id", "flow_action", F.array_join("path", ">").alias("path"))


_DEFS = [
    {"varId": "ratio", "expression": "doubled / (duration_ms + 1)", "dependencies": ["doubled"]},
    {"varId": "doubled", "expression": "total_score * 2", "dependencies": []},
    {"varId": "flag", "expression": 'ratio > 5 && event_type == "view" ? 1 : 0', "dependencies": ["ratio"]},
]


@register("r11_resolve_variables", ctes("log", "cust") + "SELECT trace_id, coalesce(annual_income::DOUBLE, -1) AS income, coalesce(gender, 'X') AS gender, (total_score * 2)::DOUBLE AS doubled FROM log LEFT JOIN cust USING (customer_id)")
def r11(spark, d):
    external = frame(spark, d, "cust").select("customer_id", F.col("annual_income").cast("double").alias("income"))
    cached = frame(spark, d, "cust").select("customer_id", F.lit(0.0).alias("income"), "gender")
    out = D.resolve_variables(_log(spark, d), "customer_id", [external, cached], _DEFS[1:2])
    return out.select("trace_id", F.coalesce("income", F.lit(-1.0)).alias("income"), F.coalesce("gender", F.lit("X")).alias("gender"), F.col("doubled").cast("double").alias("doubled"))


@register("r12_derive", ctes("log") + "SELECT trace_id, (total_score::DOUBLE * 2) / (duration_ms + 1) AS ratio, CASE WHEN (total_score * 2)::DOUBLE / (duration_ms + 1) > 5 AND event_type = 'view' THEN 1 ELSE 0 END AS flag FROM log")
def r12(spark, d):
    return D.derive(_log(spark, d).withColumn("total_score", F.col("total_score").cast("double")), _DEFS).select("trace_id", "ratio", "flag")


_EDGES = "SELECT DISTINCT 'V' || user_id AS variable, 'V' || (user_id // 2) AS needs FROM events WHERE user_id > 1"


@register("r13_dependency_closure", f"WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT * FROM e UNION SELECT c.variable, e.needs FROM c JOIN e ON c.needs = e.variable) SELECT * FROM c")
def r13(spark, d):
    log = _log(spark, d).where("customer_id > 1")
    edges = log.select(F.concat(F.lit("V"), "customer_id").alias("variable"), F.concat(F.lit("V"), F.expr("customer_id div 2")).alias("needs")).distinct()
    return D.dependency_closure(edges)


@register("r14_decide", ctes("log") + _CARD_SQL + f"SELECT trace_id, CASE {_FLOW_ACTION} WHEN 'APPROVE' THEN 'PASS' WHEN 'REJECT' THEN 'REJECT' ELSE 'MANUAL' END AS decision_result FROM sd")
def r14(spark, d):
    return D.decide(_log(spark, d).drop("decision_result"), "customer_id", [], _DEFS, FLOW).select("trace_id", "decision_result")


@register("r15_mask_snapshot", ctes("cust") + """SELECT customer_id, '{"phone":"' || substr(phone, 1, 3) || '****' || right(phone, 4) || '","gender":"' || gender || '"}' AS snapshot FROM cust""")
def r15(spark, d):
    return D.mask_snapshot(frame(spark, d, "cust"), {"phone": "mobile"}, ["phone", "gender"]).select("customer_id", "snapshot")


_SHARE = "(total_score::DOUBLE - 100) / 2"
_SCALE = "greatest(0.1, least(2.0, abs({}::DOUBLE) / 100))"


@register("r16_attribute", ctes("log") + f"SELECT trace_id, {_SHARE} * {_SCALE.format('total_score')} AS a, {_SHARE} * {_SCALE.format('duration_ms')} AS b FROM log")
def r16(spark, d):
    out = D.attribute(_log(spark, d), ["total_score", "duration_ms"], "total_score", 100.0)
    return out.select("trace_id", F.col("contributions")[0]["value"].alias("a"), F.col("contributions")[1]["value"].alias("b"))


@register("r17_uniform_attribution", ctes("log") + f"SELECT trace_id, round({_SHARE}, 6) AS a, round({_SHARE}, 6) AS b FROM log")
def r17(spark, d):
    out = D.attribute(_log(spark, d), ["total_score", "duration_ms"], "total_score", 100.0, uniform=True)
    return out.select("trace_id", F.round(F.col("contributions")[0]["value"], 6).alias("a"), F.round(F.col("contributions")[1]["value"], 6).alias("b"))


@register("r18_direction", ctes("log") + f"SELECT trace_id, CASE WHEN {_SHARE} > 0.001 THEN 'POSITIVE' WHEN {_SHARE} < -0.001 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS direction, round({_SHARE} * 2, 6) AS total FROM log")
def r18(spark, d):
    out = D.attribute(_log(spark, d), ["total_score", "duration_ms"], "total_score", 100.0, uniform=True)
    total = F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"])
    return out.select("trace_id", D.direction(F.col("contributions")[0]["value"]).alias("direction"), F.round(total, 6).alias("total"))


@register("t03_top_contributions", ctes("log") + f"SELECT trace_id, CASE WHEN {_SCALE.format('total_score')} < {_SCALE.format('duration_ms')} AND {_SHARE} <> 0 OR ({_SCALE.format('total_score')} = {_SCALE.format('duration_ms')} OR {_SHARE} = 0) THEN 'duration_ms' ELSE 'total_score' END AS name FROM log")
def t03(spark, d):
    out = D.top_contributions(D.attribute(_log(spark, d), ["total_score", "duration_ms"], "total_score", 100.0), 1)
    return out.select("trace_id", F.col("contributions")[0]["name"].alias("name"))


_F1, _F2 = (f"{_SHARE} * {_SCALE.format(c)}" for c in ("total_score", "duration_ms"))
_WAY = "CASE WHEN {0} > 0.001 THEN 'POSITIVE' WHEN {0} < -0.001 THEN 'NEGATIVE' ELSE 'NEUTRAL' END"
_FACTORS = f"SELECT trace_id, name, value, row_number() OVER (PARTITION BY trace_id ORDER BY abs(value) DESC, name) AS n FROM (SELECT trace_id, 'total_score' AS name, {_F1} AS value FROM log UNION ALL SELECT trace_id, 'duration_ms', {_F2} FROM log)"


@register("t04_top_factors", ctes("log") + f"SELECT trace_id, CAST(n AS INT) AS place, name, round(value, 8) AS value, {_WAY.format('value')} AS direction FROM ({_FACTORS})")
def t04(spark, d):
    out = D.top_contributions(D.attribute(_log(spark, d), ["total_score", "duration_ms"], "total_score", 100.0), 2)
    each = out.select("trace_id", F.posexplode("contributions").alias("place", "c"))
    return each.select("trace_id", (F.col("place") + 1).alias("place"), "c.name", F.round("c.value", 8).alias("value"), D.direction(F.col("c.value")).alias("direction"))


_SPLIT = {"experimentId": "E1", "trafficKey": "customer_id", "enabled": True, "groups": [{"groupId": "A", "trafficRatio": 0.5}, {"groupId": "B", "trafficRatio": 0.3}, {"groupId": "C", "trafficRatio": 0.2}]}
_GRP = ", g AS (SELECT *, CASE WHEN h < 0.5 THEN 'A' WHEN h < 0.8 THEN 'B' ELSE 'C' END AS grp FROM (SELECT *, ('0x' || substr(sha256(customer_id || ':E1'), 13, 4))::INT / 65536.0 AS h FROM log)) "


@register("x01_assign_group", ctes("log") + _GRP + "SELECT trace_id, grp FROM g")
def x01(spark, d):
    return D.assign_group(_log(spark, d), "customer_id", _SPLIT).select("trace_id", "grp")


@register("x02_disabled_experiment", ctes("log") + "SELECT trace_id, 'A' AS grp FROM log")
def x02(spark, d):
    return D.assign_group(_log(spark, d), "customer_id", _SPLIT | {"enabled": False}).select("trace_id", "grp")


_MET = _GRP + ", m AS (SELECT grp, count(*) AS total, count(*) FILTER (decision_result = 'PASS') AS passed, round(avg(duration_ms), 6) AS mean_duration, round(avg(len(hit_rules)), 6) AS mean_hits FROM g GROUP BY 1) "


@register("a31_experiment_metrics", ctes("log") + _MET + "SELECT * FROM m")
def a31(spark, d):
    out = D.experiment_metrics(D.assign_group(_log(spark, d), "customer_id", _SPLIT))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_duration", "mean_hits")})


@register("x03_p_value", ctes("log") + _MET + """, s AS (SELECT a.total AS n1, a.passed / a.total AS p1, b.total AS n2, b.passed / b.total AS p2 FROM m a, m b WHERE a.grp = 'A' AND b.grp = 'B'),
z AS (SELECT abs(p1 - p2) / sqrt(((p1 * n1 + p2 * n2) / (n1 + n2)) * (1 - (p1 * n1 + p2 * n2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM s), t AS (SELECT z, 1 / (1 + z * 0.2316419) AS t FROM z)
SELECT round(2 * 0.3989423 * exp(-z * z / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274)))), 6) AS p_value FROM t""")
def x03(spark, d):
    return D.p_value(D.experiment_metrics(D.assign_group(_log(spark, d), "customer_id", _SPLIT)), "A", "B").select(F.round("p_value", 6).alias("p_value"))


def _history(spark, d):
    log = _log(spark, d)
    return log.withColumns({"old_result": F.when(F.col("decision_result") == "PASS", "APPROVE").otherwise(F.col("decision_result")), "old_score": F.col("total_score"), "new_score": F.col("total_score") + F.col("duration_ms") % 11, "old_code": F.col("flow_id"), "new_code": F.when(F.col("duration_ms") % 3 == 0, "Z").otherwise(F.col("flow_id"))})


_DIFF = _CARD_SQL + f""", h AS (SELECT trace_id, CASE WHEN decision_result = 'PASS' THEN 'APPROVE' ELSE decision_result END AS o, {_FLOW_ACTION} AS n, duration_ms, flow_id FROM sd),
df AS (SELECT trace_id, CASE WHEN o <> n THEN 'RESULT' WHEN duration_ms % 11 > 5 THEN 'SCORE' WHEN duration_ms % 3 = 0 THEN 'REJECT_CODE' ELSE 'UNCHANGED' END AS diff FROM h) """


@register("x04_backtest", ctes("log") + _CARD_SQL + f"SELECT trace_id, {_FLOW_ACTION} AS new_result FROM sd")
def x04(spark, d):
    return D.backtest(_history(spark, d), FLOW).select("trace_id", "new_result")


@register("x05_classify_diff", ctes("log") + _DIFF + "SELECT trace_id, diff FROM df")
def x05(spark, d):
    return D.backtest(_history(spark, d), FLOW).select("trace_id", "diff")


@register("a32_diff_report", ctes("log") + _DIFF + "SELECT count(*) AS total, count(*) FILTER (diff <> 'UNCHANGED') AS changed, count(*) FILTER (diff <> 'UNCHANGED') / count(*) AS change_rate, count(*) FILTER (diff = 'RESULT') AS n_result, count(*) FILTER (diff = 'SCORE') AS n_score, count(*) FILTER (diff = 'REJECT_CODE') AS n_reject_code FROM df")
def a32(spark, d):
    return D.diff_report(D.backtest(_history(spark, d), FLOW))


@register("ud05_backtest_function", ctes("log") + "SELECT trace_id, CASE WHEN trace_id % 100 = 0 THEN NULL ELSE CASE WHEN total_score > 100 THEN 'PASS' ELSE 'REJECT' END END AS decision, CASE WHEN trace_id % 100 = 0 THEN 'ValueError: refused' END AS error, CASE WHEN trace_id % 100 = 0 THEN NULL ELSE trace_id END AS id FROM log")
def ud05(spark, d):
    def one(record):
        if record["trace_id"] % 100 == 0:
            raise ValueError("refused")
        return {"id": record["trace_id"], "decision": "PASS" if record["total_score"] > 100 else "REJECT", "trace_id": record["trace_id"]}

    rows = _log(spark, d).select("trace_id", F.col("total_score").cast("double").alias("total_score"))
    return D.backtest_fn(rows, one, "id bigint, decision string, trace_id bigint", "trace_id").select("id", "decision", "error", "trace_id")
