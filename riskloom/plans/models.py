"""Queries of the model data operators (M), W-05 to W-07 and U-05."""

from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators.tables import latest_per_key
from riskloom.plans.registry import register
from riskloom.sources.bindings import ctes, frame
from riskloom.sources.tables import table

_N = 64


def _scored(spark, d):
    return frame(spark, d, "scored").withColumn("p", F.col("p").cast("double"))


_S = ctes("scored") + ", s AS (SELECT id, y, CAST(value AS DECIMAL(10,2))::DOUBLE AS v, day, event_type, p::DOUBLE AS p FROM (SELECT *, CAST(value AS DECIMAL(10,2)) / 500 AS q FROM scored))"


def _matrix(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.when(F.col("label") >= 5, 1).otherwise(0).alias("y"), F.col("embedding").cast("array<double>").alias("x"))


_MAT = "WITH m AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(_N)) + " FROM embeddings)"
_EDGES = ", e AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM events), b AS (SELECT event_id, y, value, len(list_filter(e.e, lambda x: value > x)) AS bin FROM (SELECT event_id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events), e)"
_B = "WITH z AS (SELECT 1)" + _EDGES
_WOE = _B + ", c AS (SELECT bin, sum(y) AS bad, count(*) - sum(y) AS good FROM b GROUP BY 1), r AS (SELECT bin, good, bad, (bad + 0.5) / (sum(bad) OVER () + 0.5 * count(*) OVER ()) AS pb, (good + 0.5) / (sum(good) OVER () + 0.5 * count(*) OVER ()) AS pg FROM c)"


def _events(spark, d):
    return table(spark, d, "events").withColumn("y", F.when(F.col("event_type") == "error", 1).otherwise(0))


def _binned(spark, d):
    rows = _events(spark, d)
    edges = M.quantile_edges(rows, "value")
    return rows.withColumn("bin", M.bin_of(F.col("value"), edges)), edges


@register("m01_quantile_bins", _B + " SELECT bin::BIGINT AS bin, count(*) AS n FROM b GROUP BY 1")
def m01(spark, d):
    return _binned(spark, d)[0].groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@register("m02_category_bins", "WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 9) SELECT coalesce(t.user_id::VARCHAR, 'OTHER') AS bin, count(*) AS n FROM events LEFT JOIN t USING (user_id) GROUP BY 1")
def m02(spark, d):
    return M.category_bins(table(spark, d, "events"), "user_id", 10).groupBy("bin").agg(F.count("*").alias("n"))


@register("m03_woe_table", _WOE + " SELECT bin::BIGINT AS bin, good::BIGINT AS good, bad::BIGINT AS bad, round(ln(pb / pg), 8) AS woe, round((pb - pg) * ln(pb / pg), 8) AS iv FROM r")
def m03(spark, d):
    out = M.woe_table(_binned(spark, d)[0], [], "y")
    return out.select(F.col("bin").cast("long").alias("bin"), "good", "bad", F.round("woe", 8).alias("woe"), F.round("iv", 8).alias("iv"))


_IV = _MAT + ", l AS (UNPIVOT m ON " + ", ".join(f"f{i}" for i in range(_N)) + " INTO NAME feature VALUE value), e AS (SELECT feature, list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS e FROM l GROUP BY 1), b AS (SELECT l.feature, y, len(list_filter(e.e, lambda x: l.value > x)) AS bin FROM l JOIN e ON l.feature = e.feature), c AS (SELECT feature, bin, sum(y) AS bad, count(*) - sum(y) AS good FROM b GROUP BY 1, 2), r AS (SELECT feature, (bad + 0.5) / (sum(bad) OVER w + 0.5 * count(*) OVER w) AS pb, (good + 0.5) / (sum(good) OVER w + 0.5 * count(*) OVER w) AS pg FROM c WINDOW w AS (PARTITION BY feature)), iv AS (SELECT feature, sum((pb - pg) * ln(pb / pg)) AS iv FROM r GROUP BY 1)"


@register("m04_iv_filter", _IV + " SELECT feature, round(iv, 8) AS iv FROM iv WHERE iv >= 0.02")
def m04(spark, d):
    return M.iv_filter(_matrix(spark, d), "x", "y").select("feature", F.round("iv", 8).alias("iv"))


@register("m05_correlation_filter")
def m05(spark, d):
    rows = _matrix(spark, d).withColumn("x", F.concat("x", F.array(F.col("x")[0] * 2 + F.col("x")[1] * 0.01)))
    iv = {r.feature: r.iv for r in M.feature_iv(rows, "x", "y").collect()}
    return rows.agg(F.count("*").alias("rows")).select("rows", F.explode(F.array(*map(F.lit, M.correlation_filter(rows, "x", iv)))).alias("feature"))


@register("m06_woe_transform", _WOE + " SELECT event_id, round(ln(pb / pg), 8) AS value_woe FROM b JOIN r USING (bin)")
def m06(spark, d):
    rows, edges = _binned(spark, d)
    return M.woe_transform(rows, "value", edges, M.woe_table(rows, [], "y")).select("event_id", F.round("value_woe", 8).alias("value_woe"))


_CUM = _S + ", g AS (SELECT p, count(*) AS n, sum(y) AS ones, count(*) - sum(y) AS zeros FROM s GROUP BY 1), c AS (SELECT *, sum(ones) OVER w / sum(ones) OVER () AS tpr, sum(zeros) OVER w / sum(zeros) OVER () AS fpr FROM g WINDOW w AS (ORDER BY p {} ROWS UNBOUNDED PRECEDING))"


@register("w07_cumulative_rates", _CUM.format("DESC") + " SELECT p, round(tpr, 10) AS tpr, round(fpr, 10) AS fpr FROM c")
def w07(spark, d):
    return M.cumulative_rates(_scored(spark, d), "y", "p").select("p", F.round("tpr", 10).alias("tpr"), F.round("fpr", 10).alias("fpr"))


@register("m07_ks", _CUM.format("ASC") + " SELECT round(abs(tpr - fpr), 10) AS ks, p AS threshold FROM c ORDER BY round(abs(tpr - fpr), 12) DESC, p LIMIT 1")
def m07(spark, d):
    return M.ks(_scored(spark, d), "y", "p").select(F.round("ks", 10).alias("ks"), "threshold")


_AUC = _S + ", g AS (SELECT p, sum(y) AS ones, count(*) - sum(y) AS zeros FROM s GROUP BY 1), c AS (SELECT *, sum(zeros) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) - zeros AS zb FROM g), a AS (SELECT sum(ones * (zb + zeros / 2)) / (sum(ones) * sum(zeros)) AS auc FROM c)"


@register("m08_auc", _AUC + " SELECT round(auc, 10) AS auc, round(2 * auc - 1, 10) AS gini FROM a")
def m08(spark, d):
    return M.auc(_scored(spark, d), "y", "p").select(F.round("auc", 10).alias("auc"), F.round("gini", 10).alias("gini"))


_CONF = _S + ", k AS (SELECT count(*) FILTER (p >= 0.3 AND y = 1) AS tp, count(*) FILTER (p >= 0.3 AND y = 0) AS fp, count(*) FILTER (p < 0.3 AND y = 1) AS fn, count(*) FILTER (p < 0.3 AND y = 0) AS tn FROM s), r AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM k)"


@register("m09_classification_metrics", _CONF + " SELECT tp, fp, fn, tn, round(accuracy, 10) AS accuracy, round(precision, 10) AS precision, round(recall, 10) AS recall, round(2 * precision * recall / (precision + recall), 10) AS f1 FROM r")
def m09(spark, d):
    out = M.classification_metrics(_scored(spark, d), "y", "p", 0.3)
    return out.withColumns({c: F.round(c, 10) for c in ("accuracy", "precision", "recall", "f1")})


@register("m10_lift", _S + " SELECT round((SELECT avg(y) FROM (SELECT y FROM s ORDER BY p DESC, id LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM s))) / avg(y), 10) AS lift FROM s")
def m10(spark, d):
    return M.lift(_scored(spark, d), "y", "p", 10, "id").select(F.round("lift", 10).alias("lift"))


_PSI = "WITH ref AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-15'), cur AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-15'), e AS (SELECT list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM ref), c AS (SELECT bin, sum(r) AS ref, sum(k) AS cur FROM (SELECT len(list_filter(e.e, lambda x: value > x)) AS bin, 1 AS r, 0 AS k FROM ref, e UNION ALL SELECT len(list_filter(e.e, lambda x: value > x)), 0, 1 FROM cur, e) GROUP BY 1), t AS (SELECT greatest(ref / sum(ref) OVER (), 1e-6) AS a, greatest(cur / sum(cur) OVER (), 1e-6) AS b FROM c), x AS (SELECT sum((b - a) * ln(b / a)) AS psi FROM t)"


@register("m11_psi", _PSI + " SELECT round(psi, 8) AS psi, CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS severity FROM x")
def m11(spark, d):
    e = table(spark, d, "events")
    return M.psi(e.where("ts < timestamp_ntz'2024-01-15'"), e.where("ts >= timestamp_ntz'2024-01-15'"), "value").select(F.round("psi", 8).alias("psi"), "severity")


_WEEK = "SELECT event_type AS feature, least(floor(value / 50), 9)::INT AS bin, count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS ref, count(*) FILTER (ts >= TIMESTAMP '2024-01-22') AS cur FROM events GROUP BY 1, 2"
_PSIC = f"WITH c AS ({_WEEK}), t AS (SELECT feature, greatest(ref / sum(ref) OVER w, 1e-6) AS a, greatest(cur / sum(cur) OVER w, 1e-6) AS b FROM c WINDOW w AS (PARTITION BY feature)), x AS (SELECT feature, sum((b - a) * ln(b / a)) AS psi FROM t GROUP BY 1)"
_SEV = "CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END"


def _weeks(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), F.least(F.floor(F.col("value") / 50), F.lit(9)).cast("int").alias("bin")).agg(
        F.count_if(F.expr("ts < timestamp_ntz'2024-01-08'")).alias("ref"), F.count_if(F.expr("ts >= timestamp_ntz'2024-01-22'")).alias("cur"))


@register("m12_psi_from_counts", _PSIC + f" SELECT feature, round(psi, 8) AS psi, {_SEV} AS severity FROM x")
def m12(spark, d):
    return M.psi_from_counts(_weeks(spark, d)).withColumn("psi", F.round("psi", 8))


_DRIFT = _PSIC + f" SELECT feature, round(psi, 8) AS psi, {_SEV} AS severity FROM x WHERE feature NOT IN ('click', 'view') UNION ALL SELECT 'click', NULL, 'UNKNOWN' UNION ALL SELECT 'view', NULL, 'UNKNOWN'"


def _drift(spark, d):
    w = _weeks(spark, d)
    ref = w.where("feature <> 'click' and ref > 0").select("feature", "bin", F.col("ref").alias("n"))
    cur = w.where("feature <> 'view' and cur > 0").select("feature", "bin", F.col("cur").alias("n"))
    return M.feature_drift(ref, cur).withColumn("psi", F.round("psi", 8))


@register("m13_feature_drift", _DRIFT)
def m13(spark, d):
    return _drift(spark, d)


@register("u05_feature_union", "SELECT feature FROM (" + _DRIFT + ") WHERE severity = 'UNKNOWN'")
def u05(spark, d):
    return _drift(spark, d).where("severity = 'UNKNOWN'").select("feature")


_TREND = "SELECT user_id AS model, event_id, value AS ks FROM events"


@register("w05_ks_trend", f"SELECT model, event_id, (first_value(ks) OVER (PARTITION BY model ORDER BY event_id) - ks) / first_value(ks) OVER (PARTITION BY model ORDER BY event_id) AS drop FROM ({_TREND})")
def w05(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), "event_id", F.col("value").alias("ks"))
    return M.ks_trend(rows, "model", "event_id", "ks").select("model", "event_id", "drop")


@register("w06_latest_state", f"SELECT model, ks FROM ({_TREND}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY event_id DESC) = 1")
def w06(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("model"), "event_id", F.col("value").alias("ks"))
    return latest_per_key(rows, ["model"], [F.desc("event_id")]).select("model", "ks")


_ALERT = "SELECT user_id AS model, 'PSI' AS kind, CASE WHEN value / 1000 >= 0.25 THEN 'CRITICAL' ELSE 'WARNING' END AS level FROM events WHERE event_type = 'view' AND value / 1000 >= 0.1 UNION ALL SELECT user_id, 'KS', 'WARNING' FROM events WHERE event_type = 'click' AND value / 500 > 0.1 UNION ALL SELECT user_id, 'FEATURE', 'CRITICAL' FROM events WHERE event_type = 'error' AND value >= 250"


def _alerts(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "model")
    drift = e.where("event_type = 'error'").select("model", F.when(F.col("value") >= 250, "CRITICAL").otherwise("STABLE").alias("severity"))
    return M.model_alerts(e.where("event_type = 'view'").select("model", (F.col("value") / 1000).alias("psi")), e.where("event_type = 'click'").select("model", (F.col("value") / 500).alias("drop")), drift)


@register("m14_model_alerts", f"SELECT model, kind, level, count(*) AS n FROM ({_ALERT}) GROUP BY ALL")
def m14(spark, d):
    return _alerts(spark, d).groupBy("model", "kind", "level").agg(F.count("*").alias("n"))


@register("m15_model_status", f"WITH a AS ({_ALERT}), m AS (SELECT c_custkey AS model FROM customer) SELECT m.model, CASE WHEN bool_or(level = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(level = 'WARNING') THEN 'WARNING' ELSE 'ACTIVE' END AS status FROM m LEFT JOIN a ON a.model = m.model GROUP BY 1")
def m15(spark, d):
    return M.model_status(_alerts(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("model")))


@register("m16_vif")
def m16(spark, d):
    rows = _matrix(spark, d)
    found = M.vif(rows, "x")
    return rows.agg(F.count("*").alias("rows")).select("rows", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(v).alias("vif")) for f, v in found))).alias("r")).select("rows", "r.*")


@register("m17_roc_curve", _CUM.format("DESC") + " SELECT p AS threshold, round(fpr, 10) AS fpr, round(tpr, 10) AS tpr FROM c")
def m17(spark, d):
    return M.cumulative_rates(_scored(spark, d), "y", "p").select(F.col("p").alias("threshold"), F.round("fpr", 10).alias("fpr"), F.round("tpr", 10).alias("tpr"))


@register("m18_ks_curve", _CUM.format("ASC") + " SELECT p AS threshold, round(abs(tpr - fpr), 10) AS gap FROM c")
def m18(spark, d):
    return M.cumulative_rates(_scored(spark, d), "y", "p", descending=False).select(F.col("p").alias("threshold"), F.round(F.abs(F.col("tpr") - F.col("fpr")), 10).alias("gap"))


@register("m19_score_distribution", _S + " SELECT g::INT AS bin, count(*) FILTER (y = 1) AS ones, count(*) FILTER (y = 0) AS zeros FROM range(20) t(g) LEFT JOIN s ON least(floor(p * 20), 19) = g GROUP BY 1")
def m19(spark, d):
    return M.score_distribution(_scored(spark, d), "y", "p")


_RATIOS = {"train": 0.7, "valid": 0.15, "test": 0.15}
_SPLIT = "CASE WHEN n <= floor(m * 0.7) THEN 'train' WHEN n <= floor(m * 0.85) THEN 'valid' ELSE 'test' END AS split"
_RANDOM = "substr(sha256(o_orderkey || ':42'), 1, 15)"


@register("m20_split_random", f"SELECT o_orderkey, {_SPLIT} FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_RANDOM}) AS n, count(*) OVER () AS m FROM orders)")
def m20(spark, d):
    return M.split_random(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", _RATIOS, 42).select("o_orderkey", "split")


@register("m21_split_stratified", f"SELECT o_orderkey, o_orderstatus, {_SPLIT} FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_RANDOM}) AS n, count(*) OVER (PARTITION BY o_orderstatus) AS m FROM orders)")
def m21(spark, d):
    return M.split_stratified(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", _RATIOS, 42)


@register("m22_split_time", f"SELECT event_id, {_SPLIT} FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS n, count(*) OVER () AS m FROM events)")
def m22(spark, d):
    return M.split_time(table(spark, d, "events").select("event_id", "ts"), "ts", _RATIOS).select("event_id", "split")


@register("m23_dataset_card", _S + " SELECT count(*) AS raw, count(*) FILTER (v > 50) AS filtered, count(*) FILTER (v > 50 AND y = 1) AS positive, count(*) FILTER (v > 50 AND y = 0) AS negative FROM s")
def m23(spark, d):
    return M.dataset_card(_scored(spark, d), F.col("value").cast("decimal(10,2)") > 50, "y")


@register("m24_train_logistic")
def m24(spark, d):
    rows = _matrix(spark, d)
    model, auc = M.train_lr(rows, "x", "y", {"regParam": [0.01, 0.1]}, 2)
    return rows.agg(F.count("*").alias("rows")).withColumn("auc", F.lit(auc)).withColumn("intercept", F.lit(float(model.intercept)))


@register("m25_train_boosted")
def m25(spark, d):
    rows = _matrix(spark, d)
    model, auc = M.train_gbt(rows, "x", "y", {"maxDepth": [2]}, 2)
    return rows.agg(F.count("*").alias("rows")).withColumn("auc", F.lit(auc)).withColumn("trees", F.lit(model.getNumTrees))


@register("m26_feature_importance")
def m26(spark, d):
    return M.feature_importance(spark, M.train_lr(_matrix(spark, d), "x", "y", {"regParam": [0.1]}, 2)[0], [f"f{i}" for i in range(_N)])


@register("m27_batch_score")
def m27(spark, d):
    rows = _matrix(spark, d)
    return M.batch_score(rows, M.train_lr(rows, "x", "y", {"regParam": [0.1]}, 2)[0], "x").select("vec_id", "probability", "score", "label")


def _sub(sql: str) -> str:
    """The part of a query behind the common rows of scores."""
    return sql.removeprefix(_S).removeprefix(", ")


_LIFT = "(SELECT round((SELECT avg(y) FROM (SELECT y FROM s ORDER BY p DESC, id LIMIT (SELECT floor(count(*) * {0})::BIGINT FROM s))) / avg(y), 10) FROM s) AS {1}"
_ALL = _S + ", " + _sub(_CUM.format("ASC")) + ", best AS (SELECT round(abs(tpr - fpr), 10) AS ks, p AS threshold FROM c ORDER BY round(abs(tpr - fpr), 12) DESC, p LIMIT 1), " + _sub(_AUC).replace("g AS", "g2 AS").replace("c AS", "c2 AS").replace("FROM g)", "FROM g2)").replace("FROM c)", "FROM c2)")
_ALL += ", " + _sub(_CONF).replace("p >= 0.3", "p >= 0.5").replace("p < 0.3", "p < 0.5")


@register("m28_evaluate", _ALL + f" SELECT ks, threshold, round(auc, 10) AS auc, round(2 * auc - 1, 10) AS gini, tp, fp, fn, tn, round(accuracy, 10) AS accuracy, round(precision, 10) AS precision, round(recall, 10) AS recall, round(CASE WHEN tp > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 10) AS f1, {_LIFT.format(0.1, 'lift_10')}, {_LIFT.format(0.2, 'lift_20')} FROM best, a, r")
def m28(spark, d):
    out = M.evaluate(_scored(spark, d), "y", "p", "id")
    return out.withColumns({c: F.round(c, 10) for c in ("ks", "auc", "gini", "accuracy", "precision", "recall", "f1", "lift_10", "lift_20")})


@register("m29_select_features")
def m29(spark, d):
    rows = _matrix(spark, d)
    kept = M.select_features(rows, "x", "y", rows.where("vec_id % 2 = 0"))
    return rows.agg(F.count("*").alias("rows")).withColumn("features", F.array(*map(F.lit, kept)).cast("array<string>"))
