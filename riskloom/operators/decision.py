"""Decision artefacts (dictionaries) as Columns over whole frames.

A missing field makes every comparison false, and NOT of it true: each leaf is closed with ``coalesce(…, false)``, so no
three-valued logic leaks out. All numbers compare as doubles.
"""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.sources.ingest import held

_COMPARE = {"GT": "__gt__", "LT": "__lt__", "GTE": "__ge__", "LTE": "__le__", "EQ": "__eq__", "NEQ": "__ne__"}


def _field(name: str, value) -> Column:
    return F.col(name).cast("double") if isinstance(value, (int, float)) and not isinstance(value, bool) else F.col(name)


def condition(node: dict) -> Column:
    """Truth of a condition: {operator, operands} with AND, OR, NOT, or {field, op, value}."""
    if "operator" in node:
        parts = [condition(x) for x in node["operands"]]
        if node["operator"] == "NOT":
            return ~parts[0]
        return reduce({"AND": and_, "OR": or_}[node["operator"]], parts)
    field, op, value = node["field"], node["op"], node.get("value")
    if op == "BETWEEN":
        low, high = value
        known = next((v for v in value if v is not None), None)
        col = _field(field, known)
        test = F.col(field).isNotNull()
        test = test & (col >= F.lit(low)) if low is not None else test
        test = test & (col <= F.lit(high)) if high is not None else test
    elif op == "IN":
        test = _field(field, value[0] if value else "").isin(*value) if value else F.lit(False)
    elif op in _COMPARE:
        if value is None:
            raise ValueError(f"{field} {op} needs a value")
        test = getattr(_field(field, value), _COMPARE[op])(F.lit(float(value) if isinstance(value, int) and not isinstance(value, bool) else value))
    else:
        raise ValueError(f"unknown comparison {op}")
    return F.coalesce(test, F.lit(False))


def _chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in cases:
        out = (F if out is None else out).when(test, value)
    return default if out is None else out.otherwise(default)


def apply_rule_set(df: DataFrame, spec: dict) -> DataFrame:
    """Adds ``hits`` (rule ids), ``actions``, ``hit``, ``hit_count`` and ``evaluated``.

    FIRST_HIT keeps the first hit in the given order, PRIORITY in descending stable order of priority, ALL keeps all.
    """
    rules = spec["rules"]
    if spec["hitPolicy"] == "PRIORITY":
        rules = sorted(rules, key=lambda r: -r.get("priority", 0))
    tests = [condition(r["conditions"]) for r in rules]
    found = [F.struct(F.lit(r["ruleId"]).alias("rule"), F.lit(r.get("actions", [{}])[0].get("type")).cast("string").alias("action"), F.lit(r.get("actions", [{}])[0].get("code")).cast("string").alias("code")) for r in rules]
    kind = "array<struct<rule:string,action:string,code:string>>"
    if not rules:
        hits = F.array().cast(kind)
    elif spec["hitPolicy"] == "ALL":
        hits = F.filter(F.array(*(F.when(t, f) for t, f in zip(tests, found))), lambda x: x.isNotNull()).cast(kind)
    else:
        hits = _chain([(t, F.array(f)) for t, f in zip(tests, found)], F.array().cast(kind)).cast(kind)
    return df.withColumn("hits", hits).withColumns({"actions": F.transform("hits", lambda h: h["action"]), "hit": F.size("hits") > 0, "hit_count": F.size("hits"), "evaluated": F.lit(len(rules))})


def score_bin(characteristic: dict) -> tuple[Column, Column]:
    """Score and label of the bin [low, high) that holds the field; 0 and N/A for null, NaN or no bin."""
    x, bins = F.col(characteristic["field"]).cast("double"), characteristic["bins"]
    tests = [reduce(and_, ([x >= F.lit(float(b["range"][0]))] if b["range"][0] is not None else []) + ([x < F.lit(float(b["range"][1]))] if b["range"][1] is not None else []), ~F.isnan(x) & x.isNotNull()) for b in bins]
    return _chain([(t, F.lit(float(b["score"]))) for t, b in zip(tests, bins)], F.lit(0.0)), _chain([(t, F.lit(b["label"])) for t, b in zip(tests, bins)], F.lit("N/A"))


def apply_scorecard(df: DataFrame, spec: dict) -> DataFrame:
    """Adds ``breakdown``, ``total`` and ``decision``: below reject REJECT, below pass REVIEW, else PASS."""
    parts = [(c["name"], *score_bin(c)) for c in spec["characteristics"]]
    cut, out = spec["cutoff"], df.withColumn("breakdown", F.array(*(F.struct(F.lit(n).alias("name"), s.alias("score"), lab.alias("label")) for n, s, lab in parts)))
    out = out.withColumn("total", F.lit(float(spec.get("initialScore", 0))) + F.aggregate("breakdown", F.lit(0.0), lambda a, b: a + b["score"]))
    return out.withColumn("decision", F.when(F.col("total") < cut["reject"], "REJECT").when(F.col("total") < cut["pass"], "REVIEW").otherwise("PASS"))


def _typed(values: list) -> str:
    """SQL type of the literals of a result's field."""
    kinds = {type(v) for v in values if v is not None}
    if not kinds or str in kinds:
        return "string"
    if kinds == {bool}:
        return "boolean"
    return "double" if float in kinds else "int" if all(v is None or abs(v) < 2**31 for v in values) else "bigint"


def apply_decision_table(df: DataFrame, spec: dict, chain: int = 200) -> DataFrame:
    """Adds ``row`` (number, from 0) and the result's fields of the first matching row; ``*`` matches all, null only null.

    Up to ``chain`` rows become one CASE chain. The rows of larger tables are grouped by which cells are wildcards, which are few
    patterns; each pattern is one equality join on its other cells, with the first row of equal cells, and the least row number
    wins. No row of the frame is multiplied or regrouped, so its columns may have any type. The tables come from the artefact,
    are as large as it, and are sent to all tasks.
    """
    fields, rows, spark = [c["field"] for c in spec["columns"]], spec["rows"], df.sparkSession
    names = list(rows[0]["result"]) if rows else []

    def test(row: dict) -> Column:
        cells = [F.col(f).cast("string").eqNullSafe(F.lit(None if v is None else str(v))) for f, v in zip(fields, row["conditions"]) if v != "*"]
        return reduce(and_, cells, F.lit(True))

    if len(rows) <= chain:
        out = df.withColumn("row", _chain([(test(r), F.lit(i)) for i, r in enumerate(rows)], F.lit(None).cast("int")))
        return out.withColumns({n: F.when(F.col("row").isNotNull(), F.get(F.array(*(F.lit(r["result"].get(n)) for r in rows)), F.col("row"))) for n in names})
    patterns: dict[tuple[int, ...], dict[tuple, int]] = {}
    for i, r in enumerate(rows):
        known = tuple(k for k, v in enumerate(r["conditions"]) if v != "*")
        patterns.setdefault(known, {}).setdefault(tuple(None if r["conditions"][k] is None else str(r["conditions"][k]) for k in known), i)
    mark = "_dt"
    while any(c.startswith(mark) for c in df.columns):
        mark += "_"
    out, found = df, []
    for p, (known, cells) in enumerate(patterns.items()):
        if not known:
            found.append(F.lit(cells[()]))
            continue
        columns = [f"{mark}{p}_{k}" for k in known]
        table = spark.createDataFrame([(i, *key) for key, i in cells.items()], ", ".join([f"{mark}{p} int", *(f"{c} string" for c in columns)]))
        out = out.join(F.broadcast(table), reduce(and_, (F.col(fields[k]).cast("string").eqNullSafe(F.col(c)) for k, c in zip(known, columns))), "left").drop(*columns)
        found.append(F.col(f"{mark}{p}"))
    out = out.withColumn("row", F.least(*found) if len(found) > 1 else found[0]).select(*df.columns, "row")
    kinds = {n: _typed([r["result"].get(n) for r in rows]) for n in names}
    cast = {"string": str, "double": float, "int": int, "bigint": int, "boolean": bool}
    told = [(i, *(None if (v := r["result"].get(n)) is None else cast[kinds[n]](v) for n in names)) for i, r in enumerate(rows)]
    results = spark.createDataFrame(told, ", ".join([f"{mark} int", *(f"`{n}` {kinds[n]}" for n in names)]))
    replaced = out.drop(*names)
    return replaced.join(F.broadcast(results), replaced["row"] == results[mark], "left").drop(mark)


def tree_column(node: dict) -> Column:
    """Action of a decision tree: {condition, trueChild, falseChild} or {action}; a missing child gives null."""
    if node is None:
        return F.lit(None).cast("string")
    if "action" in node:
        return F.lit(node["action"])
    return F.when(condition(node["condition"]), tree_column(node.get("trueChild"))).otherwise(tree_column(node.get("falseChild")))


def apply_decision_tree(df: DataFrame, spec: dict) -> DataFrame:
    return df.withColumn("action", tree_column(spec))


def topological(nodes: list[str], edges: list[tuple[str, str]]) -> list[str]:
    """An order in which every edge points forward; a cycle is refused."""
    order, left = [], list(nodes)
    while left:
        free = [n for n in left if not any(b == n and a in left for a, b in edges)]
        if not free:
            raise ValueError(f"cycle among {sorted(left)}")
        order += free
        left = [n for n in left if n not in free]
    return order


def apply_flow(df: DataFrame, spec: dict) -> DataFrame:
    """Adds ``path`` (ids of visited nodes) and ``flow_action``.

    From a node the first edge, in the given order, that is unconditional or true is taken; the action is that of the last
    visited node, or MANUAL where no edge applies. Nodes of type RULE_SET, SCORECARD, TABLE and TREE apply their ``spec``
    and publish <id>_result, which later conditions can read; ACTION nodes end the flow.
    """
    nodes = {n["id"]: n for n in spec["nodes"]}
    edges = [(e["from"], e["to"]) for e in spec["edges"]]
    order, kept = topological(list(nodes), edges), df.columns
    inner = {b for _, b in edges}
    reach: dict[str, Column] = {n: F.lit(n not in inner) for n in order}
    action = F.lit("MANUAL")
    for name in order:
        node = nodes[name]
        df = df.withColumn(f"_at_{name}", reach[name])
        kind, made = node["type"], None
        if kind == "RULE_SET":
            made = apply_rule_set(df, node["spec"]), F.get("actions", F.lit(0))
        elif kind == "SCORECARD":
            made = apply_scorecard(df, node["spec"]), F.col("decision")
        elif kind == "TREE":
            made = apply_decision_tree(df, node["spec"]), F.col("action")
        elif kind == "TABLE":
            made = apply_decision_table(df, node["spec"]), F.col(node["result"])
        if made:
            df = made[0].withColumn(f"{name}_result", made[1]).select(*df.columns, f"{name}_result")
        taken = F.col(f"_at_{name}")
        for edge in (e for e in spec["edges"] if e["from"] == name):
            go = taken & (condition(edge["condition"]) if edge.get("condition") else F.lit(True))
            taken = taken & ~go
            df = df.withColumn(f"_go_{edge['to']}_{name}", go)
            reach[edge["to"]] = reduce(or_, (F.col(c) for c in df.columns if c.startswith(f"_go_{edge['to']}_")), F.lit(edge["to"] not in inner))
        if kind == "ACTION":
            action = F.when(F.col(f"_at_{name}"), F.lit(node["action"])).otherwise(action)
    path = F.filter(F.array(*(F.when(F.col(f"_at_{n}"), F.lit(n)) for n in order)), lambda x: x.isNotNull())
    return df.withColumn("path", path).withColumn("flow_action", action).select(*kept, "path", "flow_action")


def derive(df: DataFrame, definitions: list[dict]) -> DataFrame:
    """Derived variables {varId, expression, dependencies} in dependency order; existing columns win."""
    from riskloom.functions.expressions import expression

    by_id = {x["varId"]: x for x in definitions}
    order = topological(list(by_id), [(d, v) for v, x in by_id.items() for d in x["dependencies"] if d in by_id])
    for name in order:
        value = expression(by_id[name]["expression"])
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def resolve_variables(df: DataFrame, key: str, sources: list[DataFrame], definitions: list[dict]) -> DataFrame:
    """Variables from layers: the frame's own columns first, then each source (one row per key), then derived ones."""
    for source in sources:
        names = [c for c in source.columns if c != key]
        joined = df.join(source.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)), key, "left")
        df = joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_new_{c}")) if c in df.columns else F.col(f"_new_{c}") for c in names}).drop(*(f"_new_{c}" for c in names))
    return derive(df, definitions)


def dependency_closure(edges: DataFrame) -> DataFrame:
    """(variable, needs) for all direct and indirect dependencies, each pair once; only new pairs are extended, so cycles end.

    The tables of a round are joined by merging: broadcast, round after round, they would all pass through the driver.
    """
    edges = held(edges.select("variable", "needs").distinct(), "edges")
    found = new = edges
    while True:
        steps = new.join(edges.select(F.col("variable").alias("needs"), F.col("needs").alias("far")).hint("merge"), "needs").select("variable", F.col("far").alias("needs")).distinct()
        new = held(steps.join(found.hint("merge"), ["variable", "needs"], "left_anti"), "edges")
        if new.isEmpty():
            return found
        found = found.union(new)


def decide(df: DataFrame, key: str, sources: list[DataFrame], definitions: list[dict], flow: dict) -> DataFrame:
    """Variables, then the flow, then the normalised result: one row of the decision log per record."""
    from riskloom.functions.scalars import normalise_result

    return apply_flow(resolve_variables(df, key, sources, definitions), flow).withColumn("decision_result", normalise_result(F.col("flow_action")))


def mask_snapshot(df: DataFrame, masks: dict[str, str], columns: list[str], name: str = "snapshot") -> DataFrame:
    """Adds a JSON text of the columns in which the named ones are masked."""
    from riskloom.functions.scalars import mask_of

    return df.withColumn(name, F.to_json(F.struct(*(mask_of(masks[c])(F.col(c)).alias(c) if c in masks else F.col(c) for c in columns))))


def attribute(df: DataFrame, features: list[str], score: str, base: float, uniform: bool = False) -> DataFrame:
    """Adds ``contributions``: an equal share of (score - base) each, scaled by clamp(|value| / 100, 0.1, 2) unless uniform."""
    share = (F.col(score).cast("double") - F.lit(base)) / len(features)

    def one(name: str) -> Column:
        size = F.lit(1.0) if uniform else F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.abs(F.coalesce(F.col(name).cast("double"), F.lit(0.0))) / 100))
        return F.struct(F.lit(name).alias("name"), (share * size).alias("value"))

    return df.withColumn("contributions", F.array(*map(one, features)))


def direction(value: Column) -> Column:
    return F.when(value > 0.001, "POSITIVE").when(value < -0.001, "NEGATIVE").otherwise("NEUTRAL")


def top_contributions(df: DataFrame, n: int) -> DataFrame:
    """The n contributions of the largest absolute value; ties by name."""
    order = "array_sort(contributions, (a, b) -> case when abs(a.value) > abs(b.value) then -1 when abs(a.value) < abs(b.value) then 1 when a.name < b.name then -1 else 1 end)"
    return df.withColumn("contributions", F.slice(F.expr(order), 1, n))


def assign_group(df: DataFrame, key: str, spec: dict) -> DataFrame:
    """Adds ``grp``: the key's place in the cumulative ratios, from 16 bits of its SHA-256; the first group if disabled."""
    groups = spec["groups"]
    if not spec.get("enabled", True):
        return df.withColumn("grp", F.lit(groups[0]["groupId"]))
    place = F.conv(F.substr(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":" + spec["experimentId"])), 256), F.lit(13), F.lit(4)), 16, 10).cast("double") / 65536
    cases, total = [], 0.0
    for g in groups:
        total += g["trafficRatio"]
        cases.append((place < total, F.lit(g["groupId"])))
    return df.withColumn("grp", _chain(cases, F.lit(groups[-1]["groupId"])))


def experiment_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("grp").agg(F.count("*").alias("total"), F.count_if(F.col("decision_result") == "PASS").alias("passed"), F.avg("duration_ms").alias("mean_duration"), F.avg(F.size("hit_rules")).alias("mean_hits"))


def p_value(metrics: DataFrame, control: str, treatment: str) -> DataFrame:
    """Two-sided two-proportion z-test of passed / total between two groups; 1 without spread."""
    def side(name: str, tag: str) -> DataFrame:
        return metrics.where(F.col("grp") == name).select(F.col("total").alias(f"n{tag}"), (F.col("passed") / F.col("total")).alias(f"p{tag}"))

    both = side(control, "1").join(F.broadcast(side(treatment, "2")), F.lit(True))
    pooled = (F.col("p1") * F.col("n1") + F.col("p2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    z = F.abs(F.col("p1") - F.col("p2")) / spread
    t = 1 / (1 + z * 0.2316419)
    tail = 0.3989423 * F.exp(-z * z / 2) * t * (0.3193815 + t * (-0.3565638 + t * (1.781478 + t * (-1.821256 + t * 1.330274))))
    return both.select(F.when(spread > 0, 2 * tail).otherwise(1.0).alias("p_value"))


def classify_diff(df: DataFrame, threshold: float = 5) -> DataFrame:
    """Adds ``diff`` from old_/new_ result, score and code: RESULT, then SCORE beyond the threshold, then REJECT_CODE."""
    result = F.col("old_result").isNotNull() & ~F.col("old_result").eqNullSafe(F.col("new_result"))
    score = F.coalesce(F.abs(F.col("old_score") - F.col("new_score")) > threshold, F.lit(False))
    code = ~F.col("old_code").eqNullSafe(F.col("new_code"))
    return df.withColumn("diff", F.when(result, "RESULT").when(score, "SCORE").when(code, "REJECT_CODE").otherwise("UNCHANGED"))


def diff_report(df: DataFrame) -> DataFrame:
    changed = F.count_if(F.col("diff") != "UNCHANGED")
    return df.agg(F.count("*").alias("total"), changed.alias("changed"), F.coalesce(F.try_divide(changed, F.count("*")), F.lit(0.0)).alias("change_rate"), *(F.count_if(F.col("diff") == k).alias(f"n_{k.lower()}") for k in ("RESULT", "SCORE", "REJECT_CODE")))


def backtest(history: DataFrame, flow: dict) -> DataFrame:
    """History rows (with old_ columns) under a candidate flow, classified."""
    return classify_diff(apply_flow(history, flow).withColumnRenamed("flow_action", "new_result"))


def backtest_fn(history: DataFrame, decide_one, schema: str, key: str) -> DataFrame:
    """History under any Python decision function from record to record; an error becomes a row of the sample's key and the error's text."""
    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    rows.append(decide_one(record) | {"error": None})
                except Exception as error:  # the function is the caller's; its failures are results
                    rows.append({key: record[key], "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    names = [f.split()[0] for f in schema.split(", ")] + ["error"]
    return history.mapInPandas(run, f"{schema}, error string")
