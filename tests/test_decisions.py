"""Literal cases of conditions, rule sets, scorecards, tables, trees, flows and experiments."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions.expressions import to_sql, truth
from riskloom.operators import decision as D


def rows(spark):
    return spark.createDataFrame([(1, 10.0, "a"), (2, None, "b"), (3, 30.0, None)], "id int, x double, w string")


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def test_missing_field_is_false_and_its_negation_true(spark):
    leaf = {"field": "x", "op": "NEQ", "value": 10}
    df = rows(spark).select("id", D.condition(leaf).alias("a"), D.condition({"operator": "NOT", "operands": [leaf]}).alias("b"))
    assert values(df, "a") == [False, False, True]
    assert values(df, "b") == [True, True, False]


def test_between_has_open_ends(spark):
    df = rows(spark).select("id", D.condition({"field": "x", "op": "BETWEEN", "value": [None, 10]}).alias("a"), D.condition({"field": "x", "op": "BETWEEN", "value": [10, None]}).alias("b"))
    assert values(df, "a") == [True, False, False]
    assert values(df, "b") == [True, False, True]


def test_comparison_without_value_is_refused():
    with pytest.raises(ValueError):
        D.condition({"field": "x", "op": "GT", "value": None})


def test_priority_is_stable(spark):
    rule = lambda i, p: {"ruleId": i, "priority": p, "conditions": {"field": "x", "op": "GT", "value": 0}, "actions": [{"type": i}]}
    spec = {"hitPolicy": "PRIORITY", "rules": [rule("low", 1), rule("first", 5), rule("second", 5)]}
    out = D.apply_rule_set(rows(spark), spec).select("id", F.get("hits", F.lit(0))["rule"].alias("r"))
    assert values(out, "r") == ["first", None, "first"]


def test_empty_rule_set(spark):
    assert values(D.apply_rule_set(rows(spark), {"hitPolicy": "ALL", "rules": []}), "hit") == [False] * 3


def test_score_on_edge_null_and_nan(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, float("nan"))], "id int, x double")
    spec = {"initialScore": 0, "cutoff": {"reject": 5, "review": 5, "pass": 7}, "characteristics": [{"name": "x", "field": "x", "bins": [{"range": [0, 10], "score": 1, "label": "a"}, {"range": [10, 20], "score": 7, "label": "b"}]}]}
    out = D.apply_scorecard(df, spec)
    assert values(out, "total") == [7.0, 0.0, 0.0, 0.0]
    assert values(out, "decision") == ["PASS", "REJECT", "REJECT", "REJECT"]


def test_table_wildcard_null_and_join_form(spark):
    spec = {"columns": [{"field": "w"}], "rows": [{"conditions": [None], "result": {"r": "null"}}, {"conditions": ["a"], "result": {"r": "a"}}, {"conditions": ["*"], "result": {"r": "any"}}]}
    for chain in (200, 0):
        assert values(D.apply_decision_table(rows(spark), spec, chain), "r") == ["a", "any", "null"]


def test_tree_without_child(spark):
    tree = {"condition": {"field": "w", "op": "IN", "value": ["a"]}, "trueChild": {"action": "yes"}}
    assert values(D.apply_decision_tree(rows(spark), tree), "action") == ["yes", None, None]


def test_cyclic_flow_is_refused(spark):
    flow = {"nodes": [{"id": "a", "type": "START"}, {"id": "b", "type": "START"}], "edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]}
    with pytest.raises(ValueError):
        D.apply_flow(rows(spark), flow)


def test_dead_end_is_manual(spark):
    flow = {"nodes": [{"id": "a", "type": "START"}, {"id": "b", "type": "ACTION", "action": "APPROVE"}], "edges": [{"from": "a", "to": "b", "condition": {"field": "x", "op": "GT", "value": 20}}]}
    out = D.apply_flow(rows(spark), flow)
    assert values(out, "flow_action") == ["MANUAL", "MANUAL", "APPROVE"]
    assert values(out, "path") == [["a"], ["a"], ["a", "b"]]


def test_expression_text(spark):
    assert to_sql('a == "x?y:z" ? 1 : (b != nil ? 2 : 3)').count("CASE") == 2
    df = rows(spark).select("id", truth('x > 20 || w == "a"').alias("t"))
    assert values(df, "t") == [True, False, True]


def test_split_is_repeatable_and_near_its_ratios(spark):
    spec = {"experimentId": "E", "groups": [{"groupId": "A", "trafficRatio": 0.7}, {"groupId": "B", "trafficRatio": 0.3}]}
    df = spark.range(4000)
    a = D.assign_group(df, "id", spec).where("grp = 'A'").count()
    assert a == D.assign_group(df.repartition(7), "id", spec).where("grp = 'A'").count()
    assert 0.66 < a / 4000 < 0.74


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "variable string, needs string")
    assert {tuple(r) for r in D.dependency_closure(edges).collect()} == {("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")}
