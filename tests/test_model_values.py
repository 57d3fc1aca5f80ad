"""Model operators that SQL cannot express, against numpy; backtests with failing samples."""

import numpy as np
import pytest

from riskloom.operators import decision as D
from riskloom.operators import models as M
from riskloom.plans.registry import load

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=300), rng.normal(size=300)
    c = a + 0.1 * rng.normal(size=300)
    y = (a + 0.5 * b + rng.normal(size=300) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(t)) for i, (*v, t) in enumerate(zip(a, b, c, y))], "id long, a double, b double, c double, y int")


def test_vif(rows):
    x = np.array([(r.a, r.b, r.c) for r in rows.collect()])
    gram = x.T @ x
    want = np.diag(gram) * np.diag(np.linalg.inv(gram))
    got = M.vif(rows, ["a", "b", "c"])
    assert [f for f, _ in got] == ["a", "b", "c"] and np.allclose([v for _, v in got], want)
    assert want[0] > 20 > want[1]


def test_logistic_scores_and_importance(spark, rows):
    model, auc = M.train_lr(rows, ["a", "b"], "y", {"regParam": [0.01, 0.1]}, 2)
    assert 0.7 < auc <= 1
    scored = M.batch_score(rows, model, ["a", "b"]).collect()
    held = {r.id: r for r in rows.collect()}
    for r in scored[:50]:
        p = 1 / (1 + np.exp(-(model.intercept + np.dot(model.coefficients.toArray(), [held[r.id].a, held[r.id].b]))))
        assert r.probability == pytest.approx(p) and r.label == int(p >= 0.5) and r.score == pytest.approx(1000 * p, abs=1)
    weights = M.feature_importance(spark, model, ["a", "b"]).collect()
    sizes = np.abs(model.coefficients.toArray())
    assert {r.feature for r in weights} == {"a", "b"} and max(weights, key=lambda r: r[1]).feature == ("a", "b")[int(sizes.argmax())]


def test_boosted_trees_learn(rows):
    model, auc = M.train_gbt(rows, ["a", "b"], "y", {"maxDepth": [2]}, 2)
    assert auc > 0.7 and model.getNumTrees > 0


def test_selection_keeps_one_of_two_close_features(rows):
    kept = M.select_features(rows, ["a", "b", "c"], "y", rows.where("id % 2 = 0"))
    assert len({"a", "c"} & set(kept)) == 1


def test_failed_samples_keep_their_key(spark):
    def one(record):
        if record["x"] < 0:
            raise ValueError("refused")
        return {"id": record["id"], "decision": "PASS"}

    out = D.backtest_fn(spark.createDataFrame([(2**60 + 1, 1.0), (2**60 + 3, -1.0)], "id long, x double"), one, "id bigint, decision string", "id").collect()
    assert {tuple(r) for r in out} == {(2**60 + 1, "PASS", None), (2**60 + 3, None, "ValueError: refused")}


@pytest.mark.parametrize("name", ["m05_correlation_filter", "m16_vif", "m26_feature_importance", "m27_batch_score", "m29_select_features"])
def test_queries_of_all_features_have_rows(spark, name):
    assert load()[name][0](spark, DATA).count() > 0
