"""Boosted trees of one stage: MLlib's trees, whatever the number of tasks, in few jobs."""

import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor

from parcelgrid.operators import boosting
from parcelgrid.operators.model import gbt, gbt_at


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    x[:, 2] = rng.integers(0, 3, 3000)
    x[:, 3] = 1.0  # no candidate
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] - 1) + rng.normal(size=3000) * 0.1 + 5
    table = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y_log double")
    kept = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(table).repartition(3).persist()
    yield kept
    kept.unpersist()


def _scores(model, rows):
    return np.array([r.pred_log for r in model.transform(rows).orderBy("id").collect()])


def _mllib(est):
    return GBTRegressor(**{p.name: est.getOrDefault(p) for p in est.params if est.isDefined(p)})


@pytest.mark.parametrize("depth, least", [(3, 30), (1, 1), (0, 1)])
def test_trees_are_those_of_mllib(spark, rows, scratch, depth, least):
    est = gbt(max_iter=12, max_depth=depth, step=0.3, min_instances=least)
    ours, theirs = est.fit(rows), _mllib(est).fit(rows)
    assert est.plan_of(rows).tasks == 1 and ours.treeWeights == theirs.treeWeights
    assert np.abs(_scores(ours, rows) - _scores(theirs, rows)).max() < 1e-9
    assert ours.numFeatures == theirs.numFeatures == 4
    assert np.abs(ours.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 1e-6
    ours.write().overwrite().save(f"{scratch}/model")
    assert (_scores(GBTRegressionModel.load(f"{scratch}/model"), rows) == _scores(ours, rows)).all()


def test_trees_do_not_depend_on_tasks_blocks_or_memory(spark, rows, monkeypatch):
    est = gbt(max_iter=6, max_depth=4, step=0.3)
    one = _scores(est.fit(rows), rows)
    monkeypatch.setattr(boosting, "TASK_ROWS", 1200)
    monkeypatch.setattr(boosting, "HELD_BYTES", 10_000)
    plan = est.plan_of(rows)
    assert plan.tasks == 2
    assert (_scores(est.fit(rows.repartition(5)), rows) == one).all()
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [f for f in os.listdir(shared) if f.startswith("boosting-")]


def test_a_fit_is_few_jobs(spark, rows):
    """MLlib starts a job for every level of every tree, whose fixed cost was nearly all of q_gbt."""
    context = spark.sparkContext
    context.setJobGroup("boosting", "boosting")
    try:
        assert gbt(max_iter=30, max_depth=4).fit(rows).getNumTrees == 30
        jobs = context.statusTracker().getJobIdsForGroup("boosting")
    finally:
        context._jsc.clearJobGroup()
    assert 0 < len(jobs) < 20


def test_no_signal_and_what_mllib_still_fits(spark, rows):
    flat = rows.selectExpr("id", "features", "2.5D AS y_log")
    model = gbt(max_iter=3).fit(flat)
    assert set(_scores(model, flat)) == {2.5} and model.totalNumNodes == 3
    assert gbt_at({"max_depth": 3}, 5).plan_of(rows) and gbt_at({"subsample": 0.7}, 5).plan_of(rows) is None
    assert gbt_at({"colsample_bytree": 0.7}, 5).plan_of(rows) is None
    assert gbt_at({"subsample": 0.7}, 5).fit(rows).getNumTrees == 5
    with pytest.raises(Exception):  # as in MLlib
        gbt(max_iter=3).fit(rows.limit(0))
