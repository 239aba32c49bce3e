"""Model steps: boosted trees learn a synthetic signal; splits and folds."""

import inspect
import os

from conftest import SF_SMALL
from pyspark.sql import functions as F

from parcelgrid.operators.model import (assemble, assign_splits, best_point, early_stop_index, first_trees,
                                        fit_with_early_stop, gbt, gbt_at, grid_points, load_model, model_input,
                                        next_rounds, params_of, regression_metrics, report_splits, save_model)
from parcelgrid.plans import QUERIES
from parcelgrid.plans.queries_model import search


def test_gbt_beats_mean_predictor(spark):
    df = (spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("x"),
                                   (F.col("id") % 13).cast("double").alias("z"))
          .withColumn("y_log", F.log1p(F.col("x") * 3 + F.col("z") + 10)))
    df = df.withColumn("x", F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("x")))  # missing values
    df = assign_splits(df, "id")
    prep, casted = assemble(df, ["x", "z"])
    rows = model_input(prep.transform(casted).select("id", "split", "y_log", "features"), 4)
    model = gbt(max_iter=15, max_depth=4).fit(rows.filter(F.col("split") != "test"))
    test = model.transform(rows.filter(F.col("split") == "test"))
    ours = regression_metrics(test).first()
    mean = rows.filter(F.col("split") != "test").agg(F.avg("y_log")).first()[0]
    base = regression_metrics(test.withColumn("pred_log", F.lit(mean))).first()
    assert ours.rmsle < 0.5 * base.rmsle and ours.r2 > 0.8
    rows.unpersist()


def test_split_shares_near_64_16_20(spark):
    s = assign_splits(spark.range(20000), "id")
    share = {r.split: r["count"] / 20000 for r in s.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.64) < 0.02 and abs(share["val"] - 0.16) < 0.02 and abs(share["test"] - 0.20) < 0.02
    folds = {r.fold: r["count"] for r in s.filter("fold is not null").groupBy("fold").count().collect()}
    assert sorted(folds) == [1, 2, 3, 4, 5] and max(folds.values()) / min(folds.values()) < 1.15


def test_model_queries_default_to_the_whole_job(spark):
    default = {q: {k: p.default for k, p in inspect.signature(f).parameters.items()}
               for q, f in (("gbt", QUERIES["q_gbt"]), ("stop", QUERIES["q_early_stop"]), ("search", search))}
    assert default["gbt"]["trees"] == 1000 and default["search"]["trees"] == 500
    assert (default["stop"]["rounds"], default["stop"]["patience"]) == (1000, 50)
    assert default["search"]["points"] is None and len(grid_points()) == 2916
    assert len({params_of(p) for p in grid_points()}) == 972


def test_search_scores_every_fit_and_goes_on_where_it_was(spark, scratch):
    some = [p for p in grid_points() if p["max_depth"] == 3 and p["min_child_weight"] == 1 and p["gamma"] == 0
            and p["learning_rate"] == 0.1 and p["subsample"] == 0.9 and p["colsample_bytree"] in (0.7, 0.9)]
    folder = f"{scratch}/search"
    first = search(spark, SF_SMALL, some[:3], trees=2, folder=folder).collect()  # three points, one fit
    assert len(some) == 6 and len(first) == 1 and first[0].folds == 5
    files = set(os.listdir(folder))
    both = search(spark, SF_SMALL, some, trees=2, folder=folder).collect()
    assert files < set(os.listdir(folder)) and sorted((r["rank"], r.folds) for r in both) == [(1, 5), (2, 5)]
    assert all(r.train_rmse <= r.val_rmse for r in both)
    assert {r.fit: r.val_rmse for r in both}[first[0].fit] == first[0].val_rmse
    stored = spark.read.parquet(folder)
    assert stored.count() == 10  # nothing was fitted twice
    want = str(params_of(best_point(stored, some)))
    assert want == min(both, key=lambda r: (r.val_rmse, r.fit)).fit


def _signal(spark):
    df = (spark.range(3000).select("id", (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 13).alias("z"))
          .withColumn("y_log", F.log1p(F.col("x") * 3 + F.col("z") + 10)))
    return assign_splits(df, "id")


def test_early_stop_in_growing_runs_is_one_long_run(spark):
    rows = _signal(spark)
    prep, data = assemble(rows, ["x", "z"])
    kept = model_input(prep.transform(data).select("refit_part", "y_log", "features"), 2)
    fit, stop = (kept.filter(F.col("refit_part") == part) for part in ("fit", "stop"))
    point = {"max_depth": 3, "learning_rate": 0.5, "subsample": 0.7, "colsample_bytree": 0.7}
    model, best, stop_at = fit_with_early_stop(fit, stop, point, rounds=24, patience=3, first=3)
    whole = gbt_at(point, 24).fit(fit)
    errors = [e ** 0.5 for e in whole.evaluateEachIteration(stop, "squared")]
    assert (best, stop_at) == early_stop_index(errors, 3) and model.getNumTrees == best + 1
    again = gbt_at(point, best + 1).fit(fit)
    for part in (fit, stop):
        ours, theirs = (sorted(r.pred_log for r in m.transform(part).collect()) for m in (model, again))
        assert ours == theirs
    kept.unpersist()


def test_saved_model_scores_raw_rows_like_the_fitted_one(spark, scratch):
    rows = _signal(spark)
    prep, data = assemble(rows, ["x", "z"])
    fitted = prep.transform(data)
    model = first_trees(gbt(max_iter=6).fit(fitted.filter("split = 'train'")), 4)
    save_model(prep, model, f"{scratch}/m")
    holes = rows.withColumn("x", F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("x")))
    loaded = load_model(f"{scratch}/m").transform(holes).select("id", "pred_log")
    ours = model.transform(prep.transform(holes)).select("id", "pred_log")
    assert sorted(loaded.collect()) == sorted(ours.collect())
    report = {r.split: r for r in report_splits(load_model(f"{scratch}/m"), holes).collect()}
    assert set(report) == {"train", "val", "test"} and all(r.beats_mean for r in report.values())
    assert sum(r.n for r in report.values()) == 3000


def test_model_input_is_partitioned_by_rows(spark):
    kept = model_input(spark.range(0, 25_000, 1, 16))
    assert kept.rdd.getNumPartitions() == 3 and kept.count() == 25_000
    kept.unpersist()
    none = model_input(spark.range(0))
    assert none.count() == 0
    none.unpersist()


def test_model_input_has_few_tasks_until_they_have_work(spark):
    """A tree is two stages per level: tasks of a few rows cost more to start than they count."""
    cores = spark.sparkContext.defaultParallelism
    for n, want in ((150_000, 3), (900_000, min(cores, 5))):
        kept = model_input(spark.range(0, n, 1, 16))
        assert kept.rdd.getNumPartitions() == want and kept.count() == n
        kept.unpersist()


def test_model_input_gives_every_core_as_many_tasks(spark, monkeypatch):
    """One task more than cores would double the time of every level of every tree."""
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr("parcelgrid.operators.model.ROWS_PER_PARTITION", 1000)
    kept = model_input(spark.range(0, cores * 1000 + 1, 1, 16))
    assert kept.rdd.getNumPartitions() == 2 * cores and kept.count() == cores * 1000 + 1
    kept.unpersist()


def test_next_rounds_goes_to_the_end_when_errors_fall_steadily():
    steady, flat = [1 - 0.001 * k for k in range(125)], [0.3 + 0.9 ** k for k in range(125)]
    assert next_rounds(steady, 1000, 50) == 1000
    assert next_rounds(flat, 1000, 50) == 250 and next_rounds(flat + flat[-1:] * 500, 1000, 50) == 1000
    assert next_rounds(steady[:64], 1000, 50) == 128  # too few rounds to tell


def test_early_stop_goes_to_all_rounds_at_once_and_changes_nothing(spark, monkeypatch):
    rows = _signal(spark)
    prep, data = assemble(rows, ["x", "z"])
    kept = model_input(prep.transform(data).select("refit_part", "y_log", "features"), 2)
    fit, stop = (kept.filter(F.col("refit_part") == part) for part in ("fit", "stop"))
    runs, point = [], {"max_depth": 3, "learning_rate": 0.01}
    monkeypatch.setattr("parcelgrid.operators.model.gbt_at", lambda p, n: runs.append(n) or gbt_at(p, n))
    model, best, stop_at = fit_with_early_stop(fit, stop, point, rounds=24, patience=2, first=5)
    errors = [e ** 0.5 for e in gbt_at(point, 24).fit(fit).evaluateEachIteration(stop, "squared")]
    assert runs == [5, 24] and (best, stop_at) == early_stop_index(errors, 2) and model.getNumTrees == best + 1
    kept.unpersist()
