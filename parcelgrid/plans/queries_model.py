"""Bindings: the price-model steps on ``orders`` (+ ``lineitem`` features).

Target = ``o_totalprice``; features = per-order line aggregates and order
attributes.  Splits, folds and the grid are exact and checked against SQL; the
fitted models are checked by rows, or by whether they beat the mean.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelgrid.operators.indexing import positional_folds
from parcelgrid.operators.model import (FINAL_TREES, PARAM_GRID, PATIENCE, SEARCH_TREES, assemble, assign_splits,
                                        best_point, fit_with_early_stop, gbt, grid_search, load_model, log_target,
                                        model_input, param_grid_rows, regression_metrics, report_splits, save_model,
                                        search_scores)
from parcelgrid.plans.registry import query
from parcelgrid.session import ensure_checkpoint_dir, table

FEATURES = ["n_lines", "qty", "disc", "tax", "ext", "prio", "cust_mod", "status_f"]

SPLIT_SQL = """
s0 AS (SELECT *, CAST(('0x' || substr(md5('split:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT % 100 AS BIGINT)
                 AS bucket FROM orders),
s AS (SELECT *, ln(1 + o_totalprice) AS y_log,
             CASE WHEN bucket < 64 THEN 'train' WHEN bucket < 80 THEN 'val' ELSE 'test' END AS split,
             CASE WHEN bucket < 80 THEN CASE WHEN CAST(('0x' || substr(md5('refit:' || CAST(o_orderkey AS VARCHAR)),
                  1, 8))::UBIGINT % 100 AS BIGINT) < 80 THEN 'fit' ELSE 'stop' END END AS refit_part,
             CASE WHEN bucket < 80 THEN CAST(('0x' || substr(md5('fold:' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT
                  % 5 AS BIGINT) + 1 END AS fold
      FROM s0)"""


def _model_table(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("ext"))
    t = o.join(lines, "o_orderkey", "left").select(
        "o_orderkey", "o_totalprice", "n_lines", "qty", "disc", "tax", "ext",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), (F.col("o_custkey") % 100).alias("cust_mod"),
        (F.col("o_orderstatus") == "F").cast("int").alias("status_f"))
    return assign_splits(log_target(t, "o_totalprice"), "o_orderkey")


@query("q_log_target", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS y_log, round(exp(ln(1 + o_totalprice)) - 1, 4) AS price_back
FROM orders""")
def q_log_target(spark, sf_dir):
    """log1p target and its inverse."""
    t = log_target(table(spark, sf_dir, "orders"), "o_totalprice")
    return t.select("o_orderkey", F.round("y_log", 9).alias("y_log"), F.round(F.expm1("y_log"), 4).alias("price_back"))


@query("q_split", "WITH " + SPLIT_SQL + """
SELECT o_orderkey, bucket, split, refit_part, fold FROM s""")
def q_split(spark, sf_dir):
    """M1/M2/M6: 64/16/20 hash split, refit split and search folds."""
    return assign_splits(table(spark, sf_dir, "orders"), "o_orderkey") \
        .select("o_orderkey", "bucket", "split", "refit_part", "fold")


@query("q_folds", "SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) AS BIGINT) AS fold FROM documents")
def q_folds(spark, sf_dir):
    """Positional 5-fold (contiguous blocks in key order), computed
    without a single-partition window."""
    return positional_folds(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 5)


def _lit_list(values):
    return "[" + ", ".join(repr(v) for v in values) + "]"


@query("q_param_grid", "WITH " + SPLIT_SQL + """,
fc AS (SELECT fold, count(*) AS n_val FROM s WHERE fold IS NOT NULL GROUP BY fold),
tot AS (SELECT count(*) AS t FROM s WHERE fold IS NOT NULL)
SELECT fold, max_depth, min_child_weight, learning_rate, subsample, colsample_bytree, gamma, "lambda",
       t - n_val AS n_train, n_val
FROM fc, tot""" + "".join(
    f", (SELECT CAST(unnest({_lit_list(v)}) AS {'DOUBLE' if any(isinstance(x, float) for x in v) else 'BIGINT'}) "
    f"AS \"{k}\") AS g_{k}" for k, v in PARAM_GRID.items()))
def q_param_grid(spark, sf_dir):
    """The 2,916-point grid on each search fold, with fold sizes (14,580 fits)."""
    t = assign_splits(table(spark, sf_dir, "orders"), "o_orderkey").filter(F.col("fold").isNotNull())
    total = t.select(F.count(F.lit(1))).scalar()
    folds = t.groupBy("fold").agg(F.count(F.lit(1)).alias("n_val")).withColumn("n_train", total - F.col("n_val"))
    return param_grid_rows(folds).select("fold", *PARAM_GRID.keys(), "n_train", "n_val")


@query("q_metrics", "WITH " + SPLIT_SQL + """,
m AS (SELECT o_orderpriority, avg(y_log) AS pred_log FROM s WHERE split = 'train' GROUP BY o_orderpriority),
p AS (SELECT s.split, s.y_log, m.pred_log, exp(s.y_log) - 1 AS y, exp(m.pred_log) - 1 AS yhat
      FROM s JOIN m ON s.o_orderpriority = m.o_orderpriority)
SELECT split, count(*) AS n, round(avg(abs(yhat - y)), 4) AS mae, round(sqrt(avg((yhat - y) ^ 2)), 4) AS rmse,
       round(sqrt(avg((pred_log - y_log) ^ 2)), 6) AS rmsle,
       round(1 - sum((yhat - y) ^ 2) / (var_pop(y) * count(*)), 6) AS r2
FROM p GROUP BY split""")
def q_metrics(spark, sf_dir):
    """Metrics per split for a per-priority mean model in log space."""
    t = assign_splits(log_target(table(spark, sf_dir, "orders"), "o_totalprice"), "o_orderkey")
    model = t.filter(F.col("split") == "train").groupBy("o_orderpriority").agg(F.avg("y_log").alias("pred_log"))
    m = regression_metrics(t.join(model, "o_orderpriority"), by=["split"])
    return m.select("split", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                    F.round("rmsle", 6).alias("rmsle"), F.round("r2", 6).alias("r2"))


def _fitted(spark, sf_dir):
    """(assembled rows kept for fitting, the same rows as a plan)."""
    ensure_checkpoint_dir(spark)
    prep, data = assemble(_model_table(spark, sf_dir), FEATURES)
    rows = prep.transform(data).select("o_orderkey", "split", "refit_part", "fold", "y_log", "features")
    return model_input(rows), rows


@query("q_gbt")
def q_gbt(spark, sf_dir, trees: int = FINAL_TREES):
    """M3/M8: boosted trees on train + val, predictions back on the price scale."""
    kept, rows = _fitted(spark, sf_dir)
    model = gbt(max_iter=trees).fit(kept.filter(F.col("split") != "test"))
    kept.unpersist()
    return model.transform(rows).select("o_orderkey", "split", F.expm1("pred_log").alias("prediction"))


def search(spark, sf_dir, points: list[dict] | None = None, trees: int = SEARCH_TREES, folder: str | None = None):
    """M4/M5: k-fold search over ``points``, by default the whole grid: per distinct
    fit its mean training and validation RMSE (log target) and rank.  A job of its
    own: the whole grid is 972 x 5 fits of 500 trees (README, Measured); with
    ``folder`` it goes on where it was stopped."""
    kept, _ = _fitted(spark, sf_dir)
    scores = search_scores(grid_search(kept.filter(F.col("fold").isNotNull()), points, max_iter=trees, folder=folder))
    kept.unpersist()
    return scores


@query("q_early_stop")
def q_early_stop(spark, sf_dir, rounds: int = FINAL_TREES, patience: int = PATIENCE):
    """M7: per-round validation error, patience rule, the model of the best round;
    one row with the outcome."""
    kept, rows = _fitted(spark, sf_dir)
    fit, stop = (kept.filter(F.col("refit_part") == part) for part in ("fit", "stop"))
    model, best, stop_at = fit_with_early_stop(fit, stop, rounds=rounds, patience=patience, one_stage=False)
    m = regression_metrics(model.transform(stop)).first()
    kept.unpersist()
    return spark.createDataFrame([(best, stop_at, best + 1, float(m.rmsle))],
                                 "best_iteration long, stop_iteration long, n_trees long, rmsle double")


HOUSE_FEATURES = ["n_lines", "qty", "disc", "tax", "prio", "cust_mod", "status_f"]
# The points that q_model_report compares: the outer depths of the grid.  The whole grid is ``search``.
REPORT_POINTS = [{"max_depth": d, "learning_rate": 0.1, "min_child_weight": 1} for d in (3, 5)]
REPORT_SEARCH_TREES = 40


def _priced_houses(spark, sf_dir):
    """Orders with lines as houses: the price is the sum of the lines' prices, the
    features are their number and other totals."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"), F.sum("l_extendedprice").alias("price"))
    houses = o.join(lines, "o_orderkey").select(
        "o_orderkey", "price", "n_lines", "qty", "disc", "tax",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), (F.col("o_custkey") % 100).alias("cust_mod"),
        (F.col("o_orderstatus") == "F").cast("int").alias("status_f"))
    return assign_splits(log_target(houses, "price"), "o_orderkey")


@query("q_model_report", "WITH " + SPLIT_SQL + """,
h AS (SELECT s.split, ln(1 + sum(l_extendedprice)) AS y FROM s JOIN lineitem ON l_orderkey = o_orderkey
      GROUP BY s.o_orderkey, s.split),
m AS (SELECT avg(y) AS mean FROM h WHERE split = 'train')
SELECT split, count(*) AS n, round(sqrt(avg((y - mean) ^ 2)), 6) AS mean_rmsle, TRUE AS beats_mean FROM h, m GROUP BY split""")
def q_model_report(spark, sf_dir, points: list[dict] | None = None, search_trees: int = REPORT_SEARCH_TREES,
                   rounds: int = FINAL_TREES, patience: int = PATIENCE, folder: str | None = None):
    """M4/M5 -> M7 -> M9 as three jobs: the search stores its folds, its best point is
    refitted with early stopping and saved, and the loaded pipeline is scored on the
    raw rows of each split beside the mean predictor."""
    points = REPORT_POINTS if points is None else points
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/price-model-{uuid.uuid4().hex}"
    houses = _priced_houses(spark, sf_dir)
    stages, data = assemble(houses, HOUSE_FEATURES)
    kept = model_input(stages.transform(data).select("refit_part", "fold", "y_log", "features"))
    found = grid_search(kept.filter(F.col("fold").isNotNull()), points, search_trees, folder=f"{folder}/search")
    best = best_point(found, points)
    fit, stop = (kept.filter(F.col("refit_part") == part) for part in ("fit", "stop"))
    # runs of an eighth, a quarter, half and all of the rounds at most: patience seldom ends a first run of 64
    model, _, _ = fit_with_early_stop(fit, stop, best, rounds, patience, first=-(-rounds // 8))
    kept.unpersist()
    save_model(stages, model, f"{folder}/model")
    return report_splits(load_model(f"{folder}/model"), houses).select(
        "split", "n", F.round("mean_rmsle", 6).alias("mean_rmsle"), "beats_mean")
