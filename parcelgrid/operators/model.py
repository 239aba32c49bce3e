"""Price model on MLlib: target transform, splits, folds, grid, boosted trees,
early stopping and metrics (U17, U18, G4, M1-M9, A13, W4).

The reference tuned an in-process boosted-tree library; here the same steps
run as Spark jobs: deterministic hash splits instead of a shuffled index,
``GBTRegressor`` (grown in one stage, see ``boosting``) for the trees, a search whose folds are stored as they end, and
one aggregate for the metrics.  Search, refit and scoring are separate jobs: the
search leaves a table, the refit a saved pipeline, and scoring loads it.  Parameter names map as
max_depth -> maxDepth, learning_rate -> stepSize, subsample -> subsamplingRate,
min_child_weight -> minInstancesPerNode, colsample_bytree ->
featureSubsetStrategy (per node in MLlib), gamma -> minInfoGain; ``lambda`` has
no MLlib counterpart (kept in the grid table, not applied).
"""

from __future__ import annotations

import time
from itertools import product

from pyspark import SparkContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The search grid, split shares and seeds of the reference model.
PARAM_GRID = {
    "max_depth": [3, 4, 5, 6],
    "min_child_weight": [1, 5, 10],
    "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.7, 0.8, 0.9],
    "gamma": [0, 0.1, 0.5],
    "lambda": [1, 5, 10],
}
TEST_SHARE, VAL_SHARE = 20, 16   # percent: 64 / 16 / 20
N_FOLDS = 5
SEARCH_TREES = 500
FINAL_TREES, PATIENCE = 1000, 50
SEED = 42
# Rows of a task of the model input: at most; for a task a core; for the first few tasks.
ROWS_PER_PARTITION, ROWS_PER_CORE, ROWS_WORTH_A_TASK = 1_000_000, 200_000, 10_000
FEW_TASKS = 3


def log_target(df: DataFrame, target: str, out: str = "y_log") -> DataFrame:
    return df.withColumn(out, F.log1p(F.col(target)))


def features_and_target(df: DataFrame, target: str, exclude=()) -> DataFrame:
    """Drop the target and the excluded (text) columns: the feature table."""
    return df.drop(target, *exclude)


def hash_bucket(key, salt: str, buckets: int = 100):
    """Deterministic bucket in [0, buckets): first 32 bits of md5(salt + key).

    Independent salts give independent splits; an arithmetic bucket such as
    ``key * c % 100`` would correlate with ``key % 5`` folds.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt), k.cast("string"))), 1, 8), 16, 10).cast("long")
    return h % buckets


def assign_splits(df: DataFrame, key: str) -> DataFrame:
    """``bucket``, ``split`` (train 64 / val 16 / test 20), ``refit_part``
    (fit 80 / stop 20 inside train + val, for the early-stopped refit) and
    ``fold`` (1..5 inside train + val, for the search)."""
    b = hash_bucket(key, "split:")
    out = df.withColumn("bucket", b)
    split = (F.when(F.col("bucket") < 100 - TEST_SHARE - VAL_SHARE, "train")
              .when(F.col("bucket") < 100 - TEST_SHARE, "val").otherwise("test"))
    in_train = F.col("bucket") < 100 - TEST_SHARE
    return (out.withColumn("split", split)
            .withColumn("refit_part", F.when(in_train, F.when(hash_bucket(key, "refit:") < 80, "fit")
                                             .otherwise("stop")))
            .withColumn("fold", F.when(in_train, hash_bucket(key, "fold:", N_FOLDS) + 1)))


def param_grid_rows(df: DataFrame, grid: dict = PARAM_GRID) -> DataFrame:
    """Every grid combination on every input row (``explode`` per axis: a
    fixed fan-out per row, no join)."""
    out = df
    for name, values in grid.items():
        lit_type = "double" if any(isinstance(v, float) for v in values) else "long"
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(lit_type) for v in values])))
    return out


def regression_metrics(pred: DataFrame, y_log: str = "y_log", p_log: str = "pred_log", by=()) -> DataFrame:
    """MAE, RMSE and R2 on the price scale (``expm1``), RMSLE on the log scale."""
    y, p = F.expm1(F.col(y_log)), F.expm1(F.col(p_log))
    agg = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.sqrt(F.avg(F.pow(p - y, 2))).alias("rmse"),
        F.sqrt(F.avg(F.pow(F.col(p_log) - F.col(y_log), 2))).alias("rmsle"),
        F.sum(F.pow(p - y, 2)).alias("_ssr"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    return agg.withColumn("r2", 1 - F.try_divide(F.col("_ssr"), F.col("_sst"))).drop("_ssr", "_sst")


def early_stop_index(errors, patience: int = PATIENCE):
    """``(best_index, stop_index)``: the best validation error so far, and the
    round at which ``patience`` rounds passed without improvement."""
    best, best_i = float("inf"), -1
    for i, e in enumerate(errors):
        if e < best:
            best, best_i = e, i
        elif i - best_i >= patience:
            return best_i, i
    return best_i, len(errors) - 1


def feature_stages(feature_cols, out: str = "features") -> list:
    """Pipeline stages from raw columns to a vector: cast to double, impute medians (MLlib vectors reject NaN), assemble."""
    from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler

    doubles, filled = [f"{c}__d" for c in feature_cols], [f"{c}__f" for c in feature_cols]
    casts = ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{d}`" for c, d in zip(feature_cols, doubles))
    return [SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"),
            Imputer(inputCols=doubles, outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol=out)]


def assemble(df: DataFrame, feature_cols, out: str = "features"):
    """(fitted feature stages, the table to transform with them)."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=feature_stages(feature_cols, out)).fit(df), df


def model_input(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Keep the assembled rows (memory, then disk) in partitions sized by rows:
    a tree is a job of two stages per level, so a task that counts its rows faster
    than it is started only costs time, and a large input must spill piece by piece.
    A few tasks from ``ROWS_WORTH_A_TASK`` rows each, a task a core from
    ``ROWS_PER_CORE``, and more tasks than cores past ``ROWS_PER_PARTITION``, a whole
    number for each core: a level of a tree ends with its last task."""
    from pyspark import StorageLevel

    if partitions is None:
        n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
        partitions = max(-(-n // ROWS_PER_PARTITION), min(cores, -(-n // ROWS_PER_CORE)),
                         min(cores, FEW_TASKS, -(-n // ROWS_WORTH_A_TASK)), 1)
        if partitions > cores:
            partitions = cores * -(-partitions // cores)
    return df.repartition(partitions).persist(StorageLevel.MEMORY_AND_DISK)


def gbt(label: str = "y_log", max_iter: int = FINAL_TREES, max_depth: int = 4, step: float = 0.1, subsample: float = 1.0,
        min_instances: int = 1, one_stage: bool = True):
    """Boosted trees, grown in one stage or (``one_stage`` false) by MLlib's jobs; the two may take other splits where
    several are as good."""
    from pyspark.ml.regression import GBTRegressor

    from parcelgrid.operators.boosting import BoostedTrees

    return (BoostedTrees if one_stage else GBTRegressor)(
        featuresCol="features", labelCol=label, predictionCol="pred_log", lossType="squared", maxIter=max_iter,
        maxDepth=max_depth, stepSize=step, subsamplingRate=subsample, minInstancesPerNode=min_instances, seed=SEED,
        checkpointInterval=10)


def grid_points(grid: dict = PARAM_GRID) -> list[dict]:
    """Every combination of the grid's values."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def params_of(point: dict) -> tuple:
    """What MLlib fits at a grid point; ``lambda`` has no counterpart, so points that differ only in it are one fit."""
    share = float(point.get("colsample_bytree", 1.0))
    return (int(point.get("max_depth", 4)), float(point.get("learning_rate", 0.1)), float(point.get("subsample", 1.0)),
            int(point.get("min_child_weight", 1)), float(point.get("gamma", 0.0)), "all" if share >= 1 else str(share))


def gbt_at(point: dict, max_iter: int, one_stage: bool = True):
    """The boosted trees of a grid point."""
    depth, step, subsample, instances, gain, subset = params_of(point)
    return (gbt(max_iter=max_iter, max_depth=depth, step=step, subsample=subsample, min_instances=instances, one_stage=one_stage)
            .setMinInfoGain(gain).setFeatureSubsetStrategy(subset))


SEARCH_SCHEMA = ("fit string, trees int, fold int, n_train long, n_val long, train_rmse double, val_rmse double, "
                 "seconds double")


def grid_search(train: DataFrame, points=None, max_iter: int = SEARCH_TREES, parallelism: int = N_FOLDS,
                folder: str | None = None) -> DataFrame:
    """k-fold search over ``points`` (list of dicts in the PARAM_GRID vocabulary;
    default: the whole grid) with the ``fold`` column: one row per fit and fold with
    the RMSE on the log target (= RMSLE) of its training and validation rows and
    the seconds it took (``SEARCH_SCHEMA``; ``fit`` is the text of ``params_of``).

    With ``folder`` every finished fold is appended there, and what is stored is not
    fitted again: a search that was stopped, or lost its driver, goes on where it was.
    ``parallelism`` fits run side by side, since one waits for the start of its jobs
    most of the time; each keeps its own rows, which go to disk where memory ends.
    Points that differ only in ``lambda`` are one fit.
    """
    from multiprocessing.pool import ThreadPool
    from threading import Lock

    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.util import inheritable_thread_target

    from parcelgrid.sources.ledgers import read_ledger

    spark = train.sparkSession
    wanted = {str(params_of(p)): p for p in (grid_points() if points is None else points)}
    stored = read_ledger(spark, folder, SEARCH_SCHEMA).where(F.col("trees") == max_iter) if folder else \
        spark.createDataFrame([], SEARCH_SCHEMA)
    done = {(r["fit"], r["fold"]) for r in stored.select("fit", "fold").collect()}  # a row per fit of the search
    rmse = RegressionEvaluator(labelCol="y_log", predictionCol="pred_log", metricName="rmse")
    sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}  # N_FOLDS rows
    total, one_writer = sum(sizes.values()), Lock()

    @inheritable_thread_target(spark)
    def one(job):
        name, fold = job
        began = time.monotonic()
        fit_rows, val_rows = train.filter(F.col("fold") != fold), train.filter(F.col("fold") == fold)
        model = gbt_at(wanted[name], max_iter).fit(fit_rows)
        row = (name, max_iter, fold, total - sizes[fold], sizes[fold], rmse.evaluate(model.transform(fit_rows)),
               rmse.evaluate(model.transform(val_rows)), time.monotonic() - began)
        if folder:
            with one_writer:  # two writes at once would share, and one would clear, the folder's staging area
                spark.createDataFrame([row], SEARCH_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        return row

    jobs = [(name, fold) for name in wanted for fold in sorted(sizes) if (name, fold) not in done]
    with ThreadPool(max(1, parallelism)) as pool:
        rows = pool.map(one, jobs, chunksize=1)
    if folder:
        return read_ledger(spark, folder, SEARCH_SCHEMA).where((F.col("trees") == max_iter) & F.col("fit").isin(list(wanted)))
    return spark.createDataFrame(rows, SEARCH_SCHEMA)


def search_scores(results: DataFrame) -> DataFrame:
    """Per fit: mean training and validation RMSE over its folds, and its rank (1: best, ties by the fit's text)."""
    mean = results.groupBy("fit").agg(F.count("*").alias("folds"), F.avg("train_rmse").alias("train_rmse"),
                                      F.avg("val_rmse").alias("val_rmse"), F.sum("seconds").alias("seconds"))
    order = Window.orderBy("val_rmse", "fit")  # a row per fit: as many as the grid has points at most
    return mean.withColumn("rank", F.row_number().over(order).cast("long"))


def best_point(results: DataFrame, points=None) -> dict:
    """The first of ``points`` (default: the whole grid) whose fit has the smallest mean validation RMSE."""
    best = search_scores(results).where("rank = 1").first()["fit"]
    return next(p for p in (grid_points() if points is None else points) if str(params_of(p)) == best)


def first_trees(model, n: int):
    """The model of the first ``n`` rounds of a fitted one: boosting adds trees and changes no earlier one."""
    from pyspark.ml.regression import GBTRegressionModel

    fitted = model._java_obj
    gateway = SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    all_trees, all_weights = fitted.trees(), fitted.treeWeights()
    for k in range(n):
        trees[k], weights[k] = all_trees[k], all_weights[k]
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(fitted.uid(), trees, weights, model.numFeatures)
    return GBTRegressionModel(cut).setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def next_rounds(errors, rounds: int, patience: int = PATIENCE) -> int:
    """Rounds of the run that follows one with these validation errors and without a stop: twice as many, or all
    ``rounds`` if the last ``patience`` of them brought more than half of what the ``patience`` before brought.
    Such a fall is no end of learning, and runs in between would only be fitted again."""
    n = len(errors)
    if n > 2 * patience:
        before = errors[n - 1 - 2 * patience] - errors[n - 1 - patience]
        if errors[n - 1 - patience] - errors[n - 1] > before / 2 > 0:
            return rounds
    return min(2 * n, rounds)


def fit_with_early_stop(fit_rows: DataFrame, stop_rows: DataFrame, point: dict | None = None, rounds: int = FINAL_TREES,
                        patience: int = PATIENCE, first: int = 64, one_stage: bool = True):
    """``(model, best_index, stop_index)`` of boosting until ``patience`` rounds brought no better validation error.

    MLlib cannot stop by patience while it fits, so rounds are fitted in growing
    runs (``first``, then ``next_rounds``) until the rule stops inside one.  A longer run begins with the trees of the shorter one, so the
    outcome is that of one run of ``rounds``; the model is cut to its best round.
    """
    n = min(first, rounds)
    while True:
        model = (gbt_at(point or {}, n) if one_stage else gbt_at(point or {}, n, False)).fit(fit_rows)
        errors = [e ** 0.5 for e in model.evaluateEachIteration(stop_rows, "squared")]
        best, stop = early_stop_index(errors, patience)
        if n == rounds or stop - best >= patience:
            return first_trees(model, best + 1), best, stop
        n = next_rounds(errors, rounds, patience)


def save_model(stages, model, folder: str) -> None:
    """One loadable artefact: the fitted feature stages and the trees."""
    from pyspark.ml import PipelineModel

    PipelineModel(stages=[*stages.stages, model]).write().overwrite().save(folder)


def load_model(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(folder)


def report_splits(model, rows: DataFrame, split: str = "split", mean_of: str = "train") -> DataFrame:
    """Metrics of a loaded model per split of a raw table with ``y_log``, beside those
    of the mean log price of the ``mean_of`` rows: ``split, n, mae, rmse, rmsle, r2,
    mean_rmsle, beats_mean``."""
    scored = model.transform(rows).select(split, "y_log", "pred_log")
    ours = regression_metrics(scored, by=[split])
    mean = rows.filter(F.col(split) == mean_of).select(F.avg("y_log")).scalar()
    base = (rows.select(split, "y_log").withColumn("gap", F.pow(F.col("y_log") - mean, 2))
            .groupBy(split).agg(F.sqrt(F.avg("gap")).alias("mean_rmsle")))
    return ours.join(base, split).withColumn("beats_mean", F.col("rmsle") < F.col("mean_rmsle"))
