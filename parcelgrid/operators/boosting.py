"""Boosted regression trees grown in one Spark stage instead of four jobs a tree.

``BoostedTrees`` is MLlib's ``GBTRegressor`` with another way to fit: the split candidates,
the growing rules and the fitted model are MLlib's, the rounds run inside one stage.

1. MLlib finds the split candidates of each feature, so the trees choose among the same ones.
2. Rows become blocks of bin numbers (features packed in groups of up to ``GROUP`` joint bins).
3. Each task of one barrier stage holds its share of the blocks and grows all trees: per level
   it counts rows and sums residuals by node and bin, and the tasks add their tables, which
   they exchange as small files of the checkpoint folder (``allGather`` sleeps for a second a
   call).  Few rows are one task, which needs neither.

Residuals are summed as whole numbers (``2 ** 52`` over rows and largest residual), so sums
are exact and the trees do not depend on the number of tasks or the order of the rows.
A task holds about 35 bytes a row; past ``HELD_BYTES`` its blocks lie in unnamed files of its
temp folder.

What this does not cover is fitted by MLlib as before: row or feature subsampling, other
losses, weights, validation columns, categorical features, more bins than ``GROUP``, trees
deeper than ``DEEPEST``, and more than one task's rows under dynamic allocation (it has no
barrier stages) or with a checkpoint folder that ``pyarrow.fs`` cannot open.
"""

from __future__ import annotations

import sys
import tempfile
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy

GROUP = 1024
DEEPEST = 8
BLOCK_ROWS = 1 << 16
# Rows of a task: at least, while there are MOST_TASKS or fewer (every task gets every task's table); and at most, if there are cores.
TASK_ROWS, MOST_TASKS, FULL_TASK_ROWS = 100_000, 32, 4_000_000
HELD_BYTES = 1 << 28


@dataclass
class Plan:
    """What a task needs to know: candidates by feature, rules, rows in all, tasks."""
    thresholds: list[np.ndarray]
    rounds: int
    depth: int
    step: float
    least: int
    gain: float
    rows: int
    tasks: int
    folder: str = ""
    groups: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        self.bins = [len(t) + 1 for t in self.thresholds]
        self.groups = packed(self.bins)


def packed(bins: list[int]) -> list[list[int]]:
    """Features by group: the product of a group's bins is at most ``GROUP`` (or it is one feature)."""
    groups: list[list[int]] = []
    for f in sorted(range(len(bins)), key=lambda f: -bins[f]):
        at = next((g for g in groups if bins[f] * np.prod([bins[x] for x in g]) <= GROUP), None)
        if at is None:
            groups.append([f])
        else:
            at.append(f)
    return groups


def blocks_of(batches, plan: Plan, most: int):
    """Blocks of rows: per group the joint bin numbers (16 bits), and the labels."""
    joint, labels, held = [], [], 0

    def block():
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(joint, axis=1).tobytes()], pa.large_binary()),
                                           pa.array([np.concatenate(labels).tobytes()], pa.large_binary())], ["joint", "labels"])
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            y = part.column(0).to_numpy(zero_copy_only=False)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(plan.bins))
            codes = np.zeros((len(plan.groups), len(y)), np.int16)
            for g, features in enumerate(plan.groups):
                for f in features:  # a value goes left of a candidate that is not smaller
                    codes[g] = codes[g] * plan.bins[f] + np.searchsorted(plan.thresholds[f], x[:, f], side="left")
            joint.append(codes)
            labels.append(y)
            held += len(y)
            if held >= most:
                yield block()
                joint, labels, held = [], [], 0
    if held:
        yield block()


class Chunk:
    """Rows of a block with what a tree changes of them."""

    def __init__(self, joint, labels, groups: int, room):
        self.y = room(np.frombuffer(labels))
        self.joint = room(np.frombuffer(joint, np.int16).reshape(groups, -1))
        self.score = room(np.zeros(len(self.y)))
        self.left = room(np.array(self.y))  # the label of the next tree
        self.units = room(np.zeros(len(self.y)))
        self.node = room(np.zeros(len(self.y), np.int16))


def _room():
    """Keeps an array: in memory, and in an unnamed file once a task holds ``HELD_BYTES``."""
    held = 0

    def room(array: np.ndarray) -> np.ndarray:
        nonlocal held
        held += array.nbytes
        if held <= HELD_BYTES or not array.nbytes:
            return array
        with tempfile.TemporaryFile() as file:
            kept = np.memmap(file, array.dtype, "w+", shape=array.shape)
        kept[:] = array
        return kept
    return room


class Exchange:
    """Adds the tables of the tasks of a barrier stage; every task gets the sum."""

    def __init__(self, plan: Plan):
        self.tasks, self.me, self.turn = plan.tasks, 0, 0
        if self.tasks > 1:
            context = BarrierTaskContext.get()
            self.me = context.partitionId()
            attempt = context.allGather(str(context.taskAttemptId()))[0]  # a stage that is run again has a folder of its own
            self.store, path = pafs.FileSystem.from_uri(plan.folder)
            self.path = f"{path}/{attempt}"
            self.store.create_dir(self.path)

    def added(self, table: np.ndarray, most: bool = False) -> np.ndarray:
        if self.tasks == 1:
            return table
        name = f"{self.path}/{self.turn}-{self.me}"
        with self.store.open_output_stream(f"{name}.part") as out:
            out.write(table.tobytes())
        self.store.move(f"{name}.part", name)
        parts = [table if k == self.me else self._read(f"{self.path}/{self.turn}-{k}", table) for k in range(self.tasks)]
        if self.turn:  # who has written this turn's table has read all of the last turn's
            self.store.delete_file(f"{self.path}/{self.turn - 1}-{self.me}")
        self.turn += 1
        return np.max(parts, axis=0) if most else np.sum(parts, axis=0)

    def _read(self, name: str, like: np.ndarray) -> np.ndarray:
        wait = 0.0005
        while True:
            try:
                with self.store.open_input_file(name) as file:
                    return np.frombuffer(file.read()).reshape(like.shape)
            except FileNotFoundError:  # a task that is lost ends the whole stage, and this loop with it
                time.sleep(wait)
                wait = min(0.02, wait * 1.3)


def _table(chunks, plan: Plan, nodes: int, routes, scale: float | None) -> np.ndarray:
    """Rows and residual units by node and bin (features one after the other) of the nodes of a level.

    ``routes`` moves the rows from the level above; ``scale`` is given for the first level."""
    sizes = [int(np.prod([plan.bins[f] for f in g])) for g in plan.groups]
    counts = [np.zeros(nodes * s) for s in sizes]
    sums = [np.zeros(nodes * s) for s in sizes]
    for c in chunks:
        if scale is not None:
            np.rint(c.left * scale, out=c.units)
            c.node[:] = 0
        _route(c, routes, sizes)
        node = c.node.astype(np.int64)
        for g, size in enumerate(sizes):
            key = node * size
            key += c.joint[g]
            counts[g] += np.bincount(key, minlength=nodes * size)
            sums[g] += np.bincount(key, c.units, nodes * size)
    out = np.zeros((2, nodes, sum(plan.bins)))
    starts = np.cumsum([0, *plan.bins])
    for g, features in enumerate(plan.groups):
        shape = (nodes, *[plan.bins[f] for f in features])
        for k, f in enumerate(features):
            others = tuple(a for a in range(1, len(shape)) if a != k + 1)
            out[0, :, starts[f]:starts[f + 1]] = counts[g].reshape(shape).sum(axis=others)
            out[1, :, starts[f]:starts[f + 1]] = sums[g].reshape(shape).sum(axis=others)
    return out


def _route(c: Chunk, routes, sizes) -> None:
    if routes is None:
        return
    node = c.node.astype(np.int64)
    right = np.zeros(len(node), np.int16)
    for g, goes_right in routes.items():
        key = node * sizes[g]
        key += c.joint[g]
        right += goes_right[key]
    np.multiply(c.node, 2, out=c.node)
    c.node += right


def _routes(plan: Plan, nodes: int, chosen: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """By group: for node and joint bin whether the row goes right.  A node without a split sends its rows left."""
    routes = {}
    for g, features in enumerate(plan.groups):
        own = {n: s for n, s in chosen.items() if s[0] in features}
        if own:
            table = np.zeros((nodes, *[plan.bins[f] for f in features]), np.int16)
            for n, (f, at) in own.items():
                shape = [1] * len(features)
                shape[features.index(f)] = -1
                table[n] = (np.arange(plan.bins[f]) > at).reshape(shape)
            routes[g] = table.reshape(-1)
    return routes


def _best(table: np.ndarray, plan: Plan, scale: float) -> list[tuple[int, int, float, tuple, tuple] | None]:
    """Per node the first best (feature, candidate, gain, left rows and units, right rows and units); none: a leaf."""
    starts = np.cumsum([0, *plan.bins])
    gains, lefts, of = [], [], []
    total = table[:, :, :starts[1]].sum(axis=2)  # every feature's bins hold all rows
    for f, bins in enumerate(plan.bins):
        if bins > 1:
            left = table[:, :, starts[f]:starts[f + 1] - 1].cumsum(axis=2)
            lefts.append(left)
            of += [(f, at) for at in range(bins - 1)]
    if not of:
        return [None] * table.shape[1]
    left = np.concatenate(lefts, axis=2)
    right = total[:, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = (left[1] / left[0] - right[1] / right[0]) / scale
        gains = (left[0] / total[0][:, None]) * (right[0] / total[0][:, None]) * gap * gap
    fits = (left[0] >= max(1, plan.least)) & (right[0] >= max(1, plan.least)) & (gains >= plan.gain)
    gains = np.where(fits, gains, 0)
    found = []
    for n, best in enumerate(gains.argmax(axis=1).tolist()):
        found.append((*of[best], float(gains[n, best]), tuple(left[:, n, best].tolist()), tuple(right[:, n, best].tolist()))
                     if gains[n, best] > 0 else None)
    return found


def grow(batches, plan: Plan):
    """All trees, from the first task: a row per tree of its nodes (heap numbers from 1): number, feature (-1: a leaf),
    threshold, gain, rows, mean, sum of squares."""
    room = _room()
    chunks = [Chunk(batch.column(0)[k].as_buffer(), batch.column(1)[k].as_buffer(), len(plan.groups), room)
              for batch in batches for k in range(batch.num_rows)]
    exchange = Exchange(plan)
    sizes = [int(np.prod([plan.bins[f] for f in g])) for g in plan.groups]
    weight = 1.0
    largest = exchange.added(np.array([max((float(np.abs(c.left).max()) for c in chunks), default=0.0)]), most=True)[0]
    for tree in range(plan.rounds):
        scale = 2.0 ** np.floor(np.log2(2.0 ** 52 / (plan.rows * largest))) if largest > 0 else 1.0
        splits: dict[int, tuple] = {}
        stats: dict[int, tuple] = {}
        routes, open_, level = None, {1}, -1
        for level in range(plan.depth):
            nodes = 1 << level
            table = exchange.added(_table(chunks, plan, nodes, routes, scale if level == 0 else None))
            if level == 0:
                stats[1] = tuple(table[:, 0, :plan.bins[0]].sum(axis=1).tolist())
            best = _best(table, plan, scale)
            chosen = {n - nodes: best[n - nodes] for n in sorted(open_) if best[n - nodes]}
            routes, open_ = _routes(plan, nodes, {n: s[:2] for n, s in chosen.items()}), set()
            for n, found in chosen.items():
                splits[nodes + n] = found
                for child, own in ((2 * (nodes + n), found[3]), (2 * (nodes + n) + 1, found[4])):
                    stats[child] = own
                    open_.add(child)
            if not open_:
                break
        deep = level + 1  # rows stand at the level below the last table once they are moved
        if not stats:  # depth 0
            deep = 0
            stats[1] = (float(plan.rows), exchange.added(np.array([sum(float(np.rint(c.left * scale).sum()) for c in chunks)]))[0])
        means = {n: s / scale / r for n, (r, s) in stats.items()}
        value, leaf = np.zeros(1 << deep), np.zeros(1 << deep, np.int64)
        for n in range(1 << deep):
            at, way = 1, 0
            while at in splits:
                at = 2 * at + ((n >> (deep - 1 - way)) & 1)
                way += 1
            value[n], leaf[n] = means[at], at
        squares, most = np.zeros(1 << deep), 0.0
        for c in chunks:
            if deep:
                _route(c, routes, sizes)
            else:
                c.node[:] = 0
            squares += np.bincount(c.node, c.left * c.left, 1 << deep)
            c.score += weight * value[c.node]
            np.subtract(c.y, c.score, out=c.left)
            c.left *= 2.0  # minus the gradient of the squared error
            most = max(most, float(np.abs(c.left).max()))
        largest = exchange.added(np.array([most]), most=True)[0]
        squares = exchange.added(squares)
        weight = plan.step
        if exchange.me == 0:
            square = dict.fromkeys(stats, 0.0)
            for n, s in zip(leaf.tolist(), squares.tolist()):
                while n:
                    square[n] += s
                    n //= 2
            nodes = [(n, splits[n][0] if n in splits else -1,
                      float(plan.thresholds[splits[n][0]][splits[n][1]]) if n in splits else 0.0,
                      splits[n][2] if n in splits else 0.0, stats[n][0], means[n], square[n]) for n in sorted(stats)]
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int64()), pa.array([np.array(nodes, np.float64).tobytes()], pa.binary())],
                                             ["tree", "nodes"])


def slots(spark) -> int:
    """Tasks that can run at once."""
    scala = spark.sparkContext._jsc.sc()
    return scala.maxNumConcurrentTasks(scala.resourceProfileManager().defaultResourceProfile())


class BoostedTrees(GBTRegressor):
    """``GBTRegressor`` whose fit is one stage where ``plan_of`` covers its parameters."""

    def _fit_java(self, dataset: DataFrame):
        plan = self.plan_of(dataset)
        return super()._fit_java(dataset) if plan is None else self._model_of(self._grown(dataset, plan), plan)

    def plan_of(self, dataset: DataFrame) -> Plan | None:
        """The plan of a fit, or none where MLlib has to fit."""
        unset = not any(self.isDefined(p) and self.getOrDefault(p) for p in (self.weightCol, self.validationIndicatorCol))
        if not (unset and self.getLossType() == "squared" and self.getImpurity() == "variance" and self.getSubsamplingRate() == 1.0
                and self.getFeatureSubsetStrategy() in ("all", "auto") and self.getMinWeightFractionPerNode() == 0.0
                and self.getMaxDepth() <= DEEPEST and self.getMaxBins() <= GROUP):
            return None
        self._transfer_params_to_java()
        spark = dataset.sparkSession
        jvm = spark.sparkContext._jvm
        features = dataset._jdf.schema().apply(self.getFeaturesCol())
        categories = jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(features)
        if categories.size():
            return None
        strategy = self._java_obj.getOldBoostingStrategy(categories, jvm.org.apache.spark.mllib.tree.configuration.Algo.Regression()).treeStrategy()
        util = getattr(getattr(jvm.org.apache.spark.ml.util, "DatasetUtils$"), "MODULE$")
        instances = util.extractInstances(self._java_obj, dataset._jdf, getattr(util, "extractInstances$default$3")())
        impl = jvm.org.apache.spark.ml.tree.impl
        meta = getattr(getattr(impl, "DecisionTreeMetadata$"), "MODULE$").buildMetadata(instances, strategy, 1, "all")
        found = getattr(getattr(impl, "RandomForest$"), "MODULE$").findSplits(instances, meta, self.getSeed())
        thresholds = [np.array([split.threshold() for split in of], np.float64) for of in found]
        rows, cores = meta.numExamples(), slots(spark)
        tasks = max(1, min(cores, max(min(MOST_TASKS, rows // TASK_ROWS), rows // FULL_TASK_ROWS)))
        folder = ""
        if tasks > 1:
            folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"
            try:
                pafs.FileSystem.from_uri(folder)
            except (pa.ArrowInvalid, OSError):
                return None
            if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
                return None
        return Plan(thresholds, self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getMinInstancesPerNode(),
                    self.getMinInfoGain(), rows, tasks, folder)

    def _grown(self, dataset: DataFrame, plan: Plan) -> list[np.ndarray]:
        rows = dataset.select(F.col(self.getLabelCol()).cast("double"), vector_to_array(F.col(self.getFeaturesCol())))
        most = max(1, min(BLOCK_ROWS, plan.rows // (8 * plan.tasks)))  # some blocks for each task
        blocks = rows.mapInArrow(lambda batches: blocks_of(batches, plan, most), "joint binary, labels binary")
        try:
            trees = blocks.repartition(plan.tasks).mapInArrow(lambda batches: grow(batches, plan), "tree long, nodes binary",
                                                              barrier=plan.tasks > 1).collect()
        finally:
            if plan.folder:
                store, path = pafs.FileSystem.from_uri(plan.folder)
                if store.get_file_info(path).type == pafs.FileType.Directory:
                    store.delete_dir(path)
        return [np.frombuffer(r["nodes"]).reshape(-1, 7) for r in sorted(trees, key=lambda r: r["tree"])]

    def _model_of(self, trees: list[np.ndarray], plan: Plan):
        from pyspark import SparkContext

        gateway = SparkContext._active_spark_context._gateway
        jvm = gateway.jvm
        tree_, regression, double = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression, jvm.double
        inner, outer, candidate = tree_.InternalNode, tree_.LeafNode, tree_.ContinuousSplit  # looking a name up is a call, too
        variance, part, tree_model = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange, \
            regression.DecisionTreeRegressionModel
        models, weights = gateway.new_array(tree_model, len(trees)), gateway.new_array(double, len(trees))

        def tree_of(nodes):
            count, mean = nodes[:, 4], nodes[:, 5]
            stats = gateway.new_array(double, 3 * len(nodes))
            values = np.stack([count, mean * count, nodes[:, 6]], axis=1).astype(">f8").tobytes()
            jvm.java.nio.ByteBuffer.wrap(values).asDoubleBuffer().get(stats)
            impurity = np.maximum(0.0, nodes[:, 6] / count - mean * mean).tolist()
            made = {}
            for n in range(len(nodes) - 1, -1, -1):  # children first
                number, feature, threshold, gain, rows, value, _ = nodes[n].tolist()
                own, number = variance(part(stats, 3 * n, 3 * n + 3), int(rows)), int(number)
                made[number] = outer(value, impurity[n], own) if feature < 0 else inner(
                    value, impurity[n], gain, made.pop(2 * number), made.pop(2 * number + 1), candidate(int(feature), threshold), own)
            return tree_model(made[1], len(plan.bins))
        for k, nodes in enumerate(trees):
            models[k], weights[k] = tree_of(nodes), 1.0 if k == 0 else plan.step
        model = regression.GBTRegressionModel(self.uid, models, weights, len(plan.bins)).setParent(self._java_obj)
        return self._java_obj.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap())
