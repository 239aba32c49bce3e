"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Nearness is the largest inner product, in double precision; vectors of one dimension
are searched among themselves.

1. Equal vectors become one class that keeps its ``k + 1`` smallest ids: no other
   member can be among a query's ``k`` nearest, since ties go to the smaller id.
2. A tree of k-means splits is fitted for each dimension on a bounded sample of classes
   (``SAMPLE``), with a leaf for every ``LEAF_CLASSES`` classes, ``MAX_LEAVES`` at
   most; every class is then filed under a leaf.  A dimension of fewer than
   ``TREE_CLASSES`` classes is one leaf, so its search is exact.
3. A query walks the tree with a priority queue over nodes, best worth first.  A
   node's worth is about what its best vector scores: the product with the centroid
   plus ``ORDER`` times the query's norm times the node's spread.
4. Pilot: every query is compared with its first leaves, until they hold ``PILOT``
   times ``k + 1`` ids and one in ``PILOT_SHARE`` of all.  The k-th score found is the
   query's floor; being that of a fixed share, it leaves as many better ones in a large
   table as in a small one.
5. The walk ends after a calibrated number of leaves, and earlier where no leaf with
   a worth this low, raised to ``SURE`` spreads, can reach the query's floor.  What it
   and the pilot met is compared, and only what reaches the floor is sent on.
6. Calibration: a bounded set of queries (``CALIBRATION``) is answered by brute force
   over all classes, and the number of leaves is widened until the mean recall reaches
   ``target`` and all but a twentieth of these queries reach half of it.

Queries and vectors meet in packs, neighbouring leaves of some thousand vectors.  In a
sorted stream the vectors of a pack come first and are held, and the queries pass by
in batches, each with the leaves it visits; a query gets its best of a pack at once.
A vector is shuffled once a search, however many queries there are, and a query once
for each pack it visits.  A pack holds about ``PACK_ROOT`` times the root of the number
of vectors, so that both packs and what a pack holds grow with the root, and at most
``PACK_BYTES``.  Python holds one pack, ``CELLS`` products and ``ASKED_BYTES`` of queries
by pack at a time, however many queries and packs there are.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null id.  Rows that repeat an id and its vector count once.  With
``k`` candidates or fewer all are returned; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.shipping import ship_package
from parcelgrid.session import ensure_checkpoint_dir

SAMPLE = 20_000
CALIBRATION = 200
BRANCHING = 16
LEAF_CLASSES, MAX_LEAVES = 8, 4096
TREE_CLASSES = 200
PILOT, PILOT_SHARE = 4, 64
ORDER, SURE = 2.0, 5.0  # spreads
PACK_LEAST, PACK_ROOT, PACK_BYTES = 1024, 12, 1 << 26
CELLS, ASKED_BYTES = 1 << 22, 1 << 23


class Tree:
    """Centroids and spreads of all nodes; ``children`` by node (none: a leaf); ``leaf_no`` by node."""

    def __init__(self, vectors: np.ndarray, branching: int = BRANCHING, leaves: int = MAX_LEAVES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = [vectors.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.spread = [_spread(vectors, self.centroids[0])]
        members = {0: np.arange(len(vectors))}
        queue = [(-len(vectors), 0)]
        n_leaves = 1
        while queue and n_leaves + branching - 1 <= leaves:
            _, node = heapq.heappop(queue)  # the fullest leaf is split next
            own = members.pop(node)
            if len(own) < 2 * branching:
                break
            centroids, label = _kmeans(vectors[own], branching, rng)
            for c in range(len(centroids)):
                inside = own[label == c]
                child = len(self.centroids)
                self.centroids.append(centroids[c])
                self.spread.append(_spread(vectors[inside], centroids[c]))
                self.children.append([])
                self.children[node].append(child)
                members[child] = inside
                heapq.heappush(queue, (-len(inside), child))
            n_leaves += len(centroids) - 1
        self.centroids, self.spread = np.array(self.centroids), np.array(self.spread)
        self.widest = max(s for s, below in zip(self.spread.tolist(), self.children) if not below)
        self.leaf_no = {}
        stack = [0]
        while stack:  # leaves under one node have neighbouring numbers
            node = stack.pop()
            if self.children[node]:
                stack += reversed(self.children[node])
            else:
                self.leaf_no[node] = len(self.leaf_no)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf number of each vector: at every node the nearest centroid."""
        at = np.zeros(len(vectors), np.int64)
        moving = [0] if self.children[0] else []
        while moving:
            below = []
            for node in moving:
                rows = np.flatnonzero(at == node)
                if len(rows):
                    kids = np.array(self.children[node])
                    c = self.centroids[kids]
                    gap = (c * c).sum(axis=1) - 2 * vectors[rows] @ c.T
                    at[rows] = kids[gap.argmin(axis=1)]
                    below += [k for k in kids.tolist() if self.children[k]]
            moving = below
        return np.array([self.leaf_no[n] for n in at.tolist()], np.int64)

    def walk(self, query: np.ndarray):
        """(leaf, worth) in the order of a best-bin-first walk."""
        worth = (self.centroids @ query + ORDER * np.sqrt(query @ query) * self.spread).tolist()
        queue = [(-worth[0], 0)]
        while queue:
            found, node = heapq.heappop(queue)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-worth[child], child))
            else:
                yield self.leaf_no[node], -found

    def pilot(self, query: np.ndarray, sizes: list[int], least: int) -> list[int]:
        """The first leaves that hold ``least`` ids."""
        found, held = [], 0
        for leaf, _ in self.walk(query):
            found.append(leaf)
            held += sizes[leaf]
            if held >= least:
                break
        return found

    def visits(self, query: np.ndarray, most: int, floor: float, sizes: list[int], least: int) -> list[int]:
        """The pilot's leaves and the walk's first ``most``, without those that cannot reach ``floor``."""
        found = self.pilot(query, sizes, least)
        room = (SURE - ORDER) * float(np.sqrt(query @ query)) * self.widest
        for n, (leaf, worth) in enumerate(self.walk(query)):
            if n >= most or worth + room < floor:
                break
            if n >= len(found):  # the pilot is the walk's beginning
                found.append(leaf)
        return found


def _spread(vectors: np.ndarray, centroid: np.ndarray) -> float:
    """Root mean square of the components' distance from the centroid."""
    return float(np.sqrt(np.mean((vectors - centroid) ** 2))) if len(vectors) else 0.0


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = ((centroids * centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, x)
        sizes = np.bincount(label, minlength=len(centroids))
        centroids = sums[sizes > 0] / sizes[sizes > 0, None]
    label = ((centroids * centroids).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)
    return centroids, label


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _nearest(q_ids: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: list, k: int,
             floor: np.ndarray | None = None, rough: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest rows of each query among these classes that reach its floor: query_id, vec_id, score.

    ``rough`` holds the products, minus infinity where a class is not compared with a query."""
    rough = queries @ vectors.T if rough is None else rough
    kth = min(k + 1, rough.shape[1])
    edge = np.partition(rough, rough.shape[1] - kth, axis=1)[:, rough.shape[1] - kth]
    if floor is not None:
        edge = np.maximum(edge, floor)
    slack = np.where(np.isfinite(edge), 1e-9 * (1 + np.abs(edge)), 0)  # the matrix product may differ from the measure in the last bits
    at, of = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
    exact = (queries[at] * vectors[of]).sum(axis=1)  # the measure: the same sum for the same pair, wherever it stands
    sizes = np.array([len(ids[c]) for c in of.tolist()], np.int64)
    out = pd.DataFrame({"query_id": np.repeat(q_ids[at], sizes), "score": np.repeat(exact, sizes),
                        "vec_id": np.concatenate([ids[c] for c in of.tolist()]) if len(of) else np.zeros(0, np.int64)})
    out = out[out.query_id != out.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)[["query_id", "vec_id", "score"]]


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)))
    # -0.0 and 0.0 are the same component
    rows = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    return rows.groupBy("vec_id", "v").agg(F.lit(1)).select("vec_id", "v")


def fit_trees(classes: DataFrame, sample: int = SAMPLE, leaf_classes: int = LEAF_CLASSES, max_leaves: int = MAX_LEAVES,
              tree_classes: int = TREE_CLASSES) -> dict[int, Tree]:
    """A tree for every dimension with ``tree_classes`` classes or more; the sample is shared by size."""
    sizes = {r["d"]: r["count"] for r in classes.groupBy(F.size("v").alias("d")).count().collect()
             if r["count"] >= tree_classes}
    trees = {}
    for d, n in sorted(sizes.items()):
        share = max(tree_classes, sample * n // sum(sizes.values()))
        picked = classes.where(F.size("v") == d).select("v").orderBy(F.xxhash64("v")).limit(share).toPandas()
        leaves = max(1, min(n // leaf_classes, max_leaves, len(picked) // 4))
        trees[d] = Tree(_matrix(picked["v"]), leaves=leaves)
    return trees


def _packs(held: dict[str, int], size: int) -> dict[str, list[int]]:
    """Packs of each leaf (by number of classes): small neighbouring leaves of a dimension share one, a large one has several."""
    packs, number, room, last = {}, -1, 0, None
    for leaf, n in sorted(held.items(), key=lambda x: tuple(map(int, x[0].split(":")))):
        if leaf.split(":")[0] != last:
            last, room = leaf.split(":")[0], 0
        if n > size:
            packs[leaf] = [number + 1 + k for k in range(-(-n // size))]
            number, room = packs[leaf][-1], 0
        else:
            if n > room:
                number, room = number + 1, size
            packs[leaf] = [number]
            room -= n
    return packs


def _by_pack(batches, leaves_of, packs: dict[str, list[int]]):
    """A row for every pack that a query visits, with its leaves there, in frames of about ``ASKED_BYTES``."""
    columns = ["query_id", "least", "v", "pack", "seen"]
    out, held = [], 0
    for part in batches:
        for query, floor, v in zip(part["query_id"], part["least"], part["v"]):
            there: dict[int, list[int]] = {}
            for leaf in leaves_of(v, floor):
                for pack in packs.get(f"{len(v)}:{leaf}", ()):
                    there.setdefault(pack, []).append(leaf)
            for pack, seen in there.items():
                out.append((query, floor, v, pack, seen))
                held += 8 * (len(v) + len(seen))
                if held >= ASKED_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
    if out:
        yield pd.DataFrame(out, columns=columns)


def _compared(some: pd.DataFrame, vectors: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Products of each query with the classes of its leaves, minus infinity elsewhere."""
    queries = _matrix(some["v"])
    rough = np.full((len(some), len(vectors)), -np.inf)
    seen = [np.asarray(x) for x in some["seen"]]
    row = np.repeat(np.arange(len(some)), [len(x) for x in seen])
    of = np.concatenate(seen)
    order = np.argsort(of, kind="stable")
    row, of = row[order], of[order]
    for leaf in np.unique(leaves):
        here = row[np.searchsorted(of, leaf):np.searchsorted(of, leaf, "right")]
        columns = np.flatnonzero(leaves == leaf)
        rough[np.ix_(here, columns)] = queries[here] @ vectors[columns].T
    return rough


def _answers(batches, k: int):
    """The best of each pack for each query; batches are sorted by pack, its vectors first.  At most ``CELLS`` products at a time."""
    here, parts = None, []
    for batch in batches:
        for key, part in batch.groupby("pack", sort=False):
            if key != here:
                here, parts = key, []
            held = part[part.side == 0]
            if len(held):
                parts.append((_matrix(held["v"]), [np.asarray(i, np.int64) for i in held["ids"]],
                              np.array([x[0] for x in held["seen"]])))
            queries = part[part.side == 1]
            if len(queries) and parts:
                if len(parts) > 1:
                    parts = [(np.concatenate([p[0] for p in parts]), sum((p[1] for p in parts), []),
                              np.concatenate([p[2] for p in parts]))]
                vectors, ids, leaves = parts[0]
                step = max(1, CELLS // len(vectors))
                for at in range(0, len(queries), step):
                    some = queries.iloc[at:at + step]
                    found = _nearest(some["query_id"].to_numpy(np.int64), _matrix(some["v"]), vectors, ids, k,
                                     some["least"].to_numpy(np.float64), _compared(some, vectors, leaves))
                    if len(found):
                        yield found


def _meet(asked: DataFrame, filed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best that reach ``least`` of each asked (query_id, least, v, pack, seen leaves)
    among the pack's classes of those leaves."""
    left = asked.select("pack", F.lit(1).alias("side"), "query_id", "least", "seen", F.lit(None).cast("array<long>").alias("ids"), "v")
    right = filed.select("pack", F.lit(0).alias("side"), F.lit(None).cast("long").alias("query_id"),
                         F.lit(None).cast("double").alias("least"), F.array("no").alias("seen"), "ids", "v")

    return (left.unionByName(right).repartition("pack").sortWithinPartitions("pack", "side")
            .mapInPandas(lambda batches: _answers(batches, k), "query_id long, vec_id long, score double"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(table: DataFrame, is_query, k: int = 20, target: float = 0.92, id_col: str = "vec_id",
                       vec_col: str = "embedding", sample: int = SAMPLE, calibration: int = CALIBRATION,
                       leaf_classes: int = LEAF_CLASSES, max_leaves: int = MAX_LEAVES,
                       tree_classes: int = TREE_CLASSES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k nearest found of every query row.

    ``is_query`` is a condition on ``vec_id`` that names the query rows.
    """
    found, _ = search(table, is_query, k, target, id_col, vec_col, sample, calibration, leaf_classes, max_leaves, tree_classes)
    return found


def search(table: DataFrame, is_query, k: int, target: float, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, calibration: int = CALIBRATION, leaf_classes: int = LEAF_CLASSES,
           max_leaves: int = MAX_LEAVES, tree_classes: int = TREE_CLASSES) -> tuple[DataFrame, dict]:
    """``nearest_neighbours`` and what the calibration found: ``leaves`` visited at most, mean ``recall``, the share of
    queries with a ``low`` one, and the share of ids ``met``."""
    spark = table.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = usable(table, id_col, vec_col).checkpoint()
    same = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).checkpoint()
    trees = spark.sparkContext.broadcast(fit_trees(classes, sample, leaf_classes, max_leaves, tree_classes))

    def file(batches):
        for part in batches:
            for d, own in part.groupby(part["v"].map(len)):
                leaf = trees.value[d].leaf_of(_matrix(own["v"])) if d in trees.value else np.zeros(len(own), np.int64)
                yield own.assign(leaf=[f"{d}:{n}" for n in leaf.tolist()])

    filed = classes.mapInPandas(file, "v array<double>, ids array<long>, leaf string").checkpoint()
    # a row per leaf: at most max_leaves and a few, and one for each small dimension
    held = filed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    n_classes = sum(r["n"] for r in held)
    widest = max(trees.value, default=1)
    packs = _packs({r["leaf"]: r["n"] for r in held},
                   max(1, min(max(PACK_LEAST, PACK_ROOT * math.isqrt(n_classes)), PACK_BYTES // (8 * widest))))
    of_leaf = spark.createDataFrame([(leaf, of[0], len(of)) for leaf, of in packs.items()], "leaf string, one long, of long")
    filed = filed.join(F.broadcast(of_leaf), "leaf").select(
        "leaf", (F.col("one") + F.pmod(F.xxhash64("v"), F.col("of"))).alias("pack"),
        F.substring_index("leaf", ":", -1).cast("int").alias("no"), "ids", "v")
    sizes = {d: [0] * len(tree.leaf_no) for d, tree in trees.value.items()}
    for r in held:
        d, leaf = map(int, r["leaf"].split(":"))
        if d in sizes:
            sizes[d][leaf] = r["ids"]
    least = {d: max(PILOT * (k + 1), sum(own) // PILOT_SHARE) for d, own in sizes.items()}

    def ask(queries: DataFrame, most: int) -> DataFrame:
        """Queries by the packs they visit, with the leaves there: the pilot's and at most ``most``."""
        def leaves_of(v, floor):
            d = len(v)
            return trees.value[d].visits(np.asarray(v, np.float64), most, floor, sizes[d], least[d]) if d in sizes else [0]

        return queries.mapInPandas(lambda batches: _by_pack(batches, leaves_of, packs),
                                   "query_id long, least double, v array<double>, pack long, seen array<int>")

    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    none = F.lit(float("-inf"))
    pilot = _best(_meet(ask(queries.withColumn("least", none), 0), filed, k), k)
    floors = pilot.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("kth")).otherwise(none).alias("least"))
    queries = (queries.join(floors, "query_id", "left")
               .select("query_id", F.coalesce("least", none).alias("least"), "v").checkpoint())
    most, about = _calibrated(filed, queries, trees.value, sizes, least, k, target, calibration)
    found = _best(_meet(ask(queries, most), filed, k), k)
    return found.select("query_id", "rank", "vec_id", "score"), about


def _calibrated(filed: DataFrame, queries: DataFrame, trees: dict[int, Tree], sizes: dict[int, list[int]], least: dict[int, int],
                k: int, target: float, n: int) -> tuple[int, dict]:
    """The least number of leaves at which the sampled queries' mean recall reaches ``target`` and few fall under half of it."""
    total = max((len(own) for own in sizes.values()), default=1)
    some = queries.where(F.size("v").isin(list(trees))).orderBy(F.xxhash64("query_id", "v")).limit(n).toPandas()
    if not len(some):
        return total, {"leaves": total, "recall": 1.0, "low": 0.0, "met": 1.0}
    of_dim = {d: own for d, own in some.groupby(some["v"].map(len))}

    def exact(batches):
        for part in batches:
            for d, own in part.groupby(part["v"].map(len)):
                if d in of_dim:
                    asked, ids = of_dim[d], [np.asarray(i, np.int64) for i in own["ids"]]
                    near = _nearest(asked["query_id"].to_numpy(np.int64), _matrix(asked["v"]), _matrix(own["v"]), ids, k)
                    leaf = dict(zip(np.concatenate(ids).tolist(), np.repeat(own["leaf"], [len(i) for i in ids]).tolist()))
                    yield near.assign(leaf=[leaf[i] for i in near["vec_id"].tolist()])

    truth = _best(filed.mapInPandas(exact, "query_id long, vec_id long, score double, leaf string"), k)
    wanted: dict[int, list[int]] = {}
    for r in truth.select("query_id", "leaf").collect():  # k rows for each of the n queries
        wanted.setdefault(r["query_id"], []).append(int(r["leaf"].split(":")[1]))
    places, held, pilots = [], [], []
    for q, floor, v in zip(some["query_id"], some["least"], some["v"]):
        tree, own, query = trees[len(v)], sizes[len(v)], np.asarray(v, np.float64)
        walk = tree.visits(query, total, floor, own, least[len(v)])
        at = {leaf: p for p, leaf in enumerate(walk)}
        pilots.append(len(tree.pilot(query, own, least[len(v)])))
        places.append(np.array([at.get(leaf, total) for leaf in wanted.get(q, [])]))
        held.append(np.cumsum([own[leaf] for leaf in walk]) / max(1, sum(own)))
    most = 1
    while True:
        recalls = np.array([np.mean(p < max(most, first)) for p, first in zip(places, pilots) if len(p)] or [1.0])
        met = np.mean([h[min(max(most, first), len(h)) - 1] for h, first in zip(held, pilots)])
        about = {"leaves": most, "recall": float(recalls.mean()), "low": float((recalls < target / 2).mean()), "met": float(met)}
        if most >= total or (about["recall"] >= target and about["low"] <= 0.05):
            return most, about
        most = min(total, most + max(1, most // 40))
