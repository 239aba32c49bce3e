"""Centroid clustering over subvector dictionaries, in exact integers.

A vector's components become integers ``floor(scale * x)``.  Its dimensions are
cut into blocks of ``block_dims``, and every block is dictionary-encoded without
loss: a shard (one row of the written table, at most ``shard_rows`` vectors)
holds, for each block, its distinct subvectors and one code per vector.

A round sends the few centroids to all shards.  A shard computes the exact
squared distance of every distinct subvector of every block to each centroid
once, and a vector's distance is the sum of the partial distances its codes
point at.  Shards return sums and sizes by cluster; Spark adds them up.  Vectors
are sorted into shards by their components, so equal vectors and equal leading
blocks share dictionary entries; no vector is shuffled after the shards are
written, and no shard depends on how many rows hold one vector.

Exactness: sums leave a shard as 32-bit limbs and are put together in Python
integers, so they hold at every size.  Components too large for 64-bit distances
are computed in Python integers as well.

Rows take part whose vector has exactly ``dims`` components, none null or
non-finite.  The ``k`` starting centroids are the rows with the smallest SHA-256
of ``<seed>:<id>``, in that order; rows of one id order by their components, and
rows with a null id take part but never start a centroid.  With fewer rows there
are fewer centroids, with none no rows come back.  Repeated rows count each.  A
distance or inertia that a long cannot hold is null.  Other columns are ignored
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.shipping import ship_package
from parcelgrid.session import ensure_checkpoint_dir

LIMB = 1 << 32
SMALL = 1 << 25  # 64 squared gaps of components below it stay far within 64 bits
LONG_MAX = (1 << 63) - 1
SHARD_ROWS = 16_384
SORT_RANGES_OF = 200_000  # vectors in one sorted range, at most about


def whole_components(column, scale: int) -> np.ndarray:
    """floor(scale * x) of every component: int64, or Python integers where 64 bits could overflow."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    exact = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        # from 2**53 on a double is a whole number; below, scaling by a power of two is exact
        exact[at] = int(v) * scale if abs(v) >= 2.0 ** 53 else math.floor(v * scale)
    return exact


def dictionaries(x: np.ndarray, block_dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(distinct subvectors of each block, codes by vector and block)."""
    found, codes = [], []
    for at in range(0, x.shape[1], block_dims):
        part = x[:, at:at + block_dims]
        if part.dtype == object:
            places: dict[tuple, int] = {}
            code = [places.setdefault(tuple(row), len(places)) for row in part]
            distinct = np.array(list(places), object).reshape(len(places), part.shape[1])
        else:
            distinct, code = np.unique(part, axis=0, return_inverse=True)
        found.append(distinct)
        codes.append(np.asarray(code, np.int32).reshape(-1))
    return found, np.column_stack(codes)


class Shard:
    """Dictionaries and codes of one written row."""

    def __init__(self, row: dict, block_dims: int):
        self.ids, self.n = row["ids"], len(row["ids"])
        self.codes = np.frombuffer(row["codes"], np.int32).reshape(self.n, -1)
        self.blocks = []
        for k, flat in enumerate(row["entries"]):
            width = row["widths"][k]
            whole = (np.array([int(v) for v in flat.decode().split()], object) if row["big"]
                     else np.frombuffer(flat, np.int64))
            self.blocks.append(whole.reshape(-1, width))
        self.block_dims = block_dims

    def assign(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every vector: nearest centroid, ties to the smaller number."""
        big = any(b.dtype == object for b in self.blocks) or max(abs(c) for row in centroids for c in row) >= SMALL
        kind = object if big else np.int64
        middle = np.array(centroids, kind).reshape(len(centroids), -1)
        total = np.zeros((self.n, len(centroids)), kind)
        for k, entries in enumerate(self.blocks):
            at = k * self.block_dims
            gap = entries.astype(kind)[:, None, :] - middle[None, :, at:at + entries.shape[1]]
            total += (gap * gap).sum(axis=2)[self.codes[:, k]]  # once per distinct subvector, looked up by code
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> list[list[int]]:
        """Componentwise sum of each cluster's vectors: entry times how often the cluster uses its code."""
        rows: list[list[int]] = [[] for _ in range(k)]
        for b, entries in enumerate(self.blocks):
            uses = np.bincount(cluster.astype(np.int64) * len(entries) + self.codes[:, b], minlength=k * len(entries))
            uses = uses.reshape(k, len(entries))
            added = uses.astype(entries.dtype) @ entries
            for c in range(k):
                rows[c] += [int(v) for v in added[c]]
        return rows


SHARD_TYPE = "ids array<{id}>, codes binary, entries array<binary>, widths array<int>, big boolean"


def write_shards(rows: DataFrame, folder: str, scale: int, block_dims: int, shard_rows: int) -> None:
    """Encode (id, v) rows to shards, one row each, sorted by components within bounded ranges."""
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches):
        held: list[pd.DataFrame] = []
        count = 0

        def shard(part: pd.DataFrame) -> pd.DataFrame:
            x = whole_components(part["v"], scale)
            blocks, codes = dictionaries(x, block_dims)
            big = x.dtype == object
            entries = [" ".join(map(str, b.ravel())).encode() if big else np.ascontiguousarray(b, np.int64).tobytes()
                       for b in blocks]
            return pd.DataFrame({"ids": [[None if pd.isna(i) else i for i in part["id"]]], "codes": [codes.tobytes()],
                                 "entries": [entries], "widths": [[b.shape[1] for b in blocks]], "big": [big]})

        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= shard_rows:
                whole = pd.concat(held, ignore_index=True)
                yield shard(whole.iloc[:shard_rows])
                held = [whole.iloc[shard_rows:]]
                count = len(held[0])
        if count:
            yield shard(pd.concat(held, ignore_index=True))

    n_ranges = max(1, -(-rows.count() // SORT_RANGES_OF), rows.sparkSession.sparkContext.defaultParallelism)
    # a hot vector spreads over ranges: the id is the last sort key
    ordered = rows.repartitionByRange(n_ranges, "v", "id").sortWithinPartitions("v", "id")
    ordered.mapInPandas(encode, SHARD_TYPE.format(id=id_type)).write.parquet(folder)


def _limbs(value: int) -> list[int]:
    """The value's 32-bit limbs, lowest first; the last one is signed and holds the rest."""
    out = []
    while not -LIMB <= value < LIMB:
        out.append(value % LIMB)
        value //= LIMB
    return [*out, value]


def _round(shards: DataFrame, centroids: list[list[int]], block_dims: int) -> list[list[int]]:
    """The next centroids: componentwise exact floor of sum over size; an empty cluster's stays."""
    k, dims = len(centroids), len(centroids[0])
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("parts", pa.list_(pa.int64()))])

    def add(batches):
        """A task's sums: for each cluster and limb place the limbs of its size and of all components."""
        totals = [[0] * (dims + 1) for _ in range(k)]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, block_dims)
                cluster, _ = shard.assign(centroids)
                sizes = np.bincount(cluster.astype(np.int64), minlength=k).tolist()
                for total, size, own in zip(totals, sizes, shard.sums(cluster, k)):
                    for at, value in enumerate([size, *own]):
                        total[at] += value
        out = []
        for c, total in enumerate(totals):
            if total[0]:
                places = list(zip_longest(*map(_limbs, total), fillvalue=0))
                out += [{"cluster": c, "place": p, "parts": list(parts)} for p, parts in enumerate(places)]
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = shards.mapInArrow(add, "cluster int, place int, parts array<long>")
    found = parts.groupBy("cluster", "place").agg(F.array(*[F.sum(F.col("parts")[d]) for d in range(dims + 1)]).alias("parts"))
    sums = [[0] * (dims + 1) for _ in range(k)]
    for r in found.collect():  # k clusters by a few limb places
        for at, part in enumerate(r["parts"]):
            sums[r["cluster"]][at] += part * LIMB ** r["place"]
    return [[value // total[0] for value in total[1:]] if total[0] else old for total, old in zip(sums, centroids)]


def usable_vectors(table: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    vector = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.select(F.col(id_col).alias("id"), vector.alias("v")).where((F.size("v") == dims) & finite)


def cluster_vectors(table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024,
                    block_dims: int = 4, id_col: str = "vec_id", vec_col: str = "embedding",
                    shard_rows: int = SHARD_ROWS, folder: str | None = None) -> DataFrame:
    """The id column, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``."""
    if scale & (scale - 1) or dims * (2 * SMALL) ** 2 > LONG_MAX:
        raise ValueError("scale must be a power of two, and dims within the bound of 64-bit distances")
    spark = table.sparkSession
    ship_package(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    rows = usable_vectors(table, dims, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    out_type = f"id {id_type}, cluster int, distance long"
    first = (rows.where(F.col("id").isNotNull())
             .orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).collect())
    if not first:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    centroids = [[int(c) for c in whole_components([r["v"]], scale)[0]] for r in first]
    write_shards(rows, folder, scale, block_dims, shard_rows)
    shards = spark.read.parquet(folder)
    for _ in range(rounds):
        centroids = _round(shards, centroids, block_dims)

    def place(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, block_dims)
                cluster, distance = shard.assign(centroids)
                fits = [int(d) if d <= LONG_MAX else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids, batch.schema.field("ids").type.value_type),
                     pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    placed = shards.mapInArrow(place, out_type)
    exact = F.col("distance").cast("decimal(38,0)")
    of_cluster = placed.groupBy("cluster").agg(F.sum(exact).alias("s"), F.count("distance").alias("n"), F.count("*").alias("m"))
    totals = {r["cluster"]: r["s"] if r["n"] == r["m"] else None for r in of_cluster.collect()}  # k rows
    whole = None if None in totals.values() else sum(totals.values())
    fit = lambda v: int(v) if v is not None and v <= LONG_MAX else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertias = F.array(*[F.lit(fit(totals.get(c, 0))).cast("long") for c in range(len(centroids))])
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", F.get(inertias, F.col("cluster")).alias("cluster_inertia"),
        F.lit(fit(whole)).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, sha)), F.col("cluster")).alias("centroid_sha256"))
