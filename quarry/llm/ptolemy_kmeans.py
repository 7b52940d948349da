"""Exact integer k-means with Ptolemaic pivot bounds.

Components become integers floor(SCALE * x); all distances are exact 64-bit
integers. Every vector caches its distances to a few fixed pivot vectors once.
For a centroid c, a vector v and a pair of pivots p, s Ptolemy's inequality gives

    d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s),

for all pairs p, s, so a round needs only the centroids' distances to the pivots,
a few numbers, to bound every distance from below. A vector's centroid with the
least bound is measured first; then any other is measured exactly only if its
bound does not exceed the best distance so far. Bounds are floating point and
rounded down by more than the accumulated error, so no nearest centroid, and no
tie, is ever excluded.

A round is one pass of NumPy batches over the stored vectors. Tasks emit one row
of sums per cluster and partition, Spark adds them up, and the driver receives one
row per cluster: a bounded table, whatever the number of vectors. No vector is
shuffled, and a hot cluster is only a large number in such a row.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out; repeated ids are rows of their own, and a null
id orders last among the starting vectors; starting vectors equal in hash and
components are interchangeable; fewer vectors than centroids give as many
centroids as vectors; an empty table gives an empty result; columns of other
names are not read. A component beyond LARGEST after scaling could overflow the
64-bit distances: the job fails with an error that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise

SCALE = 1024
PIVOTS = 5
#: Rows among which pivots are chosen (those of least hash); only speed depends on them.
PIVOT_SAMPLE = 512
LARGEST = 1 << 27
BATCH = 4096
#: Slack of the bounds: far more than the few roundings of half a unit in the last place.
EPS = 64 * np.finfo(np.float64).eps


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """vec_id, v (array<int>) of the vectors of ``size`` finite components."""
    x = F.col(f"`{vector_col}`")
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    kept = vectors.where((F.size(x) == size) & F.coalesce(finite, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), whole.alias("w"), x.alias("x"))
    large = F.exists("x", lambda e: F.abs(e.cast("double") * SCALE) >= float(LARGEST))
    checked = F.when(large, F.raise_error(F.lit("a vector component is too large for exact 64-bit distances")).cast(
        "array<int>")).otherwise(F.transform("w", lambda e: e.cast("int")))
    return kept.select("vec_id", checked.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to rows of ``b``, or to one vector."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(sample: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """Farthest-first rows of ``sample``; equal rows are chosen once."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = squared(sample, sample[0])
    while len(chosen) < number and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(sample, sample[chosen[-1]]))
    return sample[chosen]


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """(p, s, distance); the distance is rounded up."""
    return [(p, s, float(np.sqrt(float(squared(pivots[p:p + 1], pivots[s])[0]))) * (1 + EPS))
            for p, s in combinations(range(len(pivots)), 2)]


def lower_bounds(to_pivots: np.ndarray, centre: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """Lower bounds of the squared distances of vectors to one centroid, from
    the pivot distances of both (not squared)."""
    best = np.zeros(len(to_pivots))
    for p, s, gap in pairs:
        a, b = to_pivots[:, p] * centre[s], to_pivots[:, s] * centre[p]
        np.maximum(best, (np.abs(a - b) - EPS * (a + b)) / gap, out=best)
    return best * best * (1 - EPS)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, centre_pivots: np.ndarray,
            pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of each row of ``v`` (ties: smaller
    number), and how many distances were computed."""
    n = len(v)
    bounds = np.stack([lower_bounds(to_pivots, c, pairs) for c in centre_pivots])
    cluster = bounds.argmin(axis=0)
    distance = squared(v, centres[cluster])
    first, measured = cluster.copy(), n
    for j, centre in enumerate(centres):
        # A float of an exact distance may be rounded down by a unit: a tie must survive.
        at = np.flatnonzero((bounds[j] <= distance * (1 + EPS)) & (first != j))
        measured += len(at)
        d = squared(v[at], centre)
        better = (d < distance[at]) | ((d == distance[at]) & (j < cluster[at]))
        distance[at[better]], cluster[at[better]] = d[better], j
    return cluster, distance, measured


def _pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype(np.float64))


class PtolemyKMeans:
    """``centres`` after ``fit``; all state on the driver is k x size numbers."""

    def __init__(self, vectors: DataFrame, k: int, seed: int, size: int = 64, id_col: str = "vec_id",
                 vector_col: str = "embedding"):
        own = materialise(integer_vectors(vectors, id_col, vector_col, size))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)

        def least(number: int) -> list:
            return own.withColumn("h", order).orderBy(F.asc_nulls_last("h"), "v").limit(number).collect()

        self.size = size
        self.pivots = choose_pivots(self._rows(least(PIVOT_SAMPLE)))
        self.pairs = pivot_pairs(self.pivots)
        self.centres = self._rows(least(k))
        self.cached = materialise(self._with_pivots(own)) if len(self.pivots) else None

    def _rows(self, rows: list) -> np.ndarray:
        return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), self.size)

    def _with_pivots(self, own: DataFrame) -> DataFrame:
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = _pivot_distances(_matrix(b.column(1)), pivots)
                    lists = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), far.ravel())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["vec_id", "v", "far"])

        return own.mapInArrow(run, "vec_id long, v array<int>, far array<double>")

    def _batches(self, batches: Iterator[pa.RecordBatch]):
        """(ids, vectors, cluster, distance, measured) of blocks of rows."""
        centre_pivots = _pivot_distances(self.centres, self.pivots)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                part = b.slice(lo, BATCH)
                v = _matrix(part.column(1))
                far = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                yield part.column(0), v, *nearest(v, far, self.centres, centre_pivots, self.pairs)

    def _task(self) -> PtolemyKMeans:
        """What tasks need of this object: no DataFrame goes along."""
        t = object.__new__(PtolemyKMeans)
        t.size, t.pivots, t.pairs, t.centres = self.size, self.pivots, self.pairs, self.centres
        return t

    def step(self) -> int:
        """One round; returns how many distances it computed."""
        task, k, size = self._task(), len(self.centres), self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts, measured = np.zeros((k, size), np.int64), np.zeros(k, np.int64), 0
            for _, v, cluster, _, number in task._batches(batches):
                for j in range(k):
                    own = v[cluster == j]
                    sums[j] += own.sum(axis=0)
                    counts[j] += len(own)
                measured += number
            lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, size, dtype=np.int32), sums.ravel())
            spent = np.zeros(k, np.int64)
            spent[0] = measured
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), lists,
                                              pa.array(spent)], names=["cluster", "n", "sums", "measured"])

        parts = self.cached.mapInArrow(run, "cluster int, n long, sums array<long>, measured long")
        # A sum beyond 64 bits is an error of the aggregate, never a wrong centroid.
        total = parts.groupBy("cluster").agg(
            F.sum("n").alias("n"), F.sum("measured").alias("measured"),
            *[F.expr(f"cast(sum(cast(sums[{i}] as decimal(38, 0))) as string)").alias(f"s{i}") for i in range(size)])
        rows = total.collect()  # one per cluster
        centres = self.centres.copy()
        for r in rows:
            if r["n"]:
                centres[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
        self.centres = centres
        return sum(r["measured"] for r in rows)

    def fit(self, rounds: int) -> PtolemyKMeans:
        for _ in range(rounds if self.cached is not None else 0):
            self.step()
        return self

    def assign(self) -> DataFrame:
        """vec_id, cluster, distance (squared)."""
        task = self._task()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, _, cluster, distance, _ in task._batches(batches):
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

        return self.cached.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, size: int = 64,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    model = PtolemyKMeans(vectors, k, seed, size, id_col, vector_col).fit(rounds)
    spark = vectors.sparkSession
    if model.cached is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    assigned = materialise(model.assign())
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashes = spark.createDataFrame(
        [(j, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for j, c in enumerate(model.centres)],
        "cluster int, centroid_sha256 string")
    # One row per cluster on both sides.
    table = own.join(F.broadcast(hashes), "cluster").crossJoin(
        F.broadcast(assigned.agg(F.sum("distance").alias("inertia"))))
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
