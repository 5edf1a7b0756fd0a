"""k-means whose clusters are balls, so that most vectors are compared with few centroids or none. Results are those of comparing all with all.

Each pass over the vectors works on a ball for every cluster: its centroid, and as radius the largest distance of its members (those that a task has at
once; they lie inside the whole cluster's ball). Only centroids nearer than twice the radius are neighbours. A member nearer to its
centroid than half of the way to the nearest neighbour is in the stable core and stays. The others lie in annuli: beyond half of the way to
the a-th nearest neighbour but not to the next, so the first a neighbours alone are compared exactly. All numbers are whole, so are the tests (four times
the squared distance against the squared distance of centroids), and ties go to the smaller number. A first pass has no balls and compares all.

A pass reads the vectors with their clusters and writes them with the new ones to the shared folder, so a lost executor costs one task of one
pass; beside them each task writes its clusters' sums, and what the driver gets are k sums. Nothing is shuffled but these. Passes end when no centroid moves.

Defined cases: vectors of another length than `dim`, or with null or non-finite components, are left out, null ones too; components must be
below 2^26 after scaling, else squared distances need not fit 64 bits and the job stops; equal vectors share a cluster; rows that repeat count as often as they are there;
a null id hashes as "null"; ties for the first centroids go to the smaller vector; with fewer vectors than k there are as many centroids; an
empty table gives an empty result; columns other than id and vector are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import cut, forget

_LARGEST = 1 << 26


@dataclass(frozen=True)
class Clustering:
    """rows: id, vector (whole numbers), cluster, distance; by cluster: centroid, members, sum of distances, squared radius; passes that were made;
    compared: distances to centroids that the passes worked out, and how many without balls."""

    rows: DataFrame
    centroids: list[list[int]]
    members: list[int]
    inertia: list[int]
    radius: list[int]
    passes: int
    compared: tuple[int, int]


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """id and vector (floor(scale * component)) of the rows whose vector has `dim` finite components."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = table.where((F.size(vector_col) == dim) & finite)
    near = lambda c: F.when(F.abs(c) < _LARGEST, F.floor(c).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return kept.select(F.col(id_col).alias("id"), F.transform(x, lambda c: near(scale * c)).alias("vector"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose `salt:id` has the smallest SHA-256."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
    return [r["vector"] for r in vectors.select(name.alias("name"), "vector").orderBy("name", "vector").limit(k).collect()]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, own: np.ndarray | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance, and how many distances were worked out. own: its cluster so far."""
    if own is None:
        every = np.stack([squared(x, c) for c in centroids], axis=1)
        best = every.argmin(axis=1)  # the first of equals
        return best, every[np.arange(len(x)), best], every.size
    ways = np.stack([squared(centroids, c) for c in centroids])  # between centroids
    distance = squared(x, centroids[own])
    best, least, compared = own.copy(), distance.copy(), len(x)
    for i in range(len(centroids)):
        members = np.flatnonzero(own == i)
        if not len(members):
            continue
        radius = int(distance[members].max())
        order = np.argsort(ways[i], kind="stable")
        neighbours = [int(j) for j in order if j != i and ways[i, j] <= 4 * radius]
        halves = ways[i, neighbours]
        ring = np.searchsorted(halves, 4 * distance[members], side="right")  # 0: the stable core; a: the a nearest may be nearer
        for a, j in enumerate(neighbours):
            inside = members[ring > a]
            d = squared(x[inside], centroids[j])
            compared += len(inside)
            closer = (d < least[inside]) | ((d == least[inside]) & (j < best[inside]))
            best[inside[closer]], least[inside[closer]] = j, d[closer]
    return best, least, compared


def _pass(state: DataFrame, centroids: list[list[int]], first: bool) -> DataFrame:
    """The rows (kind 0) with new clusters, and each task's sums (kind 1: cluster, members, inertia, radius, compared, sums), as a written table."""
    fixed = np.array(centroids, np.int64)

    def run(batches):
        import pyarrow as pa

        k, dim = fixed.shape
        n, inertia, radius, sums, compared = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        empty = pa.nulls(0, pa.list_(pa.int64()))

        def batch(kind, ids, vectors, clusters, distances, members, totals):
            size = len(clusters)
            return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), ids, vectors, pa.array(clusters, pa.int32()), pa.array(distances, pa.int64()), members, totals], names=["kind", "id", "vector", "cluster", "distance", "counts", "sums"])

        kinds = None
        for part in batches:
            kinds = part.schema
            if not part.num_rows:
                continue
            vectors = part.column(1)
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, dim)
            own = None if first else part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            best, least, made = assign(x, own, fixed)
            compared += made
            n += np.bincount(best, minlength=k)
            for i in range(k):
                mine = best == i
                sums[i] += x[mine].sum(axis=0)
                inertia[i] += least[mine].sum()
                radius[i] = max(radius[i], least[mine].max(initial=0))
            none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
            yield batch(0, part.column(0), vectors, best, least, none, none)
        if kinds is not None:
            counts = [[int(a), int(b), int(c), compared if not i else 0] for i, (a, b, c) in enumerate(zip(n, inertia, radius, strict=True))]
            yield batch(1, pa.nulls(k, kinds.field(0).type), pa.nulls(k, kinds.field(1).type), range(k), [0] * k, pa.array(counts, empty.type), pa.array(sums.tolist(), empty.type))

    kind = dict(state.dtypes)["id"]
    columns = ["id", "vector"] if first else ["id", "vector", "cluster"]
    rows = state.select(*columns).mapInArrow(run, f"kind int, id {kind}, vector array<int>, cluster int, distance long, counts array<long>, sums array<long>")
    return cut(rows, ("kind",))


def _totals(table: DataFrame, k: int) -> tuple[list, list[list[int]]]:
    """members, inertia, radius and comparisons, and sums of vectors, of each of the k clusters."""
    own = table.where("kind = 1")
    c, s = F.col("counts"), F.posexplode("sums").alias("at", "x")
    counts = {r["cluster"]: r for r in own.groupBy("cluster").agg(F.sum(c[0]).alias("n"), F.sum(c[1]).alias("inertia"), F.max(c[2]).alias("radius"), F.sum(c[3]).alias("compared")).collect()}
    sums: list[dict] = [{} for _ in range(k)]
    for r in own.select("cluster", s).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():  # k vectors
        sums[r["cluster"]][r["at"]] = r["x"]
    return [counts[i] for i in range(k)], [[found[j] for j in range(len(found))] for found in sums]


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "3") -> Clustering:
    """k-means of whole_vectors from first_centroids: `rounds` times each vector goes to the nearest centroid and each centroid that has vectors to
    the floor of their mean; then vectors are assigned once more."""
    state = cut(whole_vectors(table, id_col, vector_col, dim, scale))
    centroids = first_centroids(state, k, salt)
    if not centroids:
        return Clustering(state.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), [], [], [], [], 0, (0, 0))
    compared = whole = 0
    for done in range(rounds + 1):
        new = _pass(state, centroids, first=done == 0)
        forget(state)
        state = new.where("kind = 0").select("id", "vector", "cluster", "distance")
        state.cut_path = new.cut_path
        counts, sums = _totals(new, len(centroids))
        compared += sum(c["compared"] for c in counts)
        whole += sum(c["n"] for c in counts) * len(centroids)
        moved = [[x // c["n"] for x in s] if c["n"] else old for c, s, old in zip(counts, sums, centroids, strict=True)]
        if done == rounds or moved == centroids:  # what comes would be the same
            break
        centroids = moved
    return Clustering(state, centroids, *[[c[x] for c in counts] for x in ("n", "inertia", "radius")], done + 1, (compared, whole))


def summary(found: Clustering, id_col: str = "vec_id") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1).cast(kind) if values else F.lit(None).cast(kind)
    return found.rows.select(
        F.col("id").alias(id_col), "cluster", "distance", of(found.inertia, "long").alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), of(shas, "string").alias("centroid_sha256")
    )
