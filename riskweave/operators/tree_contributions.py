"""Exact contributions of features to the predictions of tree models: Shapley values in which a feature that is not known is averaged over by the
training weight of both branches.

For each leaf the features on its path count, each with whether a row satisfies all of its conditions there (o) and the share of weight that goes the leaf's
way at its cuts (z). What a feature gives is the leaf's value times (o - z) times the sum, over sets of the other features, of the set's weight times the
o's inside and z's outside, which is a polynomial. It depends on the pattern of o alone, so a path of up to 10 features is a table of patterns that is
made once, and of longer paths only the patterns that occur are worked out. Rows come in Arrow batches; models are as large as they are, not as the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.boosting import Boosted, Tree, matrix
from riskweave.sources.caches import shared_folder

_TABLE = 10


@dataclass(frozen=True)
class Path:
    """A leaf's features, the range (low, high] of each, whether missing values go its way, z, and the leaf's value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    z: np.ndarray
    value: float

    def of(self, patterns: np.ndarray) -> np.ndarray:
        """Contributions of the path's features for rows of o (0 or 1)."""
        n, m = patterns.shape
        weight = np.array([factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)])
        out = np.empty((n, m))
        for j in range(m):
            sums = np.ones((n, 1))
            for k in range(m):
                if k != j:
                    longer = np.zeros((n, sums.shape[1] + 1))
                    longer[:, :-1] += sums * self.z[k]
                    longer[:, 1:] += sums * patterns[:, k : k + 1]
                    sums = longer
            out[:, j] = self.value * (patterns[:, j] - self.z[j]) * (sums @ weight)
        return out

    @cached_property
    def table(self) -> np.ndarray:
        m = len(self.features)
        return self.of((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(np.float64))

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        m = len(self.features)
        v = x[:, self.features]
        met = np.where(np.isnan(v), self.missing, (v > self.low) & (v <= self.high))
        code = met @ (1 << np.arange(m))
        if m <= _TABLE:
            out[:, self.features] += self.table[code]
        else:
            _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            out[:, self.features] += self.of(met[first].astype(np.float64))[inverse]


def paths(tree: Tree) -> tuple[list[Path], float]:
    """The paths of a tree's leaves, and the prediction that it makes without knowing any feature."""
    found, expected = [], 0.0
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        n, known = stack.pop()
        if tree.feature[n] < 0:
            z = np.array([k[3] for k in known.values()])
            expected += tree.value[n] * (z.prod() if len(z) else 1.0)
            if known:
                columns = [np.array([k[i] for k in known.values()]) for i in range(3)]
                found.append(Path(np.array(list(known), np.int64), *columns, z, float(tree.value[n])))
            continue
        f, t = int(tree.feature[n]), float(tree.threshold[n])
        low, high, missing, z = known.get(f, (-np.inf, np.inf, True, 1.0))
        for child, is_left in ((int(tree.left[n]), True), (int(tree.right[n]), False)):
            share = tree.cover[child] / tree.cover[n] if tree.cover[n] > 0 else 0.0
            span = (low, min(high, t)) if is_left else (max(low, t), high)
            stack.append((child, {**known, f: (*span, missing and bool(tree.missing_left[n]) == is_left, z * share)}))
    return found, expected


@dataclass(frozen=True)
class Explained:
    """Contributions of several trees: their paths, and what all give without knowing any feature."""

    features: list[str]
    paths: list[Path]
    expected: float

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.features)))
        for p in self.paths:
            p.add_to(out, x)
        return out


def explained(features: list[str], trees: list[Tree], base: float = 0.0) -> Explained:
    every, expected = [], base
    for t in trees:
        own, e = paths(t)
        every += own
        expected += e
    return Explained(list(features), every, expected)


def of_boosted(model: Boosted) -> Explained:
    """Contributions to the margin."""
    return explained(model.features, model.trees, model.base)


def forest_trees(model, spark) -> list[Tree]:
    """The trees of a fitted random forest for two classes, as Spark's own files have them, with each tree's share of the probability as values."""
    path = f"{shared_folder(spark)}/forest-{model.uid}"
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # as large as the model
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["treeID"], []).append(r)
    out = []
    for nodes in by.values():
        at = {r["id"]: i for i, r in enumerate(nodes)}
        inner = [r["leftChild"] >= 0 for r in nodes]
        cover = np.array([sum(r["impurityStats"]) for r in nodes])
        share = np.array([r["impurityStats"][1] / (sum(r["impurityStats"]) or 1.0) for r in nodes]) / len(by)
        pick = lambda get, none: np.array([get(r) if i else none for r, i in zip(nodes, inner, strict=True)])  # noqa: E731, B023
        out.append(Tree(
            pick(lambda r: r["split"]["featureIndex"], -1), pick(lambda r: r["split"]["leftCategoriesOrThreshold"][0], 0.0), np.zeros(len(nodes), bool),
            pick(lambda r: at[r["leftChild"]], -1), pick(lambda r: at[r["rightChild"]], -1), np.where(inner, 0.0, share), cover, pick(lambda r: r["gain"], 0.0),  # noqa: B023
        ))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def with_contributions(rows: DataFrame, legs: list[tuple[Explained, float]], name: str = "contributions") -> DataFrame:
    """rows with array<struct<name,value>> of every feature's contribution, summed over legs with their weights. All legs have the same features, columns of rows."""
    features, carried = legs[0][0].features, rows.columns
    own = [f"__x{i}" for i in range(len(features))]

    def run(batches):
        import pyarrow as pa

        for part in batches:
            x = matrix(part.columns[len(carried) :])
            total = sum(w * leg.contributions(x) for leg, w in legs)
            values = pa.StructArray.from_arrays([pa.array(list(features) * len(x), pa.string()), pa.array(total.ravel(), pa.float64())], names=["name", "value"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(features), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], lists], names=[*carried, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{name}` array<struct<name:string,value:double>>"])
    return rows.select(*carried, *[F.col(f).cast("double").alias(c) for f, c in zip(features, own, strict=True)]).mapInArrow(run, schema)
