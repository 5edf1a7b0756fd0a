"""More rows of a rare class, between rows that are there and near neighbours of theirs.

The nearest neighbours are those of an exact search by Euclidean distance over the rare class alone. Which row a new one begins at, which neighbour it goes
towards and how far are hashes of the row's key and the new row's number, so they are the same on every run; rows share new ones evenly.

Defined cases: keys are unique; rows of the rare class need all features (finite), else they are no base and no neighbour; equal rows are neighbours of each other; with fewer than two
such rows, or none to add, nothing is added; a null target is no class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import vector_index
from riskweave.operators.ranking import running
from riskweave.sources.caches import cut


def wanted_rows(rare: int, others: int, most: float = 0.15, times: float = 3.0, least_rows: int = 5) -> int:
    """How many rows to add so that the rare class is min(most, times * its share) of the others' number; 0 with fewer than least_rows of it, or if it is
    more than two thirds of the way there."""
    share = rare / (rare + others) if rare + others else 0.0
    ratio = min(most, times * share)
    return max(0, int(ratio * others) - rare) if rare >= least_rows and ratio > 1.5 * share else 0


def neighbours(rows: DataFrame, key: str, vector: str, dim: int, k: int) -> DataFrame:
    """key and near (the vectors of its k nearest other rows, nearest first; of equal distances the smaller key)."""
    cases = rows.select(F.col(key).alias("case_id"), F.col(vector).alias("embedding"), F.lit(None).cast("long").alias("company"), F.lit(None).cast("date").alias("publish_date"))
    index = vector_index.build(cases, dim, metric="euclidean")
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("embedding").alias("query"), F.lit(None).cast("long").alias("asking"), F.lit(None).cast("date").alias("as_of"))
    found, _ = vector_index.search(index, asked, k)
    of = rows.select(F.col(key).alias("case_id"), F.col(vector).alias("v"))
    return found.join(of, "case_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("n")).select(F.col("query_id").alias(key), F.col("n.v").alias("near"))


def _hash(*parts) -> F.Column:
    """A hash that is not negative."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(2**63 - 1))


def synthetic(rows: DataFrame, key: str, features: list[str], target: str, n: int | None = None, k: int = 5, rare: int = 1) -> DataFrame:
    """base (the key that a new row begins at), number (of the base's new rows, from 1), features and target of `n` new rows (by default wanted_rows)."""
    values = F.array(*[F.col(f).cast("double") for f in features])
    own = cut(rows.where(F.col(target) == rare).select(key, values.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    held = own.count()
    if n is None:
        n = wanted_rows(held, rows.where(F.col(target) != rare).count())
    n = n if held > 1 else 0
    near = neighbours(own.limit(0) if n == 0 else own, key, "v", len(features), min(k, max(held - 1, 1)))
    each, more = divmod(n, max(held, 1))
    order = (_hash(F.col(key).cast("string")) % F.lit(2**53)).cast("double").alias("score")
    placed = running(own.select(key, "v", order), {"place": F.lit(1)}, [F.desc("score"), F.asc(key)])
    bases = placed.withColumn("times", F.lit(each) + (F.col("place") <= more).cast("int")).where("times > 0")
    made = bases.join(near, key).select(key, "v", "near", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("number"))
    name = (F.col(key).cast("string"), F.col("number"))
    to = F.element_at("near", (_hash(*name, F.lit("neighbour")) % F.size("near") + 1).cast("int"))
    far = (_hash(*name, F.lit("far")) % F.lit(2**53)) / F.lit(float(2**53))
    made = made.select(key, "number", F.zip_with("v", to, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("ab"), far.alias("far"))
    made = made.withColumn("new", F.transform("ab", lambda x: x["a"] + (x["b"] - x["a"]) * F.col("far")))
    return made.select(F.col(key).alias("base"), "number", *[F.col("new")[i].alias(f) for i, f in enumerate(features)], F.lit(rare).cast(dict(rows.dtypes)[target]).alias(target))


def oversampled(rows: DataFrame, key: str, features: list[str], target: str, k: int = 5) -> DataFrame:
    """features and target of rows (those with a target) and of the new ones, with `synthetic` and a key for both (base:number for new ones)."""
    new = synthetic(rows, key, features, target, k=k)
    old = rows.where(F.col(target).isNotNull()).select(F.col(key).cast("string").alias(key), *features, target, F.lit(False).alias("synthetic"))
    return old.unionByName(new.select(F.concat_ws(":", F.col("base").cast("string"), "number").alias(key), *features, target, F.lit(True).alias("synthetic")))
