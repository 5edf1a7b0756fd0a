"""Feature selection, oversampling, an ensemble of three tree models, and what each feature gives to its predictions.

The legs are Spark's random forest and two second-order boosted models (see boosting): grown by the best leaf, and level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.numeric import risk_level
from riskweave.operators import boosting, oversampling, tree_contributions
from riskweave.operators.boosting import DEPTH_WISE, LEAF_WISE, Boosted, Growth
from riskweave.operators.scoring import best_f1, ensemble, top_contributions
from riskweave.sources.caches import cut, forget

#: What a node of a boosted tree has.
_NODE = ("feature", "threshold", "missing_left", "left", "right", "value", "cover", "gain", "bin")
LEGS = {"p_forest": 0.30, "p_leafwise": 0.35, "p_depthwise": 0.35}


def varying(rows: DataFrame, features: list[str], least: float = 1e-12) -> list[str]:
    """Features whose variance is not near zero; one row of aggregates."""
    found = rows.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    return [f for f in features if (found[f] or 0.0) >= least]


def uncorrelated(rows: DataFrame, features: list[str], most: float = 0.95) -> list[str]:
    """Features that no earlier kept feature is correlated with beyond `most`; missing values count as the mean. One pass sums all pairs
    as a matrix of features by features, so hundreds of features make no long expressions."""
    if len(features) < 2:
        return features
    filled = [f"{f}__filled" for f in features]
    whole = Imputer(inputCols=features, outputCols=filled).fit(rows).transform(rows)
    vectors = VectorAssembler(inputCols=filled, outputCol="__v").transform(whole)
    matrix = abs(Correlation.corr(vectors, "__v").first()[0].toArray())
    kept: list[int] = []
    for j in range(len(features)):
        if not any(matrix[i, j] > most for i in kept):
            kept.append(j)
    return [features[j] for j in kept]


def important(rows: DataFrame, features: list[str], target: str, rounds: int = 200, depth: int = 5, rate: float = 0.05) -> list[str]:
    """Features that a first boosted model, which weights the rare class up, splits on at all."""
    growth = Growth(rounds=rounds, depth=depth, leaves=31, rate=rate, rows=1.0, columns=1.0, l1=0.0, l2=0.0)
    model = boosting.boost(balanced(rows, target), features, target, growth=growth, weight="weight")
    return [f for f, gain in model.importance().items() if gain > 0]


def balanced(rows: DataFrame, target: str) -> DataFrame:
    """rows with weights that give both classes the same total."""
    share = rows.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    share = min(max(share, 1e-6), 1 - 1e-6)
    return rows.withColumn("weight", F.when(F.col(target) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))


@dataclass(frozen=True)
class Sizes:
    """How large the models are. rounds: of each boosted leg."""

    trees: int = 400
    depth: int = 12
    least_rows: int = 5
    rounds: int = 800
    screening: int = 200
    rate: float = 0.03


@dataclass(frozen=True)
class Ensemble:
    """features; means that stand for missing values; a fitted forest and two boosted models; the threshold of the probability (0.5 without validation rows)."""

    features: list[str]
    means: dict[str, float]
    forest: RandomForestClassificationModel
    leafwise: Boosted
    depthwise: Boosted
    threshold: float = 0.5


def filled(rows: DataFrame, features: list[str], means: dict[str, float]) -> DataFrame:
    """rows with doubles as features, the means in place of missing ones."""
    return rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float(means[f]))) for f in features})


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="__features")


def train(rows: DataFrame, features: list[str], target: str, key: str, sizes: Sizes = Sizes(), seed: int = 42) -> Ensemble:
    """The three legs for a target of 0 and 1, on rows with a unique key. Where the positive class is rare, rows between neighbours of it are added
    (see oversampling); else the boosted legs weight it up (level by level five times as much). The forest gives both classes the same weight. Boosting rounds
    come one after the other, with a pass over the binned rows for each level."""
    found = rows.agg(*[F.avg(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))).alias(f) for f in features]).first()
    means = {f: found[f] or 0.0 for f in features}
    whole = cut(filled(rows.where(F.col(target).isNotNull()), features, means).select(key, *features, target))
    more = cut(oversampling.oversampled(whole, key, features, target))
    counts = {(r[target], r["synthetic"]): r["count"] for r in more.groupBy(target, "synthetic").count().collect()}
    share = counts.get((1, False), 0) / max(sum(n for (_, new), n in counts.items() if not new), 1)
    odds = 1.0 if (1, True) in counts else (1 - share) / max(share, 1e-6)
    weighed = lambda w: more.withColumn("weight", F.when(F.col(target) == 1, F.lit(w)).otherwise(1.0))
    grown = lambda g: replace(g, rounds=sizes.rounds, rate=sizes.rate, seed=seed)
    leafwise = boosting.boost(weighed(odds), features, target, [key], grown(LEAF_WISE), "weight")
    depthwise = boosting.boost(weighed(odds if odds == 1.0 else odds * 5.0), features, target, [key], grown(DEPTH_WISE), "weight")
    forest = RandomForestClassifier(featuresCol="__features", labelCol=target, weightCol="weight", numTrees=sizes.trees, maxDepth=sizes.depth, minInstancesPerNode=sizes.least_rows, seed=seed)
    fitted = forest.fit(_assembler(features).transform(balanced(more, target)))
    for table in (whole, more):
        forget(table)
    return Ensemble(list(features), means, fitted, leafwise, depthwise)


def probabilities(rows: DataFrame, model: Ensemble) -> DataFrame:
    """rows with each leg's probability, the ensemble's, its level and confidence, and whether it reaches the threshold. Missing features count as the mean."""
    out = filled(rows, model.features, model.means)
    out = model.forest.transform(_assembler(model.features).transform(out)).withColumn("p_forest", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")
    out = boosting.with_probability(boosting.with_probability(out, model.leafwise, "p_leafwise"), model.depthwise, "p_depthwise")
    p = ensemble(LEGS)
    return out.withColumns({"probability": p, "level": risk_level(p), "confidence": F.round(F.greatest(p, 1 - p), 4), "positive": p >= model.threshold})


def with_threshold(model: Ensemble, validation: DataFrame, target: str) -> Ensemble:
    """The model with the threshold of the largest F1 on validation rows."""
    scores = probabilities(validation, model).select(F.col("probability").alias("score"), F.col(target).cast("long").alias("target"))
    best = best_f1(scores.where("target IS NOT NULL")).first()
    return replace(model, threshold=best["threshold"]) if best and best["f1"] else model


def explain(rows: DataFrame, model: Ensemble, k: int = 5, least: float = 0.05) -> DataFrame:
    """rows with the k largest contributions of `least` and more: those of the forest to its probability and of the boosted legs to their margins, with the
    weights of the legs. Missing features count as the mean."""
    forest = tree_contributions.explained(model.features, tree_contributions.forest_trees(model.forest, rows.sparkSession))
    legs = [forest, tree_contributions.of_boosted(model.leafwise), tree_contributions.of_boosted(model.depthwise)]
    out = tree_contributions.with_contributions(filled(rows, model.features, model.means), list(zip(legs, LEGS.values(), strict=True)))
    return out.withColumn("contributions", top_contributions(F.col("contributions"), k, least))


def select_features(rows: DataFrame, features: list[str], target: str, sizes: Sizes = Sizes(), distinct: list[str] | None = None) -> list[str]:
    """Features that vary, no two of which say the same (`distinct`, if these are known), and that a first model uses."""
    kept = uncorrelated(rows, varying(rows, features)) if distinct is None else distinct
    return important(rows, kept, target, rounds=sizes.screening) or kept


def train_horizons(rows: DataFrame, features: list[str], targets: list[str], key: str, sizes: Sizes = Sizes()) -> dict[str, Ensemble]:
    """One ensemble for each target, from rows whose `split` is train, with the threshold from those of split val. Rows whose target is null or below 0
    have none."""
    out = {}
    past = cut(rows.where("split = 'train'"))
    whole = past.agg(F.count("*"), *[F.count_if(F.col(t) >= 0) for t in targets]).first()
    distinct = uncorrelated(past, varying(past, features)) if len({*whole}) == 1 else None  # all targets have the same rows
    for target in targets:
        own = past.where(F.col(target) >= 0)
        kept = select_features(own, features, target, sizes, distinct)
        out[target] = with_threshold(train(own, kept, target, key, sizes), rows.where((F.col(target) >= 0) & (F.col("split") == "val")), target)
    forget(past)
    return out


def write_ensemble(model: Ensemble, spark: SparkSession, path: str) -> None:
    """The forest in Spark's own form, the boosted trees as a table of nodes, and one row about the rest."""
    model.forest.write().overwrite().save(f"{path}/forest")
    nodes = []
    for leg, boosted in (("leafwise", model.leafwise), ("depthwise", model.depthwise)):
        for t, tree in enumerate(boosted.trees):
            columns = [getattr(tree, f).tolist() for f in _NODE]
            nodes += [(leg, t, n, *values) for n, values in enumerate(zip(*columns, strict=True))]
    kinds = {"feature": "long", "left": "long", "right": "long", "bin": "long", "missing_left": "boolean"}
    schema = ", ".join(["leg string, tree int, node int", *[f"`{f}` {kinds.get(f, 'double')}" for f in _NODE]])
    spark.createDataFrame(nodes, schema).write.mode("overwrite").parquet(f"{path}/nodes")
    about = [(model.features, [model.means[f] for f in model.features], model.leafwise.base, model.depthwise.base, model.threshold)]
    spark.createDataFrame(about, "features array<string>, means array<double>, leafwise double, depthwise double, threshold double").write.mode("overwrite").parquet(f"{path}/about")


def read_ensemble(spark: SparkSession, path: str) -> Ensemble:
    """What write_ensemble has written; as large as the models."""
    about = spark.read.parquet(f"{path}/about").first()
    by: dict[str, dict[int, list]] = {"leafwise": {}, "depthwise": {}}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("leg", "tree", "node").collect():
        by[r["leg"]].setdefault(r["tree"], []).append(r)
    tree = lambda rows: boosting.Tree(**{f: np.array([r[f] for r in rows]) for f in _NODE})
    legs = [Boosted(list(about["features"]), about[leg], [tree(rows) for rows in trees.values()]) for leg, trees in by.items()]
    means = dict(zip(about["features"], about["means"], strict=True))
    return Ensemble(list(about["features"]), means, RandomForestClassificationModel.load(f"{path}/forest"), *legs, about["threshold"])
