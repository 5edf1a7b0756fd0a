"""Boosted trees, contributions of features, oversampling and the ensemble of three legs, held against plain versions."""

import math
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import boosting, modeling, oversampling, tree_contributions
from riskweave.operators.boosting import DEPTH_WISE, LEAF_WISE, Growth, Tree


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """1,500 rows of five features with gaps, a target that depends on three of them, and weights."""
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 5)).round(2)
    z = 1.5 * x[:, 0] - x[:, 1] * x[:, 2] + (x[:, 3] > 0.5) - 0.5
    y = (r.random(1500) < 1 / (1 + np.exp(-z))).astype(int)
    x[r.random(x.shape) < 0.05] = np.nan
    rows = [(i, *[None if math.isnan(v) else float(v) for v in x[i]], int(y[i]), 1.0 + i % 3) for i in range(1500)]
    path = str(tmp_path_factory.mktemp("sample") / "rows")
    spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y int, w double").repartition(3).write.parquet(path)
    return spark.read.parquet(path), x, y, 1.0 + np.arange(1500) % 3


def slow_tree(x, g, h, w, growth, cuts):
    """One tree by trying every cut at every node, always the open node of the largest gain first."""
    soft = lambda v: math.copysign(max(abs(v) - growth.l1, 0), v)
    worth = lambda v, u: soft(v) ** 2 / (u + growth.l2 + 1e-12)

    def best(rows):
        top = (1e-9, None)
        for f in range(x.shape[1]):
            v = x[rows, f]
            for c in cuts[f]:
                for missing_left in (False, True):
                    left = np.where(np.isnan(v), missing_left, v <= c)
                    sides = [rows[left], rows[~left]]
                    if all(len(s) >= growth.least_rows and h[s].sum() >= growth.least_hessian for s in sides):
                        gain = sum(worth(g[s].sum(), h[s].sum()) for s in sides) - worth(g[rows].sum(), h[rows].sum())
                        if gain > top[0] + 1e-9:
                            top = (gain, sides)
        return top

    out = np.zeros(len(x))
    opened = [(*best(np.arange(len(x))), 0, np.arange(len(x)))]
    leaves = 1
    while leaves < (growth.leaves or 1 << 30):
        ready = [o for o in opened if o[1] and o[2] < growth.depth]
        if not ready:
            break
        node = max(ready, key=lambda o: o[0])
        opened = [o for o in opened if o is not node]
        opened += [(*best(s), node[2] + 1, s) for s in node[1]]
        leaves += 1
    for *_, rows in opened:
        out[rows] = -growth.rate * soft(g[rows].sum()) / (h[rows].sum() + growth.l2 + 1e-12)
    return out, leaves


@pytest.mark.parametrize("growth", [
    replace(LEAF_WISE, rounds=2, depth=4, leaves=6, rows=1.0, columns=1.0, rate=0.3), replace(DEPTH_WISE, rounds=2, depth=3, rows=1.0, columns=1.0, rate=0.3),
    Growth(rounds=3, depth=2, leaves=3, rows=1.0, columns=1.0, l1=2.0, l2=5.0, rate=0.5, keep=2, rows_at_once=600),  # several tasks
])
def test_trees_are_those_of_trying_every_cut(sample, growth):
    rows, x, y, w = sample
    model = boosting.boost(rows, list("abcde"), "y", ["id"], growth, "w")
    _, cuts = boosting.bin_rows(rows, list("abcde"), "y", ["id"], "w")
    margin = np.full(len(x), math.log((w * y).sum() / (w * (1 - y)).sum()))
    assert model.base == pytest.approx(margin[0]) and len(model.trees) == growth.rounds
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want, leaves = slow_tree(x, (p - y) * w, p * (1 - p) * w, w, growth, cuts)
        assert np.allclose(tree.value[tree.leaves(x)], want) and (tree.feature < 0).sum() >= leaves
        margin += want
    assert np.allclose(model.margins(x), margin)
    got = {r["id"]: r["p"] for r in boosting.with_probability(rows, model, "p").collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)))


def test_sampled_rounds_learn_and_repeat(sample):
    rows, x, y, _ = sample
    growth = replace(LEAF_WISE, rounds=12, rate=0.2, depth=4, leaves=12)
    one, two = (boosting.boost(r, list("abcde"), "y", ["id"], growth) for r in (rows, rows))
    assert np.allclose(one.margins(x), two.margins(x))
    rank = one.margins(x).argsort().argsort() + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.8 and max(one.importance(), key=one.importance().get) == "a" and max((t.feature < 0).sum() for t in one.trees) > 6
    drawn = boosting._drawn(np.arange(100_000) * 7919, 0.75, 42, 3)
    assert abs(drawn.mean() - 0.75) < 0.01 and (drawn != boosting._drawn(np.arange(100_000) * 7919, 0.75, 42, 4)).any()


def test_targets_of_one_class_and_empty_tables_have_no_trees_that_cut(spark, sample):
    rows = sample[0]
    for some in (rows.where("y = 1"), rows.limit(0)):
        model = boosting.boost(some, ["a", "b"], "y", ["id"], replace(LEAF_WISE, rounds=2))
        assert np.isfinite(model.margins(np.array([[0.0, np.nan]]))).all()
    flat = boosting.boost(rows.withColumn("a", F.lit(None).cast("double")), ["a"], "y", ["id"], replace(LEAF_WISE, rounds=2))
    assert flat.trees == []


def random_tree(r, features, depth):
    """A tree with random cuts, covers and values; features may come again on a path."""
    nodes = []

    def grow(d, cover):
        n = len(nodes)
        nodes.append(None)
        if d == 0 or r.random() < 0.2:
            nodes[n] = (-1, 0.0, False, -1, -1, float(r.normal()), cover)
        else:
            share = r.uniform(0.1, 0.9)
            left = grow(d - 1, cover * share)
            right = grow(d - 1, cover * (1 - share))
            nodes[n] = (int(r.integers(features)), round(float(r.normal()), 1), bool(r.random() < 0.5), left, right, 0.0, cover)
        return n

    grow(depth, 100.0)
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Tree(*columns, np.zeros(len(nodes)))


def slow_contributions(tree, x, features):
    """Shapley values over all sets of features, by their definition."""

    def value(n, known):
        if tree.feature[n] < 0:
            return tree.value[n]
        f = tree.feature[n]
        if f in known:
            left = tree.missing_left[n] if math.isnan(x[f]) else x[f] <= tree.threshold[n]
            return value(tree.left[n] if left else tree.right[n], known)
        return sum(tree.cover[c] / tree.cover[n] * value(c, known) for c in (tree.left[n], tree.right[n]))

    out = []
    for j in range(features):
        others = [k for k in range(features) if k != j]
        out.append(sum(
            math.factorial(len(s)) * math.factorial(features - len(s) - 1) / math.factorial(features) * (value(0, {*s, j}) - value(0, {*s}))
            for m in range(features) for s in combinations(others, m)
        ))
    return out, value(0, set())


def test_contributions_are_shapley_values(monkeypatch):
    r = np.random.default_rng(3)
    for table in (10, 0):  # by tables of patterns, and by the patterns that occur
        monkeypatch.setattr(tree_contributions, "_TABLE", table)
        for depth in (1, 2, 4, 6):
            trees = [random_tree(r, 5, depth) for _ in range(3)]
            x = r.normal(size=(12, 5)).round(1)
            x[r.random(x.shape) < 0.15] = np.nan
            model = tree_contributions.explained(list("abcde"), trees, 0.5)
            got = model.contributions(x)
            for i, row in enumerate(x):
                each = [slow_contributions(t, row, 5) for t in trees]
                assert np.allclose(got[i], np.sum([e[0] for e in each], axis=0)) and model.expected == pytest.approx(0.5 + sum(e[1] for e in each))
            assert np.allclose(got.sum(axis=1) + model.expected, 0.5 + sum(t.value[t.leaves(x)] for t in trees))


def test_long_paths_sum_to_the_prediction():
    r = np.random.default_rng(4)
    tree = random_tree(r, 40, 13)
    x = r.normal(size=(30, 40))
    model = tree_contributions.explained([f"f{i}" for i in range(40)], [tree])
    assert np.allclose(model.contributions(x).sum(axis=1) + model.expected, tree.value[tree.leaves(x)])


def points(spark, n=90, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in r.normal(size=3).round(2)], int(i % 9 == 0)) for i in range(n * 9)] + [(9001, [0.5, 0.5, 0.5], 1), (9002, [0.5, 0.5, 0.5], 1)]
    rows += [(9003, [math.nan, 1.0, 1.0], 1), (9004, [None, 1.0, 1.0], 1), (9005, [1.0, 1.0, 1.0], None)]
    flat = [(i, *v, y) for i, v, y in rows]
    return spark.createDataFrame(flat, "id long, a double, b double, c double, y int").repartition(4), {i: np.array(v) for i, v, y in rows if y == 1 and None not in v and not any(map(math.isnan, v))}


def test_neighbours_and_new_rows(spark):
    rows, rare = points(spark)
    near = {i: sorted((float(((v - u) ** 2).sum()), j) for j, u in rare.items() if j != i)[:5] for i, v in rare.items()}
    vectors = rows.where(F.col("id").isin([*rare])).select("id", F.array("a", "b", "c").alias("v"))
    got = {r["id"]: [tuple(v) for v in r["near"]] for r in oversampling.neighbours(vectors, "id", "v", 3, 5).collect()}
    assert got == {i: [tuple(rare[j]) for _, j in n] for i, n in near.items()}
    made = oversampling.synthetic(rows, "id", ["a", "b", "c"], "y", n=200).collect()
    again = oversampling.synthetic(rows.repartition(2), "id", ["a", "b", "c"], "y", n=200).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again)) and len(made) == 200 and {r["y"] for r in made} == {1}
    per = {}
    for r in made:
        per[r["base"]] = per.get(r["base"], 0) + 1
        new, base = np.array([r["a"], r["b"], r["c"]]), rare[r["base"]]
        ways = [rare[j] - base for _, j in near[r["base"]]]
        along = lambda w: np.allclose(new, base) if not w.any() else (0 <= (t := float((new - base) @ w / (w @ w))) < 1 and np.allclose(base + t * w, new))
        assert any(map(along, ways))
    assert {*per} == {*rare} and max(per.values()) - min(per.values()) == 1


def test_how_many_new_rows(spark):
    rows, rare = points(spark)
    assert oversampling.wanted_rows(100, 9900) == 197 and oversampling.wanted_rows(4, 996) == 0 and oversampling.wanted_rows(120, 880) == 0 and oversampling.wanted_rows(0, 0) == 0
    every = oversampling.oversampled(rows, "id", ["a", "b", "c"], "y")
    counts = {(r["y"], r["synthetic"]): r["count"] for r in every.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, False): 720, (1, False): 94} and every.select("id").distinct().count() == 814  # a share of 11 % is enough
    few = rows.where("y IS NULL OR y = 0 OR id % 27 = 0")
    more = oversampling.oversampled(few, "id", ["a", "b", "c"], "y").where("synthetic")
    assert more.count() == oversampling.wanted_rows(30, 720) == 56
    for odd in (rows.limit(0), rows.where("id = 9001"), rows.where("y IS NULL")):
        assert oversampling.synthetic(odd, "id", ["a", "b", "c"], "y", n=5).collect() == []


def test_an_ensemble_of_three_horizons(spark, sample, tmp_path):
    rows = sample[0].withColumns({"split": F.when(F.col("id") % 5 == 0, "val").when(F.col("id") % 5 == 1, "test").otherwise("train"), "same": F.lit(1.0), "twice": F.col("a") * 2})
    rows = rows.withColumns({"t30": F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("y")), "t60": (F.col("d") > 1.2).cast("int")})
    sizes = modeling.Sizes(trees=8, depth=5, rounds=6, screening=3, rate=0.3)
    models = modeling.train_horizons(rows, [*"abcde", "same", "twice"], ["t30", "t60"], "id", sizes)
    assert {*models} == {"t30", "t60"} and "same" not in models["t30"].features and "twice" not in models["t30"].features and models["t60"].features == ["d"]
    test = rows.where("split = 'test'")
    model = models["t30"]
    out = modeling.explain(modeling.probabilities(test, model), model, k=3, least=0.0).collect()
    assert len(out) == 300 and all(r["positive"] == (r["probability"] >= model.threshold) and len(r["contributions"]) == 3 for r in out)
    whole = modeling.explain(test, model, k=9, least=0.0).collect()
    by = {r["id"]: r for r in out}
    forest = tree_contributions.explained(model.features, tree_contributions.forest_trees(model.forest, spark))
    legs = [forest, tree_contributions.of_boosted(model.leafwise), tree_contributions.of_boosted(model.depthwise)]
    expected = sum(w * leg.expected for w, leg in zip(modeling.LEGS.values(), legs, strict=True))
    logit = lambda p: math.log(p / (1 - p))
    for r in whole:  # all contributions and what is expected without any feature sum to the legs' outputs
        p = by[r["id"]]
        want = 0.30 * p["p_forest"] + 0.35 * logit(p["p_leafwise"]) + 0.35 * logit(p["p_depthwise"])
        assert sum(c["value"] for c in r["contributions"]) + expected == pytest.approx(want)
    modeling.write_ensemble(model, spark, str(tmp_path / "model"))
    kept = modeling.read_ensemble(spark, str(tmp_path / "model"))
    assert kept.threshold == model.threshold and kept.features == model.features
    assert {r["id"]: r["probability"] for r in modeling.probabilities(test, kept).collect()} == pytest.approx({i: r["probability"] for i, r in by.items()})
