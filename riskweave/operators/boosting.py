"""Second-order boosting of trees by histograms, as passes over a table of binned rows.

Features are cut at quantiles into at most 254 bins, and each row's bins are written once, one byte for a feature. A pass over them grows all open nodes of a tree by
one level: tasks sum gradients and hessians by node, feature and bin; the sums are shuffled by feature, where the best cut of each node is found, with L1 and L2
terms and missing values on the better side; the driver gets one candidate for each node and part of the features. Growth to `leaves` leaves by the largest
gain (leaf-wise) needs no pass of its own: gains do not depend on the order of cuts, so levels are grown whole and the best are kept.

Rows of a tree are sampled by a hash of the row, its features by a hash of the tree's number; both are the same on every run. Margins are written
with the rows every `keep` trees; in between, tasks add up the trees since. A lost executor costs one task of one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.caches import cut, forget

MISSING = 255


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root is 0: feature (-1 in leaves), threshold (a value up to it goes left), missing_left, left, right, value (of leaves), cover
    (weight of the training rows) and gain."""

    feature: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    bin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def leaves(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The leaf of each row of values (NaN: missing) or bins."""
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        cuts = self.bin if binned else self.threshold
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return node
            v = x[rows, np.maximum(self.feature[node], 0)]
            gone = v == MISSING if binned else np.isnan(v)
            goes_left = np.where(gone, self.missing_left[node], v <= cuts[node])
            node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)


@dataclass(frozen=True)
class Boosted:
    """A margin is base plus the values of all trees; a probability its logistic function."""

    features: list[str]
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaves(x)]
        return out

    def importance(self) -> dict[str, float]:
        """Gain of each feature's cuts in all trees."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return dict(zip(self.features, total.tolist(), strict=True))


@dataclass(frozen=True)
class Growth:
    """How trees grow. leaves: None for all that levels give (depth-wise)."""

    rounds: int = 800
    depth: int = 7
    leaves: int | None = 63
    rate: float = 0.03
    rows: float = 0.75
    columns: float = 0.75
    l1: float = 0.1
    l2: float = 0.1
    least_rows: int = 20
    least_hessian: float = 1e-3
    seed: int = 42
    keep: int = 10
    rows_at_once: int = 100_000  # a pass has a task for so many rows


#: The two boosted learners of an ensemble: by the best leaf, and level by level.
LEAF_WISE = Growth()
DEPTH_WISE = Growth(depth=6, leaves=None, l2=1.0, least_rows=1, least_hessian=1.0)


def matrix(columns) -> np.ndarray:
    """Arrow columns of doubles as rows of values; null is NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]) if columns else np.zeros((0, 0))


def bin_rows(rows: DataFrame, features: list[str], target: str, keys: list[str], weight: str | None = None, bins: int = 254, rows_at_once: int = 100_000) -> tuple[DataFrame, list[np.ndarray]]:
    """key (a hash of the keys), y, w, margin (0) and bins of every row, as a written table; and the cuts of each feature."""
    shares = ", ".join(str(i / bins) for i in range(1, bins))
    known = rows.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, f in enumerate(features)])
    n, *found = known.agg(F.count("*"), *[F.expr(f"percentile_approx(f{i}, array({shares}), {10 * bins})") for i in range(len(features))]).first()
    cuts = [np.unique(np.array(q or [], np.float64)) for q in found]

    def run(batches):
        import pyarrow as pa

        for part in batches:
            n = part.num_rows
            x = matrix(part.columns[3:])
            out = np.full((n, len(cuts)), MISSING, np.uint8)
            for j, c in enumerate(cuts):
                good = ~np.isnan(x[:, j])
                out[good, j] = np.searchsorted(c, x[good, j], side="left")
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * len(cuts)).astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.zeros(n)), packed], names=["key", "y", "w", "margin", "bins"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = rows.select(F.xxhash64(*keys).alias("key"), F.col(target).cast("double").alias("y"), w.alias("w"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    return cut(flat.coalesce(n // rows_at_once + 1).mapInArrow(run, "key long, y double, w double, margin double, bins binary")), cuts


def _drawn(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Rows of a tree: those whose mixed hash falls below the share."""
    if share >= 1:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed * 1_000_003 + tree + 1)) % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) < np.uint64(int(share * 2**53))


def _soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _worth(g, h, growth: Growth):
    return _soft(g, growth.l1) ** 2 / (h + growth.l2 + 1e-12)


def best_cuts(sums: np.ndarray, growth: Growth) -> list[tuple]:
    """For each node of sums (node, bin, [gradient, hessian, rows, weight]) of one feature the best cut: gain, bin, whether missing values go left, and
    the left side's sums; gain 0 without one."""
    missing, known = sums[:, MISSING], sums[:, :MISSING]
    total = sums.sum(axis=1)
    left = known.cumsum(axis=1)
    best = []
    sides = [left[:, :-1], left[:, :-1] + missing[:, None]]
    gains = []
    for s in sides:
        other = total[:, None] - s
        fits = (s[..., 2] >= growth.least_rows) & (other[..., 2] >= growth.least_rows) & (s[..., 1] >= growth.least_hessian) & (other[..., 1] >= growth.least_hessian)
        gain = _worth(s[..., 0], s[..., 1], growth) + _worth(other[..., 0], other[..., 1], growth) - _worth(total[:, 0], total[:, 1], growth)[:, None]
        gains.append(np.where(fits, gain, 0.0))
    for n in range(len(sums)):
        at = [int(g[n].argmax()) for g in gains]
        side = int(gains[1][n, at[1]] > gains[0][n, at[0]] + 1e-12)
        best.append((float(gains[side][n, at[side]]), at[side], bool(side), *sides[side][n, at[side]].tolist()))
    return best


class _Growing:
    """A tree as it grows: nodes as lists."""

    def __init__(self):
        self.feature, self.threshold, self.missing_left, self.left, self.right, self.sums, self.gain, self.bin, self.depth = [], [], [], [], [], [], [], [], []

    def add(self, sums, depth: int) -> int:
        for values, x in ((self.feature, -1), (self.threshold, 0.0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.sums, sums), (self.gain, 0.0), (self.bin, 0), (self.depth, depth)):
            values.append(x)
        return len(self.feature) - 1

    def split(self, n: int, feature: int, bin: int, threshold: float, missing_left: bool, gain: float, left) -> tuple[int, int]:
        self.feature[n], self.bin[n], self.threshold[n], self.missing_left[n], self.gain[n] = feature, bin, threshold, missing_left, gain
        self.left[n] = self.add(left, self.depth[n] + 1)
        self.right[n] = self.add([a - b for a, b in zip(self.sums[n], left, strict=True)], self.depth[n] + 1)
        return self.left[n], self.right[n]

    def tree(self, growth: Growth | None = None, keep: set[int] | None = None) -> Tree:
        """The tree, of whose cuts those in `keep` stay (all without it)."""
        feature = np.array([f if keep is None or i in keep else -1 for i, f in enumerate(self.feature)], np.int64)
        sums = np.array(self.sums, np.float64).reshape(-1, 4)
        value = -growth.rate * _soft(sums[:, 0], growth.l1) / (sums[:, 1] + growth.l2 + 1e-12) if growth else np.zeros(len(feature))
        arrays = [np.array(self.threshold), np.array(self.missing_left, bool), np.array(self.left), np.array(self.right)]
        return Tree(feature, *arrays, np.where(feature < 0, value, 0.0), sums[:, 3], np.array(self.gain), np.array(self.bin, np.int64))


def _pass(state: DataFrame, parts: int, growing: Tree, open_nodes: list[int], since: list[Tree], base: float, columns: list[int], growth: Growth, number: int) -> tuple[dict, dict]:
    """The best cut (gain, feature, bin, missing left, left sums) and the sums of each open node."""
    place = np.full(len(growing.feature), -1, np.int64)
    place[open_nodes] = np.arange(len(open_nodes))
    size = len(open_nodes) * 256

    def sums(batches):
        import pyarrow as pa

        total = np.zeros((len(columns), size, 4))
        for part in batches:
            n = part.num_rows
            key, y, w, margin = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            offsets = np.frombuffer(part.column(4).buffers()[1], np.int32)[part.column(4).offset :][: n + 1]
            bins = np.frombuffer(part.column(4).buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)
            drawn = _drawn(key, growth.rows, growth.seed, number)
            bins, y, w, margin = bins[drawn], y[drawn], w[drawn], margin[drawn] + base
            for t in since:
                margin = margin + t.value[t.leaves(bins, binned=True)]
            node = place[growing.leaves(bins, binned=True)]
            inside = node >= 0
            p = 1 / (1 + np.exp(-margin[inside]))
            wi = w[inside]
            values = [(p - y[inside]) * wi, p * (1 - p) * wi, np.ones(len(p)), wi]
            first = node[inside] * 256
            for j, c in enumerate(columns):
                at = first + bins[inside, c]
                for k, v in enumerate(values):
                    total[j, :, k] += np.bincount(at, weights=v, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(columns, pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["feature", "sums"])

    def cuts(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for part in batches:
            for f, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.float64).reshape(len(open_nodes), 256, 4)
                total[f] = total[f] + own if f in total else own
        best: list = [None] * len(open_nodes)
        for f in sorted(total):
            for n, found in enumerate(best_cuts(total[f], growth)):
                if best[n] is None or found[0] > best[n][0] + 1e-12:
                    best[n] = (found[0], f, *found[1:], *total[f][n].sum(axis=0).tolist())
        rows = [(n, *b) for n, b in enumerate(best) if b]
        names = ["node", "gain", "feature", "bin", "missing_left", *[f"l{i}" for i in range(4)], *[f"t{i}" for i in range(4)]]
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 8]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = state.select("key", "y", "w", "margin", "bins")
    schema = "node int, gain double, feature int, bin int, missing_left boolean, " + ", ".join(f"{s}{i} double" for s in "lt" for i in range(4))
    if parts > 1:
        found = rows.mapInArrow(sums, "feature int, sums binary").repartition(min(len(columns), parts), "feature").mapInArrow(cuts, schema)
    else:
        found = rows.mapInArrow(lambda batches: cuts(sums(batches)), schema)
    best, totals = {}, {}
    for r in found.collect():  # a row for each open node and task
        n = open_nodes[r["node"]]
        totals[n] = [r[f"t{i}"] for i in range(4)]
        mine = (r["gain"], -r["feature"])
        if r["gain"] > 1e-9 and (n not in best or mine > best[n][:2]):
            best[n] = (*mine, r["bin"], r["missing_left"], [r[f"l{i}"] for i in range(4)])
    return best, totals


def best_first(gains: dict[int, tuple[float, int, int]], leaves: int) -> set[int]:
    """Of cuts (by node: gain and both children) those that are made until there are `leaves` leaves, always the one of the largest gain that can be."""
    kept, ready = set(), [0] if 0 in gains else []
    while ready and len(kept) < leaves - 1:
        n = max(ready, key=lambda i: (gains[i][0], -i))
        ready.remove(n)
        kept.add(n)
        ready += [c for c in gains[n][1:] if c in gains]
    return kept


def boost(rows: DataFrame, features: list[str], target: str, keys: list[str] | None = None, growth: Growth = LEAF_WISE, weight: str | None = None) -> Boosted:
    """Boosted trees for a target of 0 and 1. The first margin is the log odds of the weighted mean. keys tell rows apart when they are sampled (by default
    all their values do)."""
    state, cuts = bin_rows(rows, features, target, keys or [*features, target], weight, rows_at_once=growth.rows_at_once)
    w, positive = state.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
    share = min(max((positive or 0.0) / (w or 1.0), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    parts = state.rdd.getNumPartitions()
    trees: list[Tree] = []
    since: list[Tree] = []
    usable = [i for i, c in enumerate(cuts) if len(c)]
    for number in range(growth.rounds if usable else 0):
        drawn = np.random.RandomState((growth.seed * 1_000_003 + number) % 2**32).permutation(len(usable))
        columns = sorted(usable[i] for i in drawn[: max(1, round(growth.columns * len(usable)))])
        growing = _Growing()
        growing.add([0.0] * 4, 0)
        level = [0]
        for _ in range(growth.depth):
            best, totals = _pass(state, parts, growing.tree(), level, since, base, columns, growth, number)
            following = []
            for n in level:
                if n == 0 and n in totals:
                    growing.sums[0] = totals[0]
                if n in best:
                    gain, f, b, missing_left, left = best[n]
                    following += growing.split(n, -f, b, float(cuts[-f][min(b, len(cuts[-f]) - 1)]), missing_left, gain, left)
            level = following
            if not level:
                break
        inner = {n: (growing.gain[n], growing.left[n], growing.right[n]) for n in range(len(growing.feature)) if growing.feature[n] >= 0}
        tree = growing.tree(growth, best_first(inner, growth.leaves or 1 << 30))
        trees.append(tree)
        since.append(tree)
        if len(since) == growth.keep and number + 1 < growth.rounds:
            old, state = state, cut(_with_margins(state, since))
            forget(old)
            since = []
    forget(state)
    return Boosted(list(features), base, trees)


def _with_margins(state: DataFrame, since: list[Tree]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for part in batches:
            bins = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            margin = part.column(3).to_numpy(zero_copy_only=False) + sum(t.value[t.leaves(bins, binned=True)] for t in since)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(margin), part.column(4)], names=["key", "y", "w", "margin", "bins"])

    return state.mapInArrow(run, state.schema)


def with_probability(rows: DataFrame, model: Boosted, name: str) -> DataFrame:
    """rows with a probability for each."""
    own = [f"__x{i}" for i in range(len(model.features))]
    carried = rows.columns

    def run(batches):
        import pyarrow as pa

        for part in batches:
            margin = model.margins(matrix(part.columns[len(carried) :]))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(1 / (1 + np.exp(-margin)))], names=[*carried, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{name}` double"])
    return rows.select(*carried, *[F.col(f).cast("double").alias(c) for f, c in zip(model.features, own, strict=True)]).mapInArrow(run, schema)
