"""Ranks, running sums and quantiles of whole columns, cut into pieces of the value range so that no task sorts all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.caches import cut


def value_ranks(rows: DataFrame, keys: list[str], x: str, sums: dict[str, Column] | None = None, cut_by: list[str] = (), parts: int = 32) -> DataFrame:
    """For each value of x and keys: n (rows with it), below (rows of the keys with smaller values), all (rows of the keys), and the sums.

    Distinct values are counted first, into a table of their own. They are ranked inside pieces of x's range, which cuts by approximate quantiles make (one row of cuts
    for each value of `cut_by`, a few at most, is broadcast), so a key with very many values is dealt over `parts` tasks. Nulls and NaN have no rank."""
    sums = sums or {}
    known = rows.where(F.col(x).isNotNull() & ~F.isnan(x))
    by = cut(known.groupBy(*keys, x).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()]))
    cuts = by.groupBy(*cut_by).agg(F.percentile_approx(x, [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts"))
    joined = by.join(F.broadcast(cuts), list(cut_by)) if cut_by else by.join(F.broadcast(cuts))
    pieced = joined.withColumn("__piece", F.size(F.filter("__cuts", lambda b: b < F.col(x)))).drop("__cuts")
    own = Window.partitionBy(*keys)
    before = own.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieced.groupBy(*keys, "__piece").agg(F.sum("n").alias("__own")).select(
        *keys, "__piece", F.coalesce(F.sum("__own").over(before), F.lit(0)).alias("__before"), F.sum("__own").over(own).alias("all")
    )
    inside = Window.partitionBy(*keys, "__piece").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    below = pieced.withColumn("__below", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, [*keys, "__piece"])
    return below.select(*keys, x, "n", *sums, (F.col("__before") + F.col("__below")).alias("below"), "all")


def exact_quantiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...], least: int = 1) -> DataFrame:
    """One row: by column an array of its quantiles, with linear interpolation between neighbours; null with fewer than `least` values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    ranked = value_ranks(rows.select(pairs.alias("p")).select("p.*"), ["feature"], "x", cut_by=["feature"])

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("x")))

    picked = []
    for i, share in enumerate(shares):
        place = (F.col("all") - 1) * F.lit(float(share))
        picked += [at(F.floor(place)).alias(f"lo{i}"), at(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"w{i}")]
    by = ranked.groupBy("feature").agg(F.max("all").alias("all"), *picked)
    values = F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}") for i in range(len(shares))])
    one = by.withColumn("q", F.when(F.col("all") >= least, values))
    return one.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns])


def rank_share(rows: DataFrame, keys: list[str], x: str, name: str, parts: int = 32) -> DataFrame:
    """rows with the rank of x among the rows of its keys from the smallest, ties averaged, as a share of the rows that have it; null for null."""
    ranks = value_ranks(rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, x, parts=parts)
    share = ((F.col("below") + (F.col("n") + 1) / F.lit(2.0)) / F.col("all")).alias(name)
    return rows.join(ranks.select(*keys, x, share), [*keys, x], "left")


def group_z(rows: DataFrame, keys: list[str], values: dict[str, Column], defaults: dict[str, float] | None = None) -> DataFrame:
    """rows with z-scores (sample deviation) of values among the rows of their keys, by one aggregation that is joined back. Where the
    deviation is not above zero, or a key is null, the value's default (null if it has none)."""
    defaults = defaults or {}
    own = rows.withColumns({f"__{n}": x for n, x in values.items()})
    stats = own.groupBy(*keys).agg(*[f(f"__{n}").alias(f"__{n}_{f.__name__}") for n in values for f in (F.avg, F.stddev_samp)])
    stats = stats.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    joined = own.join(stats, keys, "left")
    z = lambda n: F.when(F.col(f"__{n}_stddev_samp") > 0, (F.col(f"__{n}") - F.col(f"__{n}_avg")) / F.col(f"__{n}_stddev_samp")).otherwise(F.lit(defaults.get(n)).cast("double"))
    return joined.withColumns({n: z(n) for n in values}).select(*rows.columns, *values)


def _bounds(rows: DataFrame, column: str, parts: int) -> list:
    """Values that cut a column into about `parts` equal shares; one small row."""
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx(column, shares, 10 * parts)).first()[0] or []))


def _pieces(rows: DataFrame, parts: int, id_col: str | None = None) -> DataFrame:
    """rows with a column `piece` that rises as scores fall. A score that many rows share has a piece of its own, cut up further by id."""
    bounds = _bounds(rows, "score", parts)
    held = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    score = F.col("score").cast("double")
    above = F.size(F.filter(held, lambda b: b > score))
    exact = F.array_contains(held, score)
    sub = F.lit(0)
    if id_col and (ids := _bounds(rows, id_col, parts)):
        sub = F.when(exact, F.size(F.filter(F.array(*map(F.lit, ids)), lambda b: b < F.col(id_col)))).otherwise(0)
    return rows.withColumn("piece", ((2 * above + F.when(exact, 1).otherwise(0)) * (2 * parts) + sub).cast("long"))


def running(rows: DataFrame, sums: dict[str, Column], order: list, parts: int = 32, id_col: str | None = None) -> DataFrame:
    """rows with running sums from the highest score on and, as {name}_all, totals. Pieces of the score range are summed on their own, so no task
    takes all rows in; the pieces' sums are a small table."""
    pieced = _pieces(rows, parts, id_col)
    own = pieced.groupBy("piece").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = own.select("piece", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums], *[F.sum(n).over(every).alias(f"{n}_all") for n in sums])
    inside = Window.partitionBy("piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pieced.withColumns({n: F.sum(x).over(inside) for n, x in sums.items()}).join(F.broadcast(offsets), "piece")  # 4 parts^2 rows at most
    return out.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop("piece", *[f"{n}_before" for n in sums])
