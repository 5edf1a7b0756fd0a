"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.caches import cut, forget, inner_tables, shared_folder

__all__ = ["aside", "ascii_lower", "cut", "documents", "forget", "fresh", "inner_tables", "join_groups", "shared_folder"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of ASCII alone takes the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def aside(df: DataFrame, *names: str) -> DataFrame:
    """df, in which columns with the names of columns to be made are carried on as {name}_in (more underscores if that is taken too)."""
    taken, wanted = {c.lower() for c in df.columns}, {n.lower() for n in names}
    new = {}
    for c in df.columns:
        if c.lower() in wanted:
            new[c] = f"{c}_in"
            while new[c].lower() in taken | wanted:
                new[c] += "_"
            taken.add(new[c].lower())
    return df.withColumnsRenamed(new)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, most: int = 4096) -> DataFrame:
    """rows with the other columns of their groups (one row for each value of the keys, none of them null; null without a group).

    `size` says how many rows a group has, at least to the order. A group of more than one in `most` of all rows is a large one: there are
    fewer than `most`, so they are broadcast, and their rows are dealt by `spread` as well and meet in no task. groups is read twice, so it
    should be cut. The size itself is not in the result."""
    added = [c for c in groups.columns if c not in (*keys, size)]
    salt, found, *large_names = fresh(rows.join(groups.limit(0), keys), "salt", "found", *added)
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_large = F.col(size) > F.lit(total / most)
    large = groups.where(is_large).select(*keys, F.lit(True).alias(found), *[F.col(c).alias(n) for c, n in zip(added, large_names, strict=True)])
    small = groups.where(~is_large).drop(size).withColumn(salt, F.lit(0).cast("long"))
    dealt = F.when(F.col(found), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0)
    marked = rows.join(F.broadcast(large), keys, "left").withColumn(salt, dealt)
    out = marked.join(small, [*keys, salt], "left")
    return out.select(*rows.columns, *[F.coalesce(n, c).alias(c) for c, n in zip(added, large_names, strict=True)])
