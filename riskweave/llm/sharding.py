"""Weighted rendezvous sharding with DataFrame functions only.

Each (key, shard) pair gets a uniform 52-bit value from MD5; a row goes to the shard with the largest -weight / ln(value). A new shard
changes only the rows for which its own value is the largest, so rows move into it and nowhere else.

Slots number the rows of a shard from 0 without gaps. Rows that are alike in every column are counted first and numbered as one. What is
left of a shard is cut into pieces by a hash, one for each `rows_at_once` of its rows; the pieces are counted and summed up, and rows are
numbered inside their piece alone. Rows that are alike then get their numbers in chunks of `rows_at_once`, which are dealt over tasks. So
neither one shard nor rows that repeat are ever numbered in a single task.

Defined cases: a null key is the text "null"; a null text has no bytes; very long texts are only measured and summed up, never moved;
repeated rows get the same shard and slots of their own; ties between scores go to the smaller shard; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import cut


def _uniform(key: Column, shard: int) -> Column:
    """52 bits of MD5 as a double inside (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard number of a key among len(weights) shards; ties go to the smaller number."""
    scores = [F.struct((F.lit(-float(w)) / F.ln(_uniform(key, i))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-F.greatest(*scores)["shard"]).cast("int") if len(scores) > 1 else F.lit(0)


def gapless_slots(df: DataFrame, group: str, slot: str = "slot", rows_at_once: int = 1000) -> DataFrame:
    """df with a column that numbers the rows of each group from 0. All its columns set the order; their names must not begin with __.
    Groups are few (their sizes are broadcast), and df is read several times, so it should be cut."""
    columns = df.columns
    sizes = df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(float(rows_at_once))).cast("long").alias("__parts"))
    alike = df.groupBy(*columns).agg(F.count("*").alias("__n"))  # repeated rows are combined before the shuffle
    pieced = alike.join(F.broadcast(sizes), group).withColumn("__part", F.pmod(F.xxhash64(*columns), F.col("__parts"))).drop("__parts")
    counts = pieced.groupBy(group, "__part").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieced.withColumn("__row", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, [group, "__part"])
    first = (F.col("__start") + F.col("__row")).alias("__first")
    once = F.col("__n") == 1
    chunk = F.explode(F.when(once, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(rows_at_once).cast("long")))).alias("__from")
    chunks = placed.select(*columns, "__n", first, chunk)
    if not alike.where("__n > 1").isEmpty():
        chunks = chunks.repartition("__first", "__from")
    offset = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + rows_at_once, F.col("__n")) - 1)).alias("__offset")
    return chunks.select(*columns, "__first", offset).select(*columns, (F.col("__first") + F.col("__offset")).alias(slot))


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, new_weight: float = 1.0, rows_at_once: int = 1000
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (the shard once another of new_weight is added) of every row."""
    weights = weights or [1.0] * 24
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.select("id", "size", "text_crc32", rendezvous_shard(F.col("key"), weights).alias("shard"), rendezvous_shard(F.col("key"), [*weights, new_weight]).alias("grown_shard"))
    rows = gapless_slots(cut(rows), "shard", rows_at_once=rows_at_once)
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
