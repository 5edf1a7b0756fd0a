"""Exact deduplication with DataFrame functions only.

Rows are grouped by the 128-bit MD5 of the normalised text. The grouping key also holds SHA-256 and the text itself, so bytes are
compared inside each group and a hash collision never joins two texts. Copies are combined before the shuffle: a group that holds a
third of all rows reaches the reducer as one row for each map task.

Rows find their group by a join on hashes. Groups that hold more than one row in 4,096 are few and are broadcast, and their rows are
dealt by id as well, so that copies never meet in one task.

Defined cases: a null text counts as empty; empty texts are equal; very long texts are hashed and compared whole; a null id never wins against an id (a group of null ids alone keeps
a null id); rows that repeat with the same id and text are one document to `drop_exact_copies`, which keeps one of them; an empty
table gives an empty result. Columns other than id and text are carried along and never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import ascii_lower, cut, fresh, join_groups


def _content(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per distinct text: content_md5, content_sha256 (binary), keep_id, group_size."""
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), _content(F.col(text_col)).alias("content"))
    rows = rows.select("id", "content", F.unhex(F.md5("content")).alias("content_md5"), F.unhex(F.sha2("content", 256)).alias("content_sha256"))
    texts = rows.groupBy("content_md5", "content_sha256", "content").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    groups = texts.groupBy("content_md5", "content_sha256").agg(
        F.sum("n").alias("group_size"), best("keep_id").alias("keep_id"), F.count("*").alias("variants")
    )
    # Both hashes alike for different bytes: no id pair can tell them apart further on, so the job stops instead of losing a text.
    sure = F.when(F.col("variants") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share MD5 and SHA-256")).cast("long"))
    return groups.select("content_md5", "content_sha256", "keep_id", sure.alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. What is joined has hashes and ids, no texts."""
    groups = cut(content_groups(docs, id_col, text_col, keep).withColumn("n", F.col("group_size")))
    rows = docs.select(F.col(id_col).alias("id"), _content(F.col(text_col)).alias("content"))
    rows = rows.select("id", F.unhex(F.md5("content")).alias("content_md5"), F.unhex(F.sha2("content", 256)).alias("content_sha256"))
    return join_groups(rows, groups, ["content_md5", "content_sha256"], "n", "id").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("content_sha256")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are joined by id and hash, so a hot text is spread over its ids."""
    key, md5 = fresh(docs, "key", "md5")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keepers = content_groups(docs, id_col, text_col, keep).select(name(F.col("keep_id")).alias(key), F.col("content_md5").alias(md5))
    rows = docs.withColumns({key: name(F.col(id_col)), md5: F.unhex(F.md5(_content(F.col(text_col))))})
    return rows.join(keepers, [key, md5], "left_semi").dropDuplicates([key, md5]).drop(key, md5)
