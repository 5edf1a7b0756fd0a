"""Tables that are written and read again: inner steps in the shared folder, extractions by signature, vectors with a description, runs, traces."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The tables that `cut` has made in each `inner_tables` that is open, the innermost last.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one is set only where it is unset, which is right on one machine alone."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table written to the shared checkpoint folder and read again; its lineage, and all that the planner knew of it, ends there.
    partition_by: columns of few values, each with a folder of its own, so that a filter on them reads nothing else."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    for made in _scopes.get()[-1:]:
        made.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a DataFrame that `cut` gave, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def inner_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed when it ends, also by an error. What reads them must be written by then: a query's rows, or a table that was
    cut and given to the function that this yields, which then stays (and belongs to the `inner_tables` around this one, if there is one)."""
    made, kept = [], []
    around = _scopes.get()
    token = _scopes.set((*around, made))

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for df in made:
            if not any(df is k for k in kept):
                forget(df)
            elif around:
                around[-1].append(df)


def signature(version: str, *columns: str) -> Column:
    """A key of everything that an extraction depends on: the code's version and these columns."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *columns), {"ignoreNullFields": "false"}), 256)


def batches(spark: SparkSession, path: str) -> list[str]:
    """The batches of a table of extractions that were written to their end, the oldest first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    folders = sorted(f.getPath().getName() for f in files.listStatus(place) if f.isDirectory())
    return [f"{path}/{name}" for name in folders if exists(spark, f"{path}/{name}/_SUCCESS")]


def extracted(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame | None:
    """The table of extractions at `path` (of the signatures in `only`), or None without any. Where two runs have written one signature, the older batch counts, for all
    readers; batches that were broken off are not seen."""
    found = batches(spark, path)
    if not found:
        return None
    rows = spark.read.parquet(*found).withColumn("__batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    if only is not None:
        rows = rows.join(only.select("signature").distinct(), "signature", "left_semi")
    if len(found) == 1:
        return rows.drop("__batch")
    first = rows.groupBy("signature").agg(F.min("__batch").alias("__batch"))
    return rows.join(first, ["signature", "__batch"], "left_semi").drop("__batch")


def read_through(items: DataFrame, path: str, version: str, depends_on: list[str], extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """items with what `extract` adds to them, taken from the table at `path` where it has their signature. The rest are extracted, once per signature. `extract`
    gets one row per signature (its columns: signature and depends_on) and keeps `signature`.

    Each run writes a batch of its own, whose name rises with time and whose last file says that it is whole. So a run that is repeated after it was
    broken off, and runs side by side, add no row twice; nothing is locked and nothing that is read changes. `compact` makes one batch of many."""
    spark = items.sparkSession
    signed = items.withColumn("signature", signature(version, *depends_on))
    wanted = signed.select("signature", *depends_on).dropDuplicates(["signature"])
    known = extracted(spark, path)
    if known is not None:
        wanted = wanted.join(known.select("signature"), "signature", "left_anti")
    wanted = cut(wanted)
    if known is None or not wanted.isEmpty():
        extract(wanted).drop(*depends_on).write.parquet(f"{path}/{_batch_name()}")
    forget(wanted)
    return signed.join(extracted(spark, path), "signature", "left")


def _batch_name() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def compact(spark: SparkSession, path: str) -> None:
    """One batch in place of all that are there now, of which it takes the oldest one's name with a sign that sorts before it; then the others go. Readers
    that began before must have ended."""
    found = batches(spark, path)
    if len(found) < 2:
        return
    name = found[0].rsplit("/", 1)[1]
    extracted(spark, path).write.parquet(f"{path}/{name[:20]}+{uuid.uuid4().hex}")
    for old in found:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_vectors(rows: DataFrame, path: str, model: str, vector: str = "embedding") -> None:
    """Rows with vectors, and beside them a table of one row: model, length of a vector, how many."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    kept = rows.sparkSession.read.parquet(f"{path}/rows")
    kept.agg(F.lit(model).alias("model"), F.max(F.size(vector)).alias("dim"), F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/about")


def read_vectors(spark: SparkSession, path: str, dim: int | None = None, vector: str = "embedding") -> DataFrame:
    """Rows with vectors; of another length than `dim`, none (the channel is off). Without a table there, an empty one of id and vector."""
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], f"id string, {vector} array<float>")
    rows = spark.read.parquet(f"{path}/rows")
    return rows if dim is None else rows.where(F.size(vector) == dim)


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with a header; `read_csv` reads them."""
    rows.write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True)


def write_models(models: dict, predictions: DataFrame, ranks: DataFrame, path: str) -> None:
    """Fitted pipelines by name, predictions and the ranking of one training run, side by side."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    ranks.write.mode("overwrite").parquet(f"{path}/ranks")


def read_models(path: str, names: list[str]) -> dict:
    from pyspark.ml import PipelineModel

    return {name: PipelineModel.load(f"{path}/models/{name}") for name in names}


def append_trace(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Rows with the time of writing, in a folder of their run. A run that is repeated under its name replaces what it has left."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/run={run or _batch_name()}")
