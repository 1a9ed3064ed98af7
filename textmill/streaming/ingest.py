"""Incremental ingest: a file stream into a committed table, each batch once.

A batch's rows and its commit row are written under the batch id; a batch that runs again after a failure overwrites
its own folder, and readers take only batches that the commit log names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, target: str, *, transform=lambda df: df, files_per_batch: int = 1) -> None:
    """Reads all files of source that are new since the last call into target."""
    if (done := committed(spark, target)) is not None and not done.where("closed").isEmpty():
        raise RuntimeError("the run is completed")

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        n = spark.read.parquet(f"{target}/data/batch={number}").count()
        spark.createDataFrame([(number, n, False)], "batch long, rows long, closed boolean").write.mode("overwrite").parquet(f"{target}/log/{number:08d}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def committed(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch long, rows long, closed boolean").option("recursiveFileLookup", True).parquet(f"{target}/log")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read(spark: SparkSession, target: str) -> DataFrame:
    """The rows of committed batches."""
    return spark.read.parquet(f"{target}/data").join(F.broadcast(committed(spark, target).select("batch").distinct()), "batch", "left_semi")


def close(spark: SparkSession, target: str) -> None:
    """Marks the run as completed; ingest refuses to add to it."""
    spark.createDataFrame([(-1, 0, True)], "batch long, rows long, closed boolean").write.mode("overwrite").parquet(f"{target}/log/closed")


def deduplicated(batch: DataFrame, claims: DataFrame | None, *, key: str) -> DataFrame:
    """A batch's rows whose key neither an earlier batch nor an earlier row of the batch has claimed; rows without a key
    all stay.  Which of several rows with one key stays is the least in the order of all their columns."""
    if claims is not None:
        batch = batch.join(claims.select(key).distinct(), key, "left_anti").select(*batch.columns)
    named = batch.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min(F.struct(*batch.columns)).alias("row")).select("row.*")
    return first.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))


def ingest_unique(spark: SparkSession, source: str, schema: str, target: str, *, key: str, files_per_batch: int = 1) -> None:
    """ingest with one row a key over all batches: what the committed batches hold is the state, so a restart finds it."""

    def unique(batch: DataFrame) -> DataFrame:
        log = committed(spark, target)
        earlier = None if log is None or log.isEmpty() else read(spark, target)
        return deduplicated(batch, earlier, key=key)

    ingest(spark, source, schema, target, transform=unique, files_per_batch=files_per_batch)


def progress(spark: SparkSession, target: str) -> DataFrame:
    """batches and rows committed so far, and whether the run is closed."""
    log = committed(spark, target)
    if log is None:
        return spark.createDataFrame([(0, 0, False)], "batches long, rows long, closed boolean")
    return log.agg(F.count_if(~F.col("closed")).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.bool_or("closed").alias("closed"))


def stop(spark: SparkSession) -> list[str]:
    """Stops all streams after the batch in work, whose rows stay uncommitted if it does not end; the names of them."""
    names = []
    for query in spark.streams.active:
        names.append(query.name or str(query.id))
        query.stop()
    return names
