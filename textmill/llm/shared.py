"""What the operators share: the scratch folder, written tables, column naming and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.  Texts may be long, so a batch is kept far below Spark's default of 10,000 rows.
BATCH_ROWS = 512

#: Regular expression of a word in the contracts, and the characters that part words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a missing document id: it sorts after every id.
NO_ID = 2**63 - 1


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine, as in tests, a local folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended before
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder in the scratch folder, deleted when the driver ends."""
    path = f"{scratch_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


#: Spark's setting under which the shuffle files of a query go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the scratch folder and reads it back.

    The write's shuffle files are of no use from then on; they are deleted at its end, so that the disk in use is that
    of one step and not of all.
    """
    spark = df.sparkSession
    path, before = new_folder(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for table in tables:
        drop_folder(table.sparkSession, table.scratch_folder)


def if_small(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """table (written, with a few numbers a row), marked for broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batch size, so that a batch of long texts fits a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column; nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """A string column's values; nulls as empty."""
    return [x or "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def in_slices(schema: pa.Schema, rows: list[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most size rows."""
    for at in range(0, len(rows), size):
        yield batch_of(schema, [list(c) for c in zip(*rows[at : at + size], strict=True)])
