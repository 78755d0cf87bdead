"""Tables written between the steps of an operator, and row keys.

Everything an operator writes goes below ``spark.checkpoint.dir``, the folder
that driver and executors share. The setting is read from the session; only a
session without one (a test) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a path that Spark can read and write. A cluster must name one; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return the reader of what was written: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, id_col: str = "doc_id", key: str = "_rid") -> DataFrame:
    """Add a unique long key to each row.

    Where id_col is present, never null and never repeated, it is the key and
    nothing is written. Otherwise (null or repeated ids) the rows are numbered
    and written once, so that every later pass sees the same numbers.
    """
    if id_col in df.columns and dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint"):
        ids = df.select(F.col(id_col).cast("long").alias("i"))
        bad = ids.groupBy("i").count().filter("i is null or count > 1").limit(1).count()
        if bad == 0:
            return df.withColumn(key, F.col(id_col).cast("long"))
    return written(df.withColumn(key, F.monotonically_increasing_id()), "rows")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table, marked for broadcast if it has at most `most` rows.

    Beyond that Spark joins by shuffle, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bound the bytes of the Arrow batches that Python workers get in this session.

    Rows hold whole texts, so a bound on rows alone would not bound memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
