"""Writers that never overwrite, and hashes of a table's content whatever its row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back and compare as multisets; the reader of what was written."""
    write_once(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if differ(back, df):
        raise ValueError(f"what was written to {path} differs from what was to be written")
    return back


def differ(a: DataFrame, b: DataFrame) -> bool:
    """Are the rows of a and b, by position of the columns, other multisets? Both directions in one exchange."""
    both = a.withColumn("_side", F.lit(1)).unionAll(b.withColumn("_side", F.lit(-1)))
    return not both.groupBy(*[c for c in both.columns if c != "_side"]).agg(F.sum("_side").alias("_n")).filter("_n != 0").isEmpty()


def canonical_lines(df: DataFrame, key: list[str]) -> DataFrame:
    """(line): JSON of each row with its columns in name order, rows in the order of key."""
    return df.orderBy(*key).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for any order of the same rows; repeats count."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)), 256).alias("digest"))


def manifest(spark, path: str) -> DataFrame:
    """(file, size, sha256) of the files at a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified_scan(spark, path: str, known: DataFrame) -> DataFrame:
    """The Parquet table at a path, if its files are exactly those of a manifest; an error else."""
    now = manifest(spark, path)
    if now.exceptAll(known.select(*now.columns)).limit(1).count() or known.select(*now.columns).exceptAll(now).limit(1).count():
        raise ValueError(f"the files at {path} are not those of the manifest")
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """Write CSV once and return its reader with the same types; doubles are written so that they read back the same."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return read_csv(df.sparkSession, path, df.schema)


def read_csv(spark, path: str, schema) -> DataFrame:
    """A CSV with a header; a header that differs from the schema in names or order is an error."""
    head = spark.read.option("header", True).option("enforceSchema", False).csv(path).columns
    if head != [f.name for f in schema]:
        raise ValueError(f"{path} has columns {head}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def seal(df: DataFrame, by: list[str], key: list[str], columns: list[str] | None = None) -> DataFrame:
    """by, n, seal: SHA-256 over the canonical lines (of the columns, or all) of each group in the order of key.

    A group is one ledger of bounded length; content_hash serves tables of any size."""
    line = F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*key, line.alias("_line")))), lambda s: s["_line"])
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("seal"))


def write_addressed(df: DataFrame, folder: str) -> str:
    """Write Parquet below a name made of its content; the same content is written once. Returns the path."""
    h = content_hash(df).first().digest
    path = f"{folder}/sha256={h}"
    df.write.mode("ignore").parquet(path)
    return path


def write_lines(lines: DataFrame, path: str) -> None:
    """Write one text column as lines, once; the commit makes all of it visible or nothing."""
    lines.write.mode("errorifexists").text(path)


def published(df: DataFrame, staging: str, path: str) -> DataFrame:
    """Write to a staging path, compare, and only then write the place that others read, from what was verified."""
    write_verified(df, staging).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """df as written below a name made of its key and columns; what is there already is read."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(f'{key}:{df.schema.simpleString()}'.encode()).hexdigest()}"
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chained(df: DataFrame, by: list[str], key: list[str], payload: str) -> DataFrame:
    """by, n, head: the last link of a chain of SHA-256 over the payloads in order, each with the link before it."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*key, F.col(payload).alias("_p")))), lambda s: s["_p"])
    link = lambda h, x: F.sha2(F.concat(h, F.lit("|"), F.coalesce(x, F.lit(""))), 256)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.aggregate(items, F.lit(""), link).alias("head"))


def broken_links(log: DataFrame, by: list[str], order: list[str], link: str, payload: str) -> DataFrame:
    """Rows of a log whose link is not the SHA-256 of the link before and their payload."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag(link).over(Window.partitionBy(*by).orderBy(*order)), F.lit(""))
    return log.withColumn("_want", F.sha2(F.concat(before, F.lit("|"), F.coalesce(payload, F.lit(""))), 256)).filter(F.col("_want") != F.col(link)).drop("_want")
