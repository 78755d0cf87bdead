"""Chronological splits in which nothing later than the cutoff can be seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purged(rows: DataFrame, cutoffs: list[str], origin: str, available: str, years: int | None = None) -> DataFrame:
    """Rows usable for training at each cutoff: origin and label availability both strictly before it.

    The cutoffs are a list of times in the plan: each row is repeated for those that it serves, without a join."""
    kind = "timestamp"
    all_ = F.array(*[F.lit(c).cast(kind) for c in cutoffs])

    def serves(c):
        ok = (F.col(origin) < c) & (F.col(available) < c)
        return ok & (F.col(origin) >= F.add_months(c, -12 * years)) if years else ok

    return rows.withColumn("cutoff", F.explode(F.filter(all_, serves)))


def session_pairs(rows: DataFrame, session: str, available: str) -> DataFrame:
    """(s, e, n): rows by session and by the later of session and availability.

    It has at most as many rows as pairs of days in the calendar, however many rows there are."""
    s, a = F.col(session), F.col(available)
    return rows.groupBy(s.alias("s"), F.greatest(s, a).alias("e")).agg(F.count(F.lit(1)).alias("n"), F.count(a).alias("k"))


def session_folds(rows: DataFrame, session: str, available: str, min_train: int, test: int, step: int, embargo: int, max_train: int | None = None, partial: bool = False) -> DataFrame:
    """fold_id, train_start, train_end, test_start, test_end, train_rows, test_rows of the folds on distinct sessions.

    A fold trains on the last max_train sessions (all, if none is given) up to its
    train end, and on rows that were available by then; it needs min_train distinct
    sessions with such rows, and is left out without them before ids are given. A
    last test that is cut short counts if `partial`. All is computed on counts by
    day, so rows are read once and never meet the folds.
    """
    pairs = session_pairs(rows, session, available)
    n = Window.orderBy("s")  # the calendar: distinct days
    s = pairs.select("s").distinct().withColumn("i", F.row_number().over(n) - 1)
    total = s.agg(F.max("i").alias("m"))
    last_first = F.col("m") if partial else F.col("m") - test + 1
    starts = F.when(last_first >= min_train + embargo, F.sequence(F.lit(min_train + embargo), F.greatest(last_first, F.lit(min_train + embargo)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    grid = total.select(F.explode(starts).alias("first"), "m")
    start = F.greatest(F.col("first") - embargo - max_train, F.lit(0)) if max_train else F.lit(0)
    grid = grid.select("first", start.alias("lo"), (F.col("first") - embargo - 1).alias("hi"), F.least(F.col("first") + test - 1, F.col("m")).alias("last"))
    day = lambda i, name: s.select(F.col("i").alias(i), F.col("s").alias(name))
    named = grid.join(day("lo", "from_session"), "lo").join(day("hi", "train_end"), "hi").join(day("first", "test_start"), "first").join(day("last", "test_end"), "last")
    named = F.broadcast(named)  # folds: at most one a session
    train = pairs.filter("k > 0").join(named, (F.col("s") >= F.col("from_session")) & (F.col("e") <= F.col("train_end")))
    train = train.groupBy("first", "train_end", "test_start", "test_end").agg(F.count_distinct("s").alias("d"), F.sum("k").alias("train_rows"), F.min("s").alias("train_start")).filter(F.col("d") >= min_train)
    tested = pairs.join(named, F.col("s").between(F.col("test_start"), F.col("test_end"))).groupBy("first").agg(F.sum("n").alias("test_rows"))
    out = train.join(tested, "first").withColumn("fold_id", F.row_number().over(Window.orderBy("first")))
    return out.select("fold_id", "train_start", "train_end", "test_start", "test_end", "train_rows", "test_rows")


def inner_folds(rows: DataFrame, outer: DataFrame, session: str, available: str, min_train: int, test: int, step: int) -> DataFrame:
    """outer_id, inner, train_end, test_start, test_end: folds inside the training rows of each outer fold, so
    that every inner test ends before the outer one starts. Sessions are numbered anew in each prefix."""
    pairs = session_pairs(rows, session, available)
    seen = pairs.join(F.broadcast(outer), (F.col("s") >= F.col("train_start")) & (F.col("e") <= F.col("train_end")) & (F.col("k") > 0))
    s = seen.select(F.col("fold_id").alias("outer_id"), "s").distinct().withColumn("i", F.row_number().over(Window.partitionBy("outer_id").orderBy("s")) - 1)
    top = s.groupBy("outer_id").agg(F.max("i").alias("m")).filter(F.col("m") >= min_train + test - 1)
    grid = top.select("outer_id", F.explode(F.sequence(F.lit(min_train), F.col("m") - test + 1, F.lit(step))).alias("first"))
    grid = grid.select("outer_id", "first", (F.col("first") - 1).alias("hi"), (F.col("first") + test - 1).alias("last"))
    day = lambda i, name: s.select("outer_id", F.col("i").alias(i), F.col("s").alias(name))
    out = grid.join(day("hi", "train_end"), ["outer_id", "hi"]).join(day("first", "test_start"), ["outer_id", "first"]).join(day("last", "test_end"), ["outer_id", "last"])
    return out.withColumn("inner", F.row_number().over(Window.partitionBy("outer_id").orderBy("first"))).select("outer_id", "inner", "train_end", "test_start", "test_end")


def refits(rows: DataFrame, entity: str, order: list[str], window: int, least: int, every: int) -> DataFrame:
    """rows with position and refit: which model, by the position it was fitted at, forecasts the row.

    A model is fitted at every `every`-th position from `least` on, on the `window` rows before it;
    rows before the first have none. Train rows of a refit are those at refit - window .. refit - 1."""
    pos = F.row_number().over(Window.partitionBy(entity).orderBy(*order)) - 1
    p = rows.withColumn("position", pos)
    refit = F.lit(least) + F.floor((F.col("position") - least) / every) * every
    return p.withColumn("refit", F.when(F.col("position") >= least, refit.cast("int")))


def row_set_hash(rows: DataFrame, by: list[str], key: str, chunk: int = 1000) -> DataFrame:
    """by, n, digest: SHA-256 over the digests of a group's ordered keys, taken `chunk` keys at a time.

    A task holds one chunk of keys, and then one digest a chunk, however large the group."""
    at = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1) / chunk)
    joined = lambda pairs: F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda s: s["v"]), ",")
    part = rows.withColumn("_at", at).groupBy(*by, "_at").agg(F.count(F.lit(1)).alias("_n"), F.sha2(joined(F.struct(F.col(key), F.col(key).cast("string").alias("v"))), 256).alias("_d"))
    return part.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(joined(F.struct(F.col("_at"), F.col("_d").alias("v"))), 256).alias("digest"))
