"""As-of joins: what was known when a decision was taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spread import spread


def bitemporal_asof(decisions: DataFrame, history: DataFrame, by: list[str], key: list[str], visible: Column, order: list[str], payload: list[str]) -> DataFrame:
    """For each decision (unique by `key`) the row of history with equal `by` for
    which `visible` (any predicates over both sides) holds and that is greatest in
    `order`; null payload if there is none.

    One equi-join on `by` and one aggregation with map-side combine; the cost is
    the length of the history that a decision sees.
    """
    taken = decisions.join(history, by).filter(visible)
    best = taken.groupBy(*key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_p"))
    best = best.select(*key, *[F.col(f"_p.{c}").alias(c) for c in payload])
    return decisions.join(best, key, "left")


def bitemporal_running(decisions: DataFrame, history: DataFrame, by: list[str], at: str, known: Column, order: list[str], payload: list[str]) -> DataFrame:
    """For each decision the row of history with equal `by` that is greatest in `order` among those
    that were known at its time `at`; null payload if there is none.

    Where a row is visible from one moment on (`known`, the latest of its clocks),
    a running maximum over one sorted pass serves all decisions: one shuffle on
    `by`, and the cost does not grow with decisions x history."""
    best = F.struct(*[F.col(c) for c in order], F.struct(*payload).alias("_p"))
    h = history.select(*by, known.cast("timestamp").alias("_t"), F.lit(0).alias("_tag"), best.alias("_h"), F.lit(None).cast(_struct_of(decisions)).alias("_d"))
    q = decisions.select(*by, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_tag"), F.lit(None).cast(h.schema["_h"].dataType).alias("_h"), F.struct(*decisions.columns).alias("_d"))
    upto = Window.partitionBy(*by).orderBy("_t", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    out = h.unionByName(q).withColumn("_m", F.max("_h").over(upto)).filter(F.col("_d").isNotNull())
    return out.select("_d.*", *[F.col(f"_m._p.{c}").alias(c) for c in payload])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, payload: list[str], strict: bool = False) -> DataFrame:
    """The last row of right at or before (strict: before) each left time.

    Both sides in one sorted pass: linear, one shuffle on `by`. Of right rows at
    the same time the one with the greatest payload counts.
    """
    carried = F.struct(F.col(right_time).alias("_rt"), *payload)
    tag_right, tag_left = (1, 0) if strict else (0, 1)
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(tag_right).alias("_tag"), carried.alias("_r"), F.lit(None).cast(_struct_of(left)).alias("_l"))
    every = left.select(*by, F.col(left_time).alias("_t"), F.lit(tag_left).alias("_tag"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*by).orderBy("_t", "_tag", "_r").rowsBetween(Window.unboundedPreceding, 0)
    out = every.unionByName(r).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    return out.select("_l.*", F.col("_m._rt").alias(f"matched_{right_time}"), *[F.col(f"_m.{c}").alias(c) for c in payload])


def _struct_of(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def next_session(rows: DataFrame, sessions: DataFrame, at: str, session: str = "session") -> DataFrame:
    """The first session on or after each row's date `at`.

    Row dates are distinct days and sessions a calendar: both small in number, so
    the lookup is one window over their union, joined back by date.
    """
    days = rows.select(F.col(at).alias("_d")).distinct()
    both = days.select("_d", F.lit(None).cast("date").alias("_s"), F.lit(0).alias("_k")).unionAll(sessions.select(F.col(session), F.col(session), F.lit(1)))
    w = Window.orderBy(F.col("_d"), F.col("_k")).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn(session, F.first("_s", ignorenulls=True).over(w)).filter("_k = 0").select("_d", session)
    return rows.join(found, F.col(at) == F.col("_d"), "left").drop("_d")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key in order, the others): first known identity wins, later ones are kept apart."""
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return n.filter("_n = 1").drop("_n"), n.filter("_n > 1").drop("_n")


def exact_context(facts: DataFrame, cell: list[str], rank: str, value: str) -> DataFrame:
    """For each cell the value under its first-ranked tag that has any finite value;
    a tag with several different values is a conflict and gives no value."""
    ok = facts.filter(F.col(value).isNotNull() & ~F.isnan(value))
    per = ok.groupBy(*cell, rank).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("v"))
    best = per.groupBy(*cell).agg(F.min_by(F.struct("n_values", "v", rank), rank).alias("b"))
    return best.select(*cell, F.col(f"b.{rank}").alias(rank), F.when(F.col("b.n_values") == 1, F.col("b.v")).alias(value), F.when(F.col("b.n_values") == 1, "EXACT").otherwise("CONFLICT").alias("status"))


def earliest_context(facts: DataFrame, cell: list[str], rank: str, start: str, value: str) -> DataFrame:
    """For each cell the first-ranked tag that has any row, finite or not, and its value at the earliest
    start, null if that is not unique: the older rule, kept for comparison with exact_context.

    A cell's facts are few, but cells are many: the sort of the second grouping holds what spread() gives a task."""
    per = spread(facts, cell).groupBy(*cell, rank, start).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("_c"))
    best = per.groupBy(*cell).agg(F.min_by(F.struct(rank, start, "_lo", "_hi", "_n", "_c"), F.struct(rank, start)).alias("b"))
    one = (F.col("b._lo") == F.col("b._hi")) & (F.col("b._n") == F.col("b._c"))
    return best.select(*cell, F.col(f"b.{rank}").alias(rank), F.col(f"b.{start}").alias(start), F.when(one, F.col("b._lo")).alias(value))


def first_observable_session(rows: DataFrame, sessions: DataFrame, at: str, cutoff: str = "16:15:00", session: str = "session") -> DataFrame:
    """The first session in which what became known at the timestamp `at` can be used: its own day up to the cutoff, else a later one."""
    day = F.to_date(at)
    late = F.date_format(at, "HH:mm:ss") > cutoff
    usable = rows.withColumn("_day", F.when(late, F.date_add(day, 1)).otherwise(day))
    return next_session(usable, sessions, "_day", session).drop("_day")


def asof_rescaled(left: DataFrame, prices: DataFrame, by: list[str], left_time: str, price_time: str, price: str, ratio: str, days: int) -> DataFrame:
    """left with the last price at or before its time, at most `days` old, times the ratios that
    took effect after the price and up to the time: two sorted passes, no range join."""
    w = Window.partitionBy(*by).orderBy(price_time).rowsBetween(Window.unboundedPreceding, 0)
    logs = prices.withColumn("_c", F.sum(F.ln(ratio)).over(w))
    # the running factor at the price, and the one at the row's own time
    priced = logs.filter(F.col(price).isNotNull()).select(*by, F.col(price_time).alias("_pt"), F.col(price).alias("_p"), F.col("_c").alias("_cp"))
    out = asof_backward(left, priced, by, left_time, "_pt", ["_p", "_cp"])
    out = asof_backward(out, logs.select(*by, F.col(price_time).alias("_ct"), F.col("_c").alias("_ca")), by, left_time, "_ct", ["_ca"])
    fresh = F.datediff(F.to_date(left_time), F.to_date("matched__pt")) <= days
    value = F.when(fresh, F.col("_p") * F.exp(F.col("_ca") - F.col("_cp")))
    return out.select(*left.columns, value.alias(price))
