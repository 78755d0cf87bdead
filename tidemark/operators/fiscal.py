"""Fiscal periods from disclosed facts: only what was known at a row's own time counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarters_of(days: Column) -> Column:
    """1 to 4 disclosed quarters by length in days, null between the ranges."""
    return F.when(days.between(65, 110), 1).when(days.between(150, 215), 2).when(days.between(235, 305), 3).when(days.between(330, 390), 4)


def period_context(facts: DataFrame, key: list[str], start: str, end: str, annual: str, value: str) -> DataFrame:
    """key, quarter, start, value of each filing's longest period: full years only in annual forms,
    shorter ones only in others. No row unless its start is unique; null unless its value is."""
    q = quarters_of(F.datediff(end, start))
    ok = facts.withColumn("_q", q).filter(F.col("_q").isNotNull() & ((F.col("_q") == 4) == F.col(annual)))
    per = ok.groupBy(*key, F.col("_q").alias("quarter")).agg(F.count_distinct(start).alias("_s"), F.min(start).alias(start), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    top = per.groupBy(*key).agg(F.max_by(F.struct("quarter", "_s", start, "_lo", "_hi"), "quarter").alias("p"))
    return top.filter("p._s = 1").select(*key, "p.quarter", f"p.{start}", F.when(F.col("p._lo") == F.col("p._hi"), F.col("p._lo")).alias(value))


def fiscal_index(panel: DataFrame, entity: str, start: str, quarter: str, order: list[str], tolerance: int = 21) -> DataFrame:
    """panel with fiscal_index: quarters since year 0, counted in whole years from the entity's first
    row in `order`; null where the start is more than `tolerance` days off a whole year."""
    w = Window.partitionBy(entity).orderBy(*order)
    anchor = F.first(start).over(w)
    since = F.datediff(start, anchor)
    cycle = F.rint(since / 365.2425)
    index = ((F.year(anchor) + cycle) * 4 + F.col(quarter) - 1).cast("int")
    return panel.withColumn("fiscal_index", F.when(F.abs(since - cycle * 365.2425) <= tolerance, index))


def expected_start(panel: DataFrame, entity: str, asof: str, end: str) -> DataFrame:
    """panel with expected_start: the day after the latest end disclosed before the row and before its own end.

    The ends of an entity are its filings, few enough for an array a row."""
    before = Window.partitionBy(entity).orderBy(F.unix_date(asof)).rangeBetween(Window.unboundedPreceding, -1)
    ends = F.collect_set(end).over(before)
    return panel.withColumn("_e", ends).withColumn("expected_start", F.date_add(F.array_max(F.filter("_e", lambda e: e < F.col(end))), 1)).drop("_e")


def trailing_year(panel: DataFrame, entity: str, index: str, asof: str, value: str, to_date: str) -> DataFrame:
    """panel with ttm, method, approximate: the year's own figure, else four quarters, else
    last year + year to date - year to date a year ago. A slot counts if it was known at the row's time."""
    seen = Window.partitionBy(entity).orderBy(index).rangeBetween(-7, 0)
    p = panel.withColumn("_h", F.collect_list(F.struct(F.col(index).alias("k"), F.col(asof).alias("t"), F.col(value).alias("v"), F.col(to_date).alias("y"))).over(seen))

    def known(k: Column, field: str) -> Column:
        return F.get(F.filter("_h", lambda h: (h["k"] == k) & (h["t"] <= F.col(asof))), F.lit(0))[field]

    k = F.col(index)
    last_quarter = k % 4 == 3
    quarters = sum([known(k - i, "v") for i in (1, 2, 3)], known(k, "v"))
    bridge = known(F.floor(k / 4) * 4 - 1, "y") + known(k, "y") - known(k - 4, "y")
    ways = {"ANNUAL": F.when(last_quarter, known(k, "y")), "FOUR_QUARTERS": quarters, "BRIDGE": F.when(~last_quarter, bridge)}
    method = reduce(lambda c, kv: c.when(kv[1].isNotNull(), kv[0]), ways.items(), F.when(F.lit(False), "")).otherwise("MISSING")
    return p.withColumn("ttm", F.coalesce(*ways.values())).withColumn("method", method).withColumn("approximate", F.col("method") == "BRIDGE").drop("_h")


def authority(base: DataFrame, key: list[str], value: str, sources: list[tuple[str, DataFrame]], blocked: DataFrame) -> DataFrame:
    """base with value and tier from the first source that has one for the key; keys in blocked get QUARANTINE and no value."""
    out = base
    for tier, src in sources:
        out = out.join(src.select(*key, F.col(value).alias(f"_{tier}")), key, "left")
    out = out.join(blocked.select(*key, F.lit(True).alias("_blocked")), key, "left")
    tier = reduce(lambda c, t: c.when(F.col(f"_{t}").isNotNull(), t), [t for t, _ in sources], F.when(F.col("_blocked"), "QUARANTINE")).otherwise("MISSING")
    found = F.when(F.col("_blocked").isNull(), F.coalesce(*[F.col(f"_{t}") for t, _ in sources]))
    return out.select(*base.columns, found.alias(value), tier.alias("tier"))


def known_before(df: DataFrame, cutoff: str, *times: str) -> DataFrame:
    """The view of df that was known before the cutoff: every time in the row lies before it."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(t) < F.lit(cutoff).cast("timestamp") for t in times]))


def lag_columns(df: DataFrame, array: str, n: int, prefix: str = "lag", mask: str = "observed") -> DataFrame:
    """df with array (newest last) as columns lag_0 .. lag_n-1 and whether each is there."""
    at = lambda i: F.try_element_at(array, F.lit(-1 - i))
    return df.withColumns({f"{prefix}_{i}": at(i) for i in range(n)} | {f"{mask}_{i}": at(i).isNotNull().cast("int") for i in range(n)}).drop(array)


def lags_long(df: DataFrame, key: list[str], array: str) -> DataFrame:
    """key, position (0 is the oldest), value, mask: one row for each element of the array."""
    return df.select(*key, F.posexplode(array).alias("position", "value")).withColumn("mask", F.col("value").isNotNull().cast("int"))


def staleness(array: str) -> Column:
    """Steps back to the newest known element of an array (newest last); 0 if none is known."""
    newest = F.reverse(F.col(array))
    return F.greatest(F.array_position(F.transform(newest, lambda x: x.isNotNull()), True) - 1, F.lit(0))


def trimmed(array: str, least: int = 12, least_known: int = 8) -> Column:
    """The array up to its last known element, null if it is then shorter than `least` or holds fewer than `least_known`."""
    last = F.size(array) - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse(F.col(array)), lambda x: x.isNotNull()), True), F.lit(0)) - 1, F.size(array))
    out = F.slice(F.col(array), 1, last.cast("int"))
    return F.when((last >= least) & (F.size(F.filter(out, lambda x: x.isNotNull())) >= least_known), out)


def event_id(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object, in their order, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def forbidden_keys(json: Column, words: list[str]) -> Column:
    """Those of `words` that occur as keys at any depth of a JSON text."""
    keys = F.regexp_extract_all(F.lower(json), F.lit(r'"([^"\\]*)"\s*:'), F.lit(1))
    return F.array_sort(F.array_intersect(keys, F.array(*[F.lit(w) for w in words])))


def business_days(first: Column, last: Column) -> Column:
    """The weekdays from first to last as an array."""
    return F.filter(F.sequence(first, last), lambda x: F.weekday(x) < 5)


def quarter_starts(first: Column, n: Column) -> Column:
    """n quarter starts as an array, from first on, three months apart."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.add_months(first, i * 3))
