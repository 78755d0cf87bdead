"""Causal window operators: evidence is shifted before it is rolled, so a row never weighs itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.order_windows import sliding, sliding_means


def past(by: list[str], order: list[str], window: int, shift: int = 1) -> WindowSpec:
    """The `window` rows that end `shift` rows before the current one: shift and roll in one frame."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window + shift - 1), -shift)


def rolled(x: Column, spec: WindowSpec, least: int, how: str = "median") -> Column:
    """Median or mean of the non-null values of a frame, null for fewer than `least`."""
    stat = F.percentile(x, F.lit(0.5)) if how == "median" else F.avg(x)
    return F.when(F.count(x).over(spec) >= least, stat.over(spec))


def paired_losses(rows: DataFrame, by: list[str], order: list[str], target: str, a: str, b: str, window: int, least: int, shift: int = 1) -> DataFrame:
    """rows with n, loss_a and loss_b: count and mean losses of a and b over the frame's rows where all three are there; losses null until `least`."""
    ok = F.col(target).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    r = rows.withColumns({f"_{s}": F.when(ok, F.abs(F.col(c) - F.col(target))) for s, c in (("a", a), ("b", b))})
    r = sliding_means(r, by, order, ["_a", "_b"], window, shift)
    enough = F.col("n__a") >= least
    return r.withColumns({"n": F.col("n__a"), "loss_a": F.when(enough, F.col("mean__a")), "loss_b": F.when(enough, F.col("mean__b"))}).drop("_a", "_b", "n__a", "n__b", "mean__a", "mean__b")


def gate_weight(base_loss: Column, other_loss: Column, present: Column, margin: float, temperature: float, most: float) -> Column:
    """Weight of the challenger: 0 unless its gain passes the margin, then rising to `most`."""
    gain = base_loss - other_loss
    return F.when(present & (gain > margin), most * (1 - F.exp(-(gain - margin) / temperature))).otherwise(0.0)


def prior_softmax(loss_a: Column, loss_b: Column, prior_a: float, prior_b: float, temperature: float) -> Column:
    """Weight of b: softmax of log prior minus loss over temperature, the priors while losses are missing."""
    score = F.ln(F.lit(prior_a) / prior_b) - (loss_a - loss_b) / temperature
    return F.when(loss_a.isNull() | loss_b.isNull(), prior_b / (prior_a + prior_b)).otherwise(1 / (1 + F.exp(score)))


def causal_rank(rows: DataFrame, by: list[str], order: list[str], x: str, window: int, least: int, shift: int = 1) -> DataFrame:
    """rows with pct (percentile of x among the frame's values) and z (robust, by median and 1.4826 MAD), null below `least` values."""
    r = sliding(rows, by, order, x, window, shift, count="_n", rank="pct", robust_z="z")
    ok = F.col("_n") >= least
    return r.withColumns({c: F.when(ok, F.col(c)) for c in ("pct", "z")}).drop("_n")


def forward_median(rows: DataFrame, by: list[str], order: list[str], x: str, ahead: int, name: str) -> DataFrame:
    """rows with the median of the next `ahead` rows, null unless all of them have a value: the trailing one, read `ahead` rows later."""
    r = sliding(rows, by, order, x, ahead, 0, linear={"_mid": 0.5}, count="_n")
    later = F.lead(F.when(F.col("_n") == ahead, F.col("_mid")), ahead).over(Window.partitionBy(*by).orderBy(*order))
    return r.withColumn(name, later).drop("_mid", "_n")


def islands(rows: DataFrame, by: list[str], order: list[str], start: Column, name: str = "island") -> DataFrame:
    """Number the stretches of each series; a row where `start` holds begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def causal_fill(x: Column, by: list[str], order: list[str], pos: str, season: int = 4) -> Column:
    """A missing value takes the last known one of its season (from the second season on), else the one before, else 0.

    Closed form of the recurrence: within the first season the last value known so
    far, afterwards the last one of the same place in the season, seeds included.
    """
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seed = F.coalesce(F.last(x, ignorenulls=True).over(upto), F.lit(0.0))
    return F.when(F.col(pos) < season, seed).otherwise(x)


def filled(rows: DataFrame, x: str, by: list[str], order: list[str], pos: str, out: str, season: int = 4) -> DataFrame:
    seeded = rows.withColumn("_s", causal_fill(F.col(x), by, order, pos, season))
    per = Window.partitionBy(*by, F.col(pos) % season).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return seeded.withColumn(out, F.coalesce(F.last("_s", ignorenulls=True).over(per), F.lit(0.0))).drop("_s")


def ar1(rows: DataFrame, by: list[str], order: str, position: str, x: str, bound: float = 0.95, least: int = 63) -> DataFrame:
    """Zero-intercept AR(1) of each series on pairs of neighbouring positions: rho, pairs and last value that is not missing."""
    w = Window.partitionBy(*by).orderBy(order)
    p = rows.withColumn("_x", F.lag(x).over(w)).withColumn("_p", F.lag(position).over(w))
    pair = (F.col("_p") + 1 == F.col(position)) & F.col("_x").isNotNull() & F.col(x).isNotNull()
    n, xy, xx = F.count(F.when(pair, 1)), F.sum(F.when(pair, F.col("_x") * F.col(x))), F.sum(F.when(pair, F.col("_x") * F.col("_x")))
    out = p.groupBy(*by).agg(n.alias("pairs"), xy.alias("xy"), xx.alias("xx"), F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias("last_value"))
    rho = F.when((F.col("pairs") >= least) & (F.col("xx") > 0), F.least(F.greatest(F.col("xy") / F.col("xx"), F.lit(-bound)), F.lit(bound))).otherwise(0.0)
    return out.select(*by, "pairs", rho.alias("rho"), "last_value")


def mean_percent_rank(x: Column, by: list[str]) -> Column:
    """Rank as a share of the group, equal values sharing the mean of their ranks."""
    w = Window.partitionBy(*by)
    return (F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2) / F.count(x).over(w)


def matured_gate(rows: DataFrame, by: list[str], order: list[str], base: list[str], other: list[str], label: str, horizon: int, window: int, least: int, margin: float, temperature: float, most: float, classwise: bool = False) -> DataFrame:
    """rows with blended probabilities mix_0.. and for each gate its weight_, gain_ and count_.

    base and other are class probabilities (null where not usable) and label is a
    class number that is known `horizon` rows later. Losses of both are averaged
    over the same matured rows: log loss for one gate over all classes, squared
    error for one gate a class. A gate opens if its gain passes the margin; its
    weight is then most x sigmoid((gain - margin) / temperature).
    """
    from tidemark.functions import scalars as S

    b, o = [F.col(c) for c in base], [F.col(c) for c in other]
    b_ok, o_ok, y = b[0].isNotNull(), o[0].isNotNull(), F.col(label)
    both = b_ok & o_ok
    known = both & y.isNotNull()
    if classwise:
        pairs_ = [(F.pow(p - F.when(y == k, 1.0).otherwise(0.0), 2), F.pow(q - F.when(y == k, 1.0).otherwise(0.0), 2)) for k, (p, q) in enumerate(zip(b, o))]
    else:
        pairs_ = [(S.log_loss(b, y), S.log_loss(o, y))]
    losses = {f"_{s}{k}": F.when(known, x) for k, pair in enumerate(pairs_) for s, x in zip("pq", pair)}
    out = sliding_means(rows.withColumns(losses), by, order, list(losses), window, horizon)
    for k in range(len(pairs_)):
        gain = F.when(F.col(f"n__p{k}") >= least, F.col(f"mean__p{k}") - F.col(f"mean__q{k}"))
        out = out.withColumns({f"count_{k}": F.col(f"n__p{k}"), f"gain_{k}": gain})
    out = out.drop(*losses, *[f"{a}_{c}" for a in ("n", "mean") for c in losses])
    weight = lambda k: F.when(both & (F.col(f"gain_{k}") > margin), most * S.sigmoid((F.col(f"gain_{k}") - margin) / temperature)).otherwise(0.0)
    out = out.withColumns({f"weight_{k}": weight(k) for k in range(len(pairs_))})
    raw = [(1 - F.col(f"weight_{k if classwise else 0}")) * p + F.col(f"weight_{k if classwise else 0}") * q for k, (p, q) in enumerate(zip(b, o))]
    total = sum(raw[1:], raw[0])
    out = out.withColumns({f"mix_{k}": F.when(both, x / total).otherwise(F.coalesce(p, q)) for k, (x, p, q) in enumerate(zip(raw, b, o))})
    return out.withColumn("source", F.when(both, "none").when(b_ok, "incumbent_only").when(o_ok, "challenger_only").otherwise("unavailable"))


def ar_forecast(rho: Column, last: Column, steps: Column, bound: float | None = None) -> Column:
    """rho^steps x last, kept within +- bound."""
    from tidemark.functions import scalars as S

    out = F.pow(rho, steps) * last
    return out if bound is None else S.clip(out, -bound, bound)


def lifecycle(rows: DataFrame, by: list[str], revision: str, status: str, allowed: list[tuple[str, str]], fixed: list[str], final: list[str], order: list[str] | None = None) -> DataFrame:
    """by, revision and code of each violation: revisions start at 0 and have no gaps, only allowed changes
    of status happen, `fixed` columns never change and `final` ones not once they are set."""
    from tidemark.functions import scalars as S

    w = Window.partitionBy(*by).orderBy(*(order or [revision]))
    before = lambda c: F.lag(c).over(w)
    first = F.row_number().over(w) == 1
    r = rows.withColumns({"_first": first, "_rev": before(revision), "_status": before(status)} | {f"_{c}": before(c) for c in [*fixed, *final]})
    ok = F.concat_ws(">", "_status", status).isin(*[f"{a}>{b}" for a, b in allowed])
    rules = [(F.col("_first") & (F.col(revision) != 0), "START"), (~F.col("_first") & (F.col(revision) != F.col("_rev") + 1), "GAP"), (~F.col("_first") & ~ok, "TRANSITION")]
    rules += [(~F.col("_first") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), f"CHANGED_{c}") for c in fixed]
    rules += [(F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), f"REVISED_{c}") for c in final]
    return r.select(*by, revision, F.explode(S.codes(*rules)).alias("code"))
