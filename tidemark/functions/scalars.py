"""Scalar expressions over nullable doubles: a value that is not finite is missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x as a double, null unless it is finite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < math.inf), d)


def positive(x: Column) -> Column:
    """x where it is finite and above zero, else null."""
    d = finite(x)
    return F.when(d > 0, d)


def safe_log(x: Column) -> Column:
    return F.ln(positive(x))


def ieee_log(x: Column) -> Column:
    """ln(x) as floating point has it: minus infinity at zero, NaN below; null stays null."""
    return F.when(x == 0, -math.inf).when(x < 0, math.nan).otherwise(F.ln(x))


def safe_exp(x: Column) -> Column:
    """exp(x), null on overflow."""
    return finite(F.exp(finite(x)))


def clip(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def sigmoid(x: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-clip(x, -bound, bound)))


def ratio(num: Column, den: Column, least: float = 1.0) -> Column:
    """num / den where den is larger than `least` in size, else null."""
    return F.when(F.abs(den) > least, num / den)


def ieee_ratio(num: Column, den: Column) -> Column:
    """num / den as floating point has it: by zero infinite with the sign of num, and NaN for 0 / 0; null stays null."""
    by_zero = F.when((num == 0) | F.isnan(num), math.nan).otherwise(F.signum(num) * math.inf)
    return F.when(den == 0, by_zero).otherwise(F.try_divide(num, den))


def wrapped(x: Column) -> Column:
    """A whole decimal, not negative, modulo 2^64 as a long (as 64-bit addition wraps)."""
    whole, half = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (64, 63))  # text: a literal is a long at most
    low = x % whole
    return F.when(low >= half, low - whole).otherwise(low).cast("long")


def simplex(parts: list[Column], floor: float = 0.0) -> list[Column]:
    """Parts raised to the floor and divided by their sum; all null unless every part is finite and none negative."""
    raised = [F.greatest(p, F.lit(floor)) for p in parts]
    total = sum(raised[1:], raised[0])
    ok = total > 0
    for p in parts:
        ok = ok & finite(p).isNotNull() & (p >= 0)
    return [F.when(ok, r / total) for r in raised]


def entropy(parts: list[Column]) -> Column:
    """Shannon entropy of probabilities over its largest value."""
    terms = [F.when(p > 0, -p * F.ln(p)).when(p.isNotNull(), F.lit(0.0)) for p in parts]
    return sum(terms[1:], terms[0]) / math.log(len(parts))


def argmax_label(parts: list[Column], labels: list[str], missing: str = "UNKNOWN") -> Column:
    """Label of the largest part, the first one listed among equals."""
    top = F.greatest(*parts)
    out = F.when(sum([p.isNull().cast("int") for p in parts[1:]], parts[0].isNull().cast("int")) > 0, F.lit(missing))
    for p, label in zip(parts, labels):
        out = out.when(p == top, F.lit(label))
    return out.otherwise(F.lit(missing))


def geometric_blend(a: Column, b: Column, weight: Column) -> Column:
    """a^(1-w) b^w for positive values; the side that is there if the other is missing."""
    a, b = positive(a), positive(b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.exp((1 - weight) * F.ln(a) + weight * F.ln(b)))


def log_loss(parts: list[Column], truth: Column) -> Column:
    """-ln of the probability given to class number `truth` (from 0)."""
    return -F.ln(F.element_at(F.array(*parts), truth + 1))


def brier(parts: list[Column], truth: Column) -> Column:
    terms = [F.pow(p - F.when(truth == k, 1.0).otherwise(0.0), 2) for k, p in enumerate(parts)]
    return sum(terms[1:], terms[0])


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / half_life_days)


def relative_gain(error: Column, base: Column) -> Column:
    """1 - error / base, null unless base is above zero."""
    return F.when(base > 0, 1 - error / base)


def direction_hit(actual: Column, forecast: Column, origin: Column) -> Column:
    return F.signum(actual - origin) == F.signum(forecast - origin)


def rearranged(quantiles: list[Column]) -> Column:
    """Quantiles in rising order (array); null if any is missing."""
    a = F.array(*quantiles)
    return F.when(~F.exists(a, lambda x: x.isNull() | F.isnan(x)), F.array_sort(a))


def crossings(quantiles: list[Column]) -> Column:
    """How many neighbours stand in falling order."""
    terms = [F.when(a > b, 1).otherwise(0) for a, b in zip(quantiles, quantiles[1:])]
    return sum(terms[1:], terms[0])


def laplace_crps(y: Column, location: Column, scale: Column) -> Column:
    z = F.abs(y - location) / scale
    return F.when(scale > 0, scale * (z + F.exp(-z) - 0.75))


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    return (high - low) + 2 / alpha * F.greatest(low - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - high, F.lit(0.0))


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def codes(*rules: tuple[Column, str]) -> Column:
    """The codes of all rules that hold, in order, as an array."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in rules]), lambda x: x.isNotNull())


def safe_expm1(x: Column) -> Column:
    """exp(x) - 1, null on overflow."""
    return finite(F.expm1(finite(x)))


def unit_code(net: Column, shares: Column, per_share: Column) -> Column:
    """What net / (shares x per share) says about units: HIGH above 10, LOW below 0.1, SIGN below zero, else OK; null without a ratio."""
    r = net / F.nullif(shares * per_share, F.lit(0.0))
    return F.when(r < 0, "SIGN").when(F.abs(r) > 10, "HIGH").when(F.abs(r) < 0.1, "LOW").when(r.isNotNull(), "OK")


def truth_value(text: Column) -> Column:
    """true, false or null for the usual spellings."""
    s = F.lower(F.trim(text))
    return F.when(s.isin("true", "t", "yes", "y", "1"), True).when(s.isin("false", "f", "no", "n", "0"), False)


def bounded_decimal(text: Column, low: float, high: float, precision: int = 18, scale: int = 6) -> Column:
    """A plain decimal number within bounds, else null: no exponents, no blanks within."""
    s = F.trim(text)
    d = F.when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), s.try_cast(f"decimal({precision},{scale})"))
    return F.when(d.between(low, high), d.cast("double"))


def forward_label(now: Column, later: Column, low: float, high: float) -> Column:
    """DOWN, FLAT or UP by the return from now to later; null if either is missing."""
    r = later / F.nullif(now, F.lit(0.0)) - 1
    return F.when(r <= low, "DOWN").when(r >= high, "UP").when(r.isNotNull(), "FLAT")


def vintage_weight(confidence: Column, disagreement: Column, approximate: Column, floor: float = 5.0, ceiling: float = 100.0, discount: float = 0.5) -> Column:
    """Clipped confidence as a share, discounted for approximations and divided by 1 + disagreement (missing: 0)."""
    share = clip(finite(confidence), floor, ceiling) / ceiling
    w = share * F.when(approximate, discount).otherwise(1.0) / (1 + F.greatest(F.coalesce(disagreement, F.lit(0.0)), F.lit(0.0)))
    return F.when(approximate.isNotNull() & (w > 0), w)


def valuation_state(percentile: Column, gap: Column, z: Column | None, negative: Column, cheap: float, dear: float, least_gap: float, least_z: float = 0.0) -> Column:
    """CHEAP or DEAR where rank, gap and, if given, robust z all say so; a negative base overrides everything."""
    z_low, z_high = (z <= -least_z, z >= least_z) if z is not None else (F.lit(True), F.lit(True))
    known = percentile.isNotNull() & gap.isNotNull()
    return (
        F.when(negative, "NO_MEANING")
        .when(known & (percentile >= dear) & (gap >= least_gap) & z_high, "DEAR")
        .when(known & (percentile <= cheap) & (gap <= -least_gap) & z_low, "CHEAP")
        .when(known, "NORMAL")
        .otherwise("INSUFFICIENT_DATA")
    )


def valuation_confidence(data: Column, rows: Column, gain: Column, a: Column, b: Column, meaningful: Column) -> Column:
    """0.45 data quality, 0.25 length of history, 0.15 certainty of a gain, 0.15 agreement of two forecasts; 0 if not meaningful."""
    agreement = F.exp(-F.coalesce(F.abs(safe_log(a / F.nullif(b, F.lit(0.0)))), F.lit(1.0)))
    total = 0.45 * F.coalesce(data, F.lit(0.0)) / 100 + 0.25 * F.least(F.coalesce(rows, F.lit(0)) / 504.0, F.lit(1.0)) + 0.15 * F.tanh(F.abs(F.coalesce(gain, F.lit(0.0))) / 0.02) + 0.15 * agreement
    return F.when(meaningful, clip(total, 0.0, 1.0)).otherwise(0.0)


def masked(df, invalid: Column, null: list[str] = (), zero: list[str] = (), false: list[str] = ()):
    """df with the named columns null, zero or false where a row is invalid; all other columns as they are."""
    put = {c: F.lit(None) for c in null} | {c: F.lit(0.0) for c in zero} | {c: F.lit(False) for c in false}
    return df.select(*[F.when(~F.coalesce(invalid, F.lit(True)), F.col(c)).otherwise(put[c]).alias(c) if c in put else F.col(c) for c in df.columns])


#: Coefficients of formula 26.2.17 of Abramowitz and Stegun (1964): fixed values.
_PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal law, with an error under 1e-7."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in reversed(_PHI):
        poly = (poly + c) * t
    upper = normal_density(z) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_crps(y: Column, location: Column, scale: Column) -> Column:
    z = (y - location) / scale
    return F.when(scale > 0, scale * (z * (2 * normal_cdf(z) - 1) + 2 * normal_density(z) - 1 / math.sqrt(math.pi)))


def normal_nll(y: Column, location: Column, scale: Column) -> Column:
    z = (y - location) / scale
    return F.when(scale > 0, 0.5 * math.log(2 * math.pi) + F.ln(scale) + z * z / 2)


def laplace_nll(y: Column, location: Column, scale: Column) -> Column:
    return F.when(scale > 0, F.ln(2 * scale) + F.abs(y - location) / scale)


def laplace_cdf(y: Column, location: Column, scale: Column) -> Column:
    """Also the probability integral transform of y."""
    z = (y - location) / scale
    return F.when(scale > 0, F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2))


def spread_columns(p10: Column, p25: Column, p75: Column, p90: Column) -> list[Column]:
    """iqr, idr, robust_sigma (on logs) and ratio of positive, strictly rising quantiles; all null otherwise."""
    ok = (p10 > 0) & (p10 < p25) & (p25 < p75) & (p75 < p90)
    iqr = F.ln(p75) - F.ln(p25)
    return [F.when(ok, iqr).alias("iqr"), F.when(ok, F.ln(p90) - F.ln(p10)).alias("idr"), F.when(ok, iqr / 1.3489795003921634).alias("robust_sigma"), F.when(ok, p90 / p10).alias("ratio")]


def model_family(name: Column, prefixes: dict[str, str], suffixes: dict[str, str], other: str) -> Column:
    """The family of the first prefix, then suffix, that the name has."""
    out = None
    for cond, value in [(name.startswith(p), v) for p, v in prefixes.items()] + [(name.endswith(s), v) for s, v in suffixes.items()]:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def strict_json(text: Column, schema: str, keys: list[str]) -> Column:
    """The parsed object, null unless its keys are exactly `keys`, once each, and no value is NaN or Infinity.

    json_object_keys lists repeated keys twice, which from_json alone would hide."""
    found = F.json_object_keys(text)
    ok = (F.size(found) == len(keys)) & (F.array_sort(found) == F.array(*[F.lit(k) for k in sorted(keys)])) & ~text.rlike(r":\s*(NaN|-?Infinity)")
    return F.when(ok, F.from_json(text, schema))


def ladder(*rules: tuple[Column, str], other: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def role(eligible: Column, ensemble: Column, baseline: Column, member: Column, gains: Column, coverage: Column) -> Column:
    """The standing of a model, by the first rule that it meets."""
    return ladder((~eligible, "INELIGIBLE"), (ensemble, "ENSEMBLE"), (baseline, "BASELINE"), (member, "MEMBER"), (gains > 0, "LANE_SURVIVOR"), (coverage < 0.95, "NARROW"), other="NO_GAIN")


def row_mean(parts: list[Column], how: str, weights: list[float] | None = None) -> Column:
    """mean, median, trimmed (without the least and the greatest) or weighted mean of a row; null unless all parts are finite."""
    a = F.array_sort(F.array(*parts))
    n = len(parts)
    ok = ~F.exists(a, lambda x: finite(x).isNull())
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    if how == "median":
        out = a[n // 2] if n % 2 else (a[n // 2 - 1] + a[n // 2]) / 2
    elif how == "trimmed":
        out = total(F.slice(a, 2, n - 2)) / (n - 2)
    elif how == "weighted":
        out = sum([p * w for p, w in zip(parts[1:], weights[1:])], parts[0] * weights[0])
    else:
        out = total(a) / n
    return F.when(ok, out)
