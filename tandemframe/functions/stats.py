"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import StutterModel


def upper_median(values: Column) -> Column:
    """Of an array: the upper of the two middle values; NULL if empty."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def two_sided_binomial_p(k: Column, n: Column) -> Column:
    """Exact, p = 0.5: min(1, 2 P(X <= min(k, n - k))); 1 if n is not positive.
    The first term in logarithms, so that it holds beyond a thousand reads."""
    low = F.least(k, n - k)
    state = F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("sum"))

    def step(s, i):
        log_c = F.when(i == 0, F.lit(0.0)).otherwise(s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")))
        return F.struct(log_c.alias("log_c"), (s["sum"] + F.exp(log_c - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), F.greatest(low, F.lit(0)).cast("int")), state, step, lambda s: s["sum"])
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def stutter_rate(lus: Column, step: Column, model: StutterModel) -> Column:
    clamped = F.least(F.greatest(lus, F.lit(model.lus_min)), F.lit(model.lus_max))
    factor = F.lit(0.0)
    for k, v in model.step_factors.items():
        factor = F.when(step == k, F.lit(float(v))).otherwise(factor)
    return F.exp(F.lit(model.log_intercept) + model.log_slope * clamped) * factor


def pooled_ratio(part: Column, whole: Column) -> Column:
    """Of sums; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(F.sum(part), F.sum(whole)), F.lit(0.0))


def allele_balance(a: Column, b: Column) -> Column:
    return F.bround(F.greatest(a, b) / (a + b), 3)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
