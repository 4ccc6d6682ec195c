"""Statistics as Columns: score coercion, small-sample tests, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.core import let
from quernel.functions.text import strip

SCALE_MIN, SCALE_MAX = -10.0, 10.0
#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
#: Digits to which label thresholds are compared, so that the order of summation can't flip them.
LABEL_DIGITS = 9


def coerce_score(raw: Column) -> Column:
    """Any value as a score: its text as a number, 0 where it isn't one, cut to -10..10; NaN is 10."""
    text = strip(raw.cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"), F.regexp_replace(text, "_", "").try_cast("double"))
    named = F.lower(text)
    special = F.when(named.rlike(r"^\+?(inf|infinity)$"), SCALE_MAX).when(named.rlike(r"^-(inf|infinity)$"), SCALE_MIN).when(named.rlike(r"^[+-]?nan$"), SCALE_MAX)
    value = F.coalesce(number, special, F.lit(0.0))
    return F.greatest(F.lit(SCALE_MIN), F.least(F.lit(SCALE_MAX), value))


def sample_stdev(c: Column) -> Column:
    """Aggregate: standard deviation with n - 1, and 0 for fewer than two values.

    Equal values have exactly 0: partial means of them may differ in the last bit.
    """
    return F.when(F.max(c) - F.min(c) == 0, 0.0).otherwise(F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the finite
    trigonometric series for odd and even ones; 1 for none."""
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")

    def central(theta: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("total"), F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).alias("term"))

        def series(square: Column) -> Column:
            def step(z: Column, k: Column) -> Column:
                ratio = F.when(odd, 2.0 * k / (2.0 * k + 1.0)).otherwise((2.0 * k - 1.0) / (2.0 * k))
                return F.struct((z["total"] + z["term"]).alias("total"), (z["term"] * ratio * square).alias("term"))

            return F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda z: z["total"])

        summed = F.when(terms >= 1, let(F.cos(theta) * F.cos(theta), series)).otherwise(0.0)
        return F.when(odd, 2.0 / F.pi() * (theta + F.sin(theta) * summed)).otherwise(F.sin(theta) * summed)

    inside = let(F.atan(F.abs(t) / F.sqrt(df.cast("double"))), central)
    return F.when(t.isNull() | df.isNull(), F.lit(None).cast("double")).when(df <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - inside)))


def polarity(mean: Column) -> Column:
    m = F.round(mean, LABEL_DIGITS)
    return F.when(m >= 6, "very positive").when(m >= 2, "positive").when(m > -2, "neutral / mixed").when(m > -6, "negative").otherwise("very negative")


def confidence(p: Column) -> Column:
    q = F.round(p, LABEL_DIGITS)
    return F.when(p.isNull(), "insufficient-data").when(q < 0.01, "high").when(q < 0.05, "moderate").when(q < 0.1, "low").otherwise("not-significant")


def summary_columns(n: Column, mean: Column, volatility: Column) -> dict[str, Column]:
    """Standard error, t, p and the normal 95 % interval of segment means, with their
    degenerate cases: one segment has none of these; segments that agree exactly have
    t 0 and p 1 at mean 0, no t and p 0 elsewhere, and an interval of one point."""
    error = F.when(n >= 2, volatility / F.sqrt(n.cast("double"))).otherwise(0.0)
    several, spread = n >= 2, error != 0
    t = F.when(several & spread, mean / error).when(several & (mean == 0), 0.0)
    p = F.when(several & spread, t_p_value(mean / error, n - 1)).when(several, F.when(mean == 0, 1.0).otherwise(0.0))
    return {
        "std_error": error,
        "t_statistic": t,
        "p_value": p,
        "ci_low": F.when(several, mean - Z95 * error),
        "ci_high": F.when(several, mean + Z95 * error),
    }
