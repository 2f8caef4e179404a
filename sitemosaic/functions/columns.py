"""Column expressions: everything here stays inside Spark's generated code."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import constants as C

UNROLL_LIMIT = 64


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- clipping and safe functions ---------------------------------------------
def clip(x, lo: float = -2.5, hi: float = 2.5) -> Column:
    return F.greatest(F.least(col(x), F.lit(float(hi))), F.lit(float(lo)))


def clip_propensity(x) -> Column:
    return clip(x, *C.PROPENSITY_CLIP)


def clip_outcome(x, family: str = "binomial") -> Column:
    if family == "binomial":
        return clip(x, *C.OUTCOME_CLIP)
    if family == "gaussian":
        return col(x)
    raise ValueError(f"unsupported family {family!r}")


def truncate(x, radius: float = C.RADIUS) -> Column:
    """Symmetric truncation to [-radius, radius]; an infinite radius is the identity."""
    return col(x) if radius == float("inf") else clip(x, -radius, radius)


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)))


def safe_log(x, eps: float = C.EPSILON) -> Column:
    return F.ln(F.greatest(col(x), F.lit(eps)))


# -- coding of raw columns ----------------------------------------------------
def code_binary(c, yes: Sequence[str], no: Sequence[str]) -> Column:
    t = F.upper(F.regexp_replace(col(c).cast("string"), r"\s+", ""))
    return F.when(t.isin(*yes), 1).when(t.isin(*no), 0).cast("int")


def code_duration(start, end) -> Column:
    """Difference of two day numbers; dates and timestamps are compared by day."""
    return (col(end) - col(start)).cast("double")


def missing_indicator(c) -> Column:
    c = col(c)
    return (c.isNull() | (F.trim(c.cast("string")) == "")).cast("int")


def combine_indicators(*cols) -> Column:
    return reduce(lambda x, y: x | y, [F.coalesce(col(c) == 1, F.lit(False)) for c in cols]).cast("int")


def merge_levels(c, levels: Sequence[str], label: str) -> Column:
    return F.when(col(c).isin(*levels), F.lit(label)).otherwise(col(c))


def flag01(c) -> Column:
    """1/yes/true -> 1, anything else (NULL included) -> 0."""
    return F.coalesce(F.upper(col(c).cast("string")).isin("1", "YES", "TRUE"), F.lit(False)).cast("int")


def parse_bool(c) -> Column:
    t = F.upper(F.trim(col(c).cast("string")))
    return F.when(t.isin("TRUE", "T", "1"), True).when(t.isin("FALSE", "F", "0"), False)


def group_key(c) -> Column:
    """NULL and blank keys become one visible group."""
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit("<unspecified>"))


def finite(c) -> Column:
    """NaN and infinities to NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def lookup(c, mapping: Mapping) -> Column:
    """Value of a small literal map; NULL when absent."""
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])[col(c)]


# -- linear predictors --------------------------------------------------------
def dot(x, beta, p: int) -> Column:
    """Inner product of two array columns with p entries."""
    x, beta = col(x), col(beta)
    if p <= UNROLL_LIMIT:
        return reduce(lambda s, i: s + x[i] * beta[i], range(1, p), x[0] * beta[0]) if p else F.lit(0.0)
    return F.aggregate(F.zip_with(x, beta, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def linear_predictor(x, beta, p: int) -> Column:
    """Intercept first: beta[0] + x . beta[1:]."""
    x, beta = col(x), col(beta)
    if p <= UNROLL_LIMIT:
        return reduce(lambda s, i: s + x[i] * beta[i + 1], range(p), beta[0])
    return beta[0] + dot(x, F.slice(beta, 2, p), p)


def mean_response(eta, family: str) -> Column:
    return logistic(eta) if family == "binomial" else col(eta)


def mean_slope(eta, family: str) -> Column:
    if family != "binomial":
        return F.lit(1.0)
    h = logistic(eta)
    return h * (F.lit(1.0) - h)


def sig(c, digits: int = 6) -> Column:
    return F.round(col(c), digits)
