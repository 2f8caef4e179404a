"""Cohort preparation: recoding, imputation, one-hot, scaling, splines, site collapsing.

Statistics are learned by aggregates over training rows and applied as column
expressions, so a chain of these operators stays one narrow plan after the
statistics are known.
"""
from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .. import constants as C
from ..functions import clip, col
from ..storage import checkpoint
from .folds import balanced_number, hash_order
from .joins import attach
from .quantiles import exact_quantiles

NUMERIC_TOKEN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


# -- recoding ------------------------------------------------------------------
def recode_labels(df: DataFrame, column: str, mapping: Mapping[str, str | None], check: bool = False) -> DataFrame:
    """Map labels; a label mapped to None drops its rows; unmapped labels pass through."""
    if check:
        seen = {r[0] for r in df.filter(F.col(column).isin(list(mapping))).select(column).distinct().collect()}
        unknown = sorted(set(mapping) - seen)
        if unknown:
            warnings.warn(f"labels not present in {column}: {unknown}")
    dropped = [k for k, v in mapping.items() if v is None]
    kept = {k: v for k, v in mapping.items() if v is not None}
    c = F.col(column)
    out = df.filter(c.isNull() | ~c.isin(dropped)) if dropped else df
    if kept:
        table = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])
        out = out.withColumn(column, F.coalesce(table[c], c))
    return out


def observed_cases(df: DataFrame, treatment: str = "a", outcome: str = "y") -> DataFrame:
    return df.dropna(subset=[treatment, outcome])


def log1p_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p with renaming to log1p_<col>; negative values fail before anything is produced."""
    low = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols]).first().asDict()
    bad = [c for c, n in low.items() if n]
    if bad:
        raise ValueError(f"log1p requires non-negative values: {bad}")
    return df.select(*[F.log1p(c).alias(f"log1p_{c}") if c in cols else F.col(c) for c in df.columns])


def transform_features(df: DataFrame, cols: Sequence[str], kind: str = "strong", suffix: str = "_dagger") -> DataFrame:
    """Nonlinear working features, each rescaled by its sample standard deviation."""
    if kind not in ("strong", "mild", "none"):
        raise ValueError(f"unknown transform {kind!r}")
    x = [F.col(c) for c in cols]
    if kind == "none":
        return df.select("*", *[v.alias(c + suffix) for c, v in zip(cols, x)])
    if len(cols) < 4:
        raise ValueError("nonlinear transforms need at least four features")
    if kind == "mild":
        raw = [x[0] * x[0], x[0] * x[1], x[2] * x[2], x[1] + x[3]] + [v * v for v in x[4:]]
        scaled = len(cols)
    else:
        raw = [F.exp(0.5 * x[0]), 10 + x[1] / (1 + F.exp(x[0])),
               F.pow(0.04 * x[0] * x[2] + 0.5, F.lit(3.0)), F.pow(x[1] + x[3] + 20, F.lit(2.0))] + x[4:]
        scaled = 4
    names = [c + suffix for c in cols]
    out = df.select("*", *[r.alias(n) for r, n in zip(raw, names)])
    return standardize(out, names[:scaled], ddof=1)


# -- imputation ----------------------------------------------------------------
def _train(df: DataFrame, train_pred) -> DataFrame:
    return df if train_pred is None else df.filter(train_pred)


def numeric_tokens(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; blank is NULL, any other non-numeric token fails the job."""
    types = dict(df.dtypes)
    text = [c for c in cols if types[c] == "string"]
    if not text:
        return df

    def parse(c):
        t = F.trim(c)
        return (F.when(t.isNull() | (t == ""), None).when(t.rlike(NUMERIC_TOKEN), t.cast("double"))
                .otherwise(F.raise_error(F.concat(F.lit(f"non-numeric value in {c}: "), t)).cast("double")))

    return df.withColumns({c: parse(c) for c in text})


def impute_median(df: DataFrame, cols: Sequence[str], train_pred: Column | None = None,
                  approx: bool = False, accuracy: int = 100_000) -> DataFrame:
    """Fill NULLs with the median of the training rows."""
    cols = list(cols)
    df = numeric_tokens(df, cols)
    train = _train(df, train_pred)
    if approx:
        row = train.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in cols]).first().asDict()
        med = {c: row[c] for c in cols}
    else:
        med = {c: q[0] for c, q in exact_quantiles(train, cols, [0.5]).items()}
    empty = [c for c in cols if med[c] is None]
    if empty:
        raise ValueError(f"no observed value to impute from: {empty}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) for c in cols})


def mode_levels(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, mode): most frequent level, ties to the alphabetically first.

    Levels are counted with map-side combine first, so a level holding most rows
    costs one row per partition in the shuffle.
    """
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("s"))
    counts = long.select(*by, "s.column", "s.level").filter("level IS NOT NULL").groupBy(*by, "column", "level").count()
    # max of (count, then the smaller label) without sorting a group
    top = counts.groupBy(*by, "column").agg(F.max("count").alias("top"))
    tied = counts.join(top, [*by, "column"]).filter(F.col("count") == F.col("top"))
    return tied.groupBy(*by, "column").agg(F.min("level").alias("mode"))


def impute_mode(df: DataFrame, cols: Sequence[str], train_pred: Column | None = None) -> DataFrame:
    """NULL and '' become the modal level; '' itself counts as a level when the mode is found."""
    modes = {r["column"]: r["mode"] for r in mode_levels(_train(df, train_pred), cols).collect()}
    missing = [c for c in cols if c not in modes]
    if missing:
        raise ValueError(f"no observed level to impute from: {missing}")
    return df.withColumns({c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(modes[c])).otherwise(F.col(c))
                           for c in cols})


# -- encoding ------------------------------------------------------------------
def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Treatment coding: one 0/1 column per level but the first, so the levels are part of the result's schema.
    With a fixed dictionary, unknown levels fail."""
    if levels is None:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("l"))
                                             for c in cols])).alias("s")).select("s.*").filter("l IS NOT NULL").distinct()
        found: dict[str, list[str]] = {c: [] for c in cols}
        for r in long.collect():
            found[r["c"]].append(r["l"])
        levels = {c: sorted(v) for c, v in found.items()}
        guard = {}
    else:
        guard = {c: F.when(F.col(c).isin(list(levels[c])), F.col(c)).otherwise(
            F.raise_error(F.concat(F.lit(f"unknown level in {c}: "), F.coalesce(F.col(c), F.lit("NULL")))).cast("string"))
            for c in cols}
    out = df
    for c, g in guard.items():
        out = out.filter(g.isNotNull())  # evaluated even when no column of c survives
    hot = [F.when(F.col(c) == l, 1.0).otherwise(0.0).alias(f"{c}_{l}") for c in cols for l in list(levels[c])[1:]]
    return out.select(*[c for c in df.columns if c not in cols], *hot)


def level_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, index): a number within its column for every level but the first, for any number of levels.

    Levels are numbered by hash slices, so neither the driver nor one task holds a column's levels."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("s")).select("s.*")
    levels = long.filter("level IS NOT NULL").groupBy("column", "level").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    first = levels.groupBy("column").agg(F.min("level").alias("_first"))
    rest = attach(levels, first, ["column"]).filter(F.col("level") != F.col("_first")).drop("_first")
    ranked = balanced_number(rest.withColumn("_h", hash_order(0, "level")), ["column"], "_h", "level")
    return ranked.select("column", "level", F.col("_rank").cast("long").alias("index"))


def one_hot_sparse(df: DataFrame, key: str, cols: Sequence[str], dictionary: DataFrame) -> DataFrame:
    """(key, hot): treatment coding as the sorted (column, index) pairs that are 1. Rows stay with their reference levels, NULL and unknown levels as no pair.

    The key must be unique. The join is on (column, level), whose sizes adaptive execution knows and whose hot levels it splits."""
    long = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("s")).select(key, "s.*")
    hot = long.join(dictionary, ["column", "level"], "left").select(key, F.when(F.col("index").isNotNull(), F.struct("column", "index")).alias("_p"))
    return hot.groupBy(key).agg(F.sort_array(F.collect_list("_p")).alias("hot"))


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, train_pred: Column | None = None) -> DataFrame:
    """Centre and scale. ddof=0: constant columns keep scale 1. ddof=1: constant columns are only centred."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = [f for c in cols for f in (F.avg(c).alias(f"m_{c}"), sd(c).alias(f"s_{c}"))]
    s = _train(df, train_pred).agg(*aggs).first().asDict()
    tiny = 1.4901161193847656e-08 if ddof == 0 else 0.0

    def scale(c):
        v = s[f"s_{c}"]
        return 1.0 if v is None or not v > tiny else float(v)

    return df.withColumns({c: (F.col(c) - F.lit(float(s[f"m_{c}"]))) / F.lit(scale(c)) for c in cols})


def bspline_basis(x: Column, interior: Sequence[float], lo: float, hi: float, degree: int = 3) -> list[Column]:
    """B-spline basis columns (first one dropped: no intercept), by the recursive definition."""
    t = [lo] * (degree + 1) + list(interior) + [hi] * (degree + 1)
    last = len(t) - degree - 2
    xs = clip(x, lo, hi)
    basis: list[Column | None] = []
    for i in range(len(t) - 1):
        if t[i] == t[i + 1]:
            basis.append(None)
        else:
            upper = (xs <= t[i + 1]) if i == last else (xs < t[i + 1])
            basis.append(F.when((xs >= t[i]) & upper, 1.0).otherwise(0.0))
    for d in range(1, degree + 1):
        nxt: list[Column | None] = []
        for i in range(len(t) - 1 - d):
            terms = []
            if basis[i] is not None and t[i + d] > t[i]:
                terms.append((xs - t[i]) / (t[i + d] - t[i]) * basis[i])
            if basis[i + 1] is not None and t[i + d + 1] > t[i + 1]:
                terms.append((t[i + d + 1] - xs) / (t[i + d + 1] - t[i + 1]) * basis[i + 1])
            nxt.append(None if not terms else terms[0] if len(terms) == 1 else terms[0] + terms[1])
        basis = nxt
    return [b if b is not None else F.lit(0.0) for b in basis[1:]]


def bspline_features(df: DataFrame, cols: Sequence[str], knots: int = 5, degree: int = 3) -> DataFrame:
    """Replace each non-binary column by its spline basis; knots at inner quantiles."""
    aggs = [f for c in cols for f in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
                                      F.count_if(~F.col(c).isin(0, 1)).alias(f"nb_{c}"))]
    s = df.agg(*aggs).first().asDict()
    cont = [c for c in cols if s[f"nb_{c}"]]
    q = exact_quantiles(df, cont, [(i + 1) / (knots + 1) for i in range(knots)]) if cont else {}
    # staged: one projection per column keeps the unrolled recursion small
    out = []
    for c in df.columns:
        if c in cont:
            basis = bspline_basis(F.col(c), q[c], float(s[f"lo_{c}"]), float(s[f"hi_{c}"]), degree)
            out += [b.alias(f"{c}_bs{j + 1}") for j, b in enumerate(basis)]
        else:
            out.append(F.col(c))
    return df.select(*out)


def collapse_sites(df: DataFrame, k: int, site: str = "site_var") -> DataFrame:
    """(raw_site, site_var, components, n): keep the k largest, fold the tail into the smallest kept site."""
    counts = df.groupBy(F.col(site).alias("raw_site")).agg(F.count(F.lit(1)).alias("n"))
    # one row per site from here on
    ranked = counts.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), F.asc("raw_site"))))
    kept = ranked.filter(F.col("r") <= k).select("r", F.col("raw_site").alias("site_var"))
    mapped = ranked.withColumn("k", F.least("r", F.lit(k))).join(kept.withColumnRenamed("r", "k"), "k")
    parts = mapped.groupBy("site_var").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "raw_site"))), lambda s: s["raw_site"]), ";")
        .alias("components"))
    return mapped.join(parts, "site_var").select("raw_site", "site_var", "components", "n", "r")


# -- weights and small statistics ----------------------------------------------
def normalize_log_weights(df: DataFrame, log_weight: str, by: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """Mean-one weights per group from log weights: shift by the maximum, floor, divide by the mean."""
    by = list(by)
    top = df.groupBy(*by).agg(F.max(log_weight).alias("_top"))
    floor = F.lit(C.LOG_SMALLEST_NORMAL)

    shifted = attach(df, top, by).withColumn("_w", F.exp(F.greatest(F.col(log_weight) - F.col("_top"), floor)))
    mean = shifted.groupBy(*by).agg(F.avg("_w").alias("_m"))
    return attach(shifted, mean, by).withColumn(out, F.col("_w") / F.col("_m")).drop("_top", "_w", "_m")


def unit_norm(df: DataFrame, column: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    by = list(by)
    n = df.groupBy(*by).agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("_n"))
    return attach(df, n, by).withColumn(out or column, F.when(F.col("_n") > 0, F.col(column) / F.col("_n")).otherwise(F.col(column))).drop("_n")


def weighted_mean(x, w=None) -> Column:
    return F.avg(col(x)) if w is None else F.sum(col(x) * col(w)) / F.sum(col(w))


def safe_var(x, floor: float = C.EPSILON) -> Column:
    return F.greatest(F.coalesce(F.var_samp(col(x)), F.lit(floor)), F.lit(floor))


# -- summaries and diagnostics -----------------------------------------------------
def site_summary(obs: DataFrame, features: str = "w") -> DataFrame:
    return obs.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == 1).alias("treated"),
        F.count_if(F.col("a") == 0).alias("control"), F.max(F.size(features)).alias("features"))


def cell_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("site").agg(*[
        F.count_if((F.col("a") == a) & (F.col("y") == y)).alias(f"n_a{a}_y{y}") for a in (0, 1) for y in (0, 1)])


def cell_diagnostics(obs: DataFrame, min_class: int = C.MIN_CLASS_FOR_FIT) -> DataFrame:
    """Smallest site x arm x outcome cells; empty cells count."""
    c = cell_counts(obs)
    cells = [F.col(f"n_a{a}_y{y}") for a in (0, 1) for y in (0, 1)]
    small = sum([(x < min_class).cast("long") for x in cells[1:]], (cells[0] < min_class).cast("long"))
    low = F.least(*cells)
    return c.agg(F.min(low).alias("min_cell"), F.min(F.when(F.col("site") == C.TARGET, low)).alias("min_target_cell"),
                 F.sum(small).alias("cells_below"))


def support_floor(source: DataFrame, moment: DataFrame, arm: int, p: int, z: str = "z") -> DataFrame:
    """Penalty floor of a density-ratio fit when a feature is constant within an arm.

    `moment` is one row with array column `moment` (intercept first).
    """
    tol, margin = 1.4901161193847656e-08, 1e-6
    # fixed values of the support check: tol, margin
    j = F.posexplode(z).alias("j", "x")
    arms = source.filter(F.col("a") == arm).select("site", j).groupBy("site", "j").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    const = (F.col("hi") - F.col("lo")) <= tol * F.greatest(F.lit(1.0), F.abs("lo"), F.abs("hi"))
    gap = F.when(const, F.abs(F.col("moment")[F.col("j") + 1] - (F.col("lo") + F.col("hi")) / 2 * F.col("moment")[0]))
    out = arms.crossJoin(moment.select("moment")).groupBy("site").agg(
        F.coalesce(F.max(gap), F.lit(0.0)).alias("raw"), F.count_if(const).alias("constant_features"))
    return out.select("site", "constant_features", F.when(
        F.col("raw") > 0, F.col("raw") + margin * F.greatest(F.lit(1.0), F.col("raw"))).otherwise(0.0).alias("lambda_floor"))


def weight_diagnostics(df: DataFrame, weight: str = "weight", by: str = "site", features: str | None = None,
                       p: int = 0, caps=C.DR_WEIGHT_CLIP) -> DataFrame:
    """ESS, upper quantiles, largest share, rows at the caps; quantiles per group are exact."""
    w = F.col(weight)
    base = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"), F.max(w).alias("max_weight"),
        (F.max(w) / F.sum(w)).alias("max_share"), F.count_if(w <= caps[0]).alias("at_lower"),
        F.count_if(w >= caps[1]).alias("at_upper"))
    return attach(base, grouped_quantiles(df, weight, by, {"p50": .5, "p90": .9, "p95": .95, "p99": .99}), [by])


def range_slice(x: str, cuts: Sequence[float]) -> Column:
    """Number of cut points below x: a balanced tree of comparisons, which stays in generated code."""
    edges, v = sorted({float(c) for c in cuts}), F.col(x)

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > edges[mid], between(mid + 1, hi)).otherwise(between(lo, mid))

    if len(edges) <= 256:
        return between(0, len(edges))
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < v))


def _interpolated(by: Sequence[str], probs: Mapping[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over counted values (_x, ranks _lo to _hi of _tot) and, from them, the interpolated quantiles."""
    aggs = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("_tot") - 1)
        aggs += [F.max(F.when((F.col("_lo") <= e) & (e < F.col("_hi")), F.col("_x"))).alias(f"{name}_{t}")
                 for t, e in (("l", F.floor(h)), ("h", F.ceil(h)))]
        aggs.append(F.max(h - F.floor(h)).alias(f"{name}_f"))
    return aggs, [(F.col(f"{n}_l") + (F.col(f"{n}_h") - F.col(f"{n}_l")) * F.col(f"{n}_f")).alias(n) for n in probs]


def bracket_counts(rows: DataFrame, by: Sequence[str], brackets: DataFrame, k: int) -> DataFrame:
    """Counts of the values of column _x: each value inside one of its group's k brackets (_e: low and high ends, none for a group that is counted
    whole) by itself, the values of each stretch outside them as one row without _x. _s orders the stretches."""
    j = attach(rows, brackets, by)
    lo, hi = [F.col("_e")[2 * i] for i in range(k)], [F.col("_e")[2 * i + 1] for i in range(k)]
    inside, at = F.col("_e").isNull(), F.lit(0)
    for a, b in zip(lo, hi):
        inside = inside | ((F.col("_x") >= a) & (F.col("_x") <= b))
        at = at + (F.col("_x") >= a).cast("int") + (F.col("_x") > b).cast("int")
    at = F.when(F.col("_e").isNull(), 0).otherwise(at)
    return j.select(*by, at.alias("_s"), F.when(inside, F.col("_x")).alias("_x")).groupBy(*by, "_s", "_x").agg(F.count(F.lit(1)).alias("_c"))


def grouped_quantiles(df: DataFrame, x: str, by, probs: Mapping[str, float], slice_rows: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles of x per group; NULL for a group without values. Keys may be NULL.

    A sketch brackets each quantile of a group of over 4 * accuracy rows, and only values inside brackets are counted one by one and ordered
    (about 4 / accuracy of the group per quantile); values outside are counted in the tasks that read them. A group whose sketch missed an order
    statistic, which the counts show, is ranked over range slices of about `slice_rows` rows instead.
    """
    by, k = [by] if isinstance(by, str) else list(by), len(probs)
    ends = [q for p in probs.values() for q in (max(p - 2 / accuracy, 0.0), min(p + 2 / accuracy, 1.0))]
    n = F.count(x)
    # fixed before use: a sketch computed again may differ
    brackets = checkpoint(df.groupBy(*by).agg(n.alias("_tot"), F.when(n > 4 * accuracy, F.percentile_approx(x, ends, accuracy)).alias("_e")))
    rows = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x"))
    counted = attach(bracket_counts(rows, by, brackets.select(*by, "_e"), k), brackets.select(*by, "_tot"), by)
    run = W.partitionBy(*by).orderBy("_s", F.col("_x").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_hi", F.sum("_c").over(run)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs, values = _interpolated(by, probs)
    q = ranked.groupBy(*by).agg(*aggs).withColumnsRenamed({c: f"_q_{c}" for c in by})
    q = checkpoint(brackets.select(*by, "_tot").join(q, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], "left"))
    missed = (F.col("_tot") > 0) & F.greatest(*[F.col(f"{m}_{t}").isNull() for m in probs for t in "lh"])
    out = q.filter(~missed).select(*by, *values)
    again = q.filter(missed).select(*by)
    if again.isEmpty():
        return out
    return out.unionByName(ranked_quantiles(attach(df.select(*by, x), again, by), x, by, probs, slice_rows))


def ranked_quantiles(df: DataFrame, x: str, by: Sequence[str], probs: Mapping[str, float], slice_rows: int = 100_000) -> DataFrame:
    """The same by counting ranks over range slices of x.

    Slices of about `slice_rows` rows come from one sketch over all rows, so a group
    holding most rows is still spread over every slice; equal values are counted
    before any ordering.
    """
    rows = df.agg(F.count(x)).first()[0]
    slices = min(10_000, max(2, -(-rows // slice_rows)))
    cuts = df.agg(F.percentile_approx(x, [i / slices for i in range(1, slices)], 10 * slices)).first()[0] or []
    keyed = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).alias("_x")).withColumn("_s", range_slice("_x", cuts))
    d = keyed.groupBy(*by, "_s", "_x").agg(F.count(F.lit(1)).alias("_c"))
    per = d.groupBy(*by, "_s").agg(F.sum("_c").alias("_n"))  # from the counted values: the rows are read once for both
    before = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    off = per.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                     F.sum("_n").over(W.partitionBy(*by)).alias("_tot"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by] + [F.col("_s") == F.col("_t")]
    j = d.join(off, cond).select(*by, "_s", "_x", "_c", "_off", "_tot")
    run = W.partitionBy(*by, "_s").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    ranked = j.withColumn("_hi", F.col("_off") + F.sum("_c").over(run)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs, values = _interpolated(by, probs)
    q = ranked.groupBy(*by).agg(*aggs).withColumnsRenamed({k: f"_q_{k}" for k in by})
    every = df.select(*by).distinct()
    q = every.join(q, [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in by], "left")
    return q.select(*by, *values)


def weighted_imbalance(df: DataFrame, p: int, weight: str = "weight", by: str = "site", z: str = "z") -> DataFrame:
    """Largest absolute gap between weighted source means and the target means, per source."""
    tgt = df.filter(F.col("site") == C.TARGET).agg(F.array(*[F.avg(F.col(z)[j]) for j in range(p)]).alias("tm"))
    src = df.filter(F.col("site") != C.TARGET).groupBy(by).agg(
        F.array(*[F.sum(F.col(z)[j] * F.col(weight)) / F.sum(weight) for j in range(p)]).alias("sm"))
    gap = F.array_max(F.transform(F.zip_with("sm", "tm", lambda u, v: F.abs(u - v)), lambda v: v))
    return src.crossJoin(tgt).select(by, gap.alias("max_imbalance"))


def influence_concentration(df: DataFrame, top: int = 20, value: str = "influence", by: str = "site") -> DataFrame:
    """Share of the squared influence carried by the largest row and by the largest `top` rows.

    The top rows of a group are found in two steps: within a hash slice of the
    group, then among the slice winners, so no group is sorted in one task.
    """
    sq = df.select(by, (F.col(value) * F.col(value)).alias("_q"), F.pmod(F.xxhash64("obs_id"), F.lit(256)).alias("_s"))
    tot = sq.groupBy(by).agg(F.sum("_q").alias("total"))
    w1 = W.partitionBy(by, "_s").orderBy(F.desc("_q"))
    w2 = W.partitionBy(by).orderBy(F.desc("_q"))
    best = sq.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= top).withColumn("_r", F.row_number().over(w2))
    best = best.filter(F.col("_r") <= top).groupBy(by).agg(F.max("_q").alias("q1"), F.sum("_q").alias("qm"))
    return tot.join(best, by).select(by, (F.col("q1") / F.col("total")).alias("top1_share"), (F.col("qm") / F.col("total")).alias("topm_share"))


# -- outer-fold preprocessing ------------------------------------------------------
def fold_preprocess_stats(df: DataFrame, cols: Sequence[str], k: int, fold: str = "fold") -> DataFrame:
    """(outer_fold, feature, fill, center, scale): median, mean and population sd without that fold.

    Means and variances come from per-fold moments merged over the complement
    (one pass); medians are exact, all folds and columns in the same scans.
    """
    cols = list(cols)
    held = df.select(fold, *[F.when(F.col(fold) != o, F.col(c)).alias(f"{c}__{o}") for o in range(1, k + 1) for c in cols])
    med = exact_quantiles(held, [f"{c}__{o}" for o in range(1, k + 1) for c in cols], [0.5])
    spark = df.sparkSession
    fills = spark.createDataFrame([(o, c, med[f"{c}__{o}"][0]) for o in range(1, k + 1) for c in cols],
                                  "outer_fold int, feature string, fill double")
    cells = df.select(fold, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                                for c in cols])).alias("s")).select(fold, "s.feature", "s.v")
    m = cells.groupBy(fold, "feature").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("q"),
                                           F.count_if(F.col("v").isNull()).cast("double").alias("nulls"))
    j = fills.join(m, "feature").filter(F.col(fold) != F.col("outer_fold"))
    # rows that will be filled act as a point mass at the fill value
    s = j.groupBy("outer_fold", "feature", "fill").agg(
        ((F.sum(F.coalesce(F.col("n") * F.col("m"), F.lit(0.0))) + F.sum("nulls") * F.first("fill")) / (F.sum("n") + F.sum("nulls"))).alias("center"))
    v = j.join(s.select("outer_fold", "feature", "center"), ["outer_fold", "feature"])
    v = v.groupBy("outer_fold", "feature").agg(F.sqrt((F.sum(F.coalesce(
        F.col("n") * (F.col("q") + F.pow(F.col("m") - F.col("center"), 2)), F.lit(0.0))) + F.sum(F.col("nulls") * F.pow(
            F.col("fill") - F.col("center"), 2))) / (F.sum("n") + F.sum("nulls"))).alias("sd"))
    return s.join(v, ["outer_fold", "feature"]).select("outer_fold", "feature", "fill", "center", F.when(
        F.col("sd") > 1.4901161193847656e-08, F.col("sd")).otherwise(1.0).alias("scale"))


def fold_preprocess(df: DataFrame, cols: Sequence[str], k: int, fold: str = "fold") -> DataFrame:
    """Every row under every outer fold's training-only transformation (rows x k, narrow)."""
    stats = fold_preprocess_stats(df, cols, k, fold)
    wide = stats.groupBy("outer_fold").agg(*[
        F.max(F.when(F.col("feature") == c, F.struct("fill", "center", "scale"))).alias(f"_{c}") for c in cols])
    # k rows with 3 numbers per feature: metadata-sized
    j = df.crossJoin(F.broadcast(wide))

    def scaled(c):
        s = F.col(f"_{c}")
        return ((F.coalesce(F.col(c).cast("double"), s["fill"]) - s["center"]) / s["scale"]).alias(c)

    return j.select("outer_fold", *[scaled(c) if c in cols else F.col(c) for c in df.columns])


def apply_feature_map(df: DataFrame, phi: Callable[[DataFrame], DataFrame], check: bool = True) -> DataFrame:
    """User feature map DataFrame -> DataFrame; must keep the row count and give finite arrays w and z."""
    out = phi(df)
    if check:
        bad = F.exists("w", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        got = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
        if got["bad"] or got["n"] != df.count():
            raise ValueError("the feature map must keep every row and return finite features")
    return out
