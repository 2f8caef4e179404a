"""The equi joins of the library and their completeness checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import linear_predictor
from ..storage import checkpoint

BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """Broadcast hint only for a table whose size is known and small; otherwise the join stays a shuffle join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def settled(df: DataFrame) -> DataFrame:
    """A derived table (moments, weights) that later plans read instead of computing it again; it never passes through the driver."""
    return checkpoint(df)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group statistics onto the rows of their group, whose key may be NULL. Adaptive execution picks the join from the real sizes
    and splits a hot group."""
    by = list(by)
    if not by:
        return df.crossJoin(stats)
    right = stats.withColumnsRenamed({k: f"_of_{k}" for k in by})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]
    return df.join(right, on).drop(*[f"_of_{k}" for k in by])


def pair_violations(results: DataFrame, method: str, benchmark: str, by: Sequence[str]) -> DataFrame:
    """Keys without exactly one row of each method."""
    r = results.filter(F.col("method").isin(method, benchmark))
    n = lambda m: F.count_if(F.col("method") == m)
    g = r.groupBy(*by).agg(n(method).alias("n_method"), n(benchmark).alias("n_benchmark"))
    return g.filter("n_method <> 1 OR n_benchmark <> 1")


def pair_methods(results: DataFrame, method: str, benchmark: str, by: Sequence[str], values: Sequence[str] = ("bias",),
                 check: bool = True) -> DataFrame:
    """One row per key with the values of both methods; fails unless the key sets match one to one."""
    if method == benchmark:
        raise ValueError("two distinct methods are required")
    if check and pair_violations(results, method, benchmark, by).limit(1).collect():
        raise ValueError("each key must hold exactly one row per method")
    x = results.filter(F.col("method") == method).select(*by, *values)
    y = results.filter(F.col("method") == benchmark).select(*by, *[F.col(v).alias(f"benchmark_{v}") for v in values])
    return x.join(y, list(by))


def pair_target(results: DataFrame, by: Sequence[str], method: str = "one_round", target: str = "target_only") -> DataFrame:
    """Adaptive rows with the target-only bias of the same task."""
    t = results.filter(F.col("method") == target).select(*by, F.col("bias").alias("target_only_bias"))
    return results.filter(F.col("method") == method).join(t, list(by))


def join_coef(obs: DataFrame, coef: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Observations with the coefficients of their (site, arm, fold) model."""
    return obs.join(sized(coef, coef.count(), 8 * (p + 8)), list(keys))


def pair_arms(scores: DataFrame, keys: Sequence[str] = ("obs_id", "site"), value: str = "phi", check: bool = True) -> DataFrame:
    """Both arms' scores and their contrast on one row per observation."""
    pick = lambda a: F.max(F.when(F.col("arm") == a, F.col(value)))
    g = scores.groupBy(*keys).agg(pick(1).alias(f"{value}1"), pick(0).alias(f"{value}0"), F.count(F.lit(1)).alias("_n"))
    if check and g.filter(f"_n <> 2 OR {value}1 IS NULL OR {value}0 IS NULL").limit(1).collect():
        raise ValueError("every observation needs exactly one score per arm")
    return g.select(*keys, f"{value}1", f"{value}0", (F.col(f"{value}1") - F.col(f"{value}0")).alias(f"{value}_tau"))


def predict_all_sources(target_obs: DataFrame, coef: DataFrame, p: int, keys: Sequence[str] = (), w: str = "w") -> DataFrame:
    """Each target row with the predictions of all source models, ordered by source label.

    The K coefficient vectors of a key travel as one row, so rows are never multiplied.
    """
    packed = coef.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("site", "beta"))).alias("_models"))
    j = target_obs.join(packed, list(keys)) if keys else target_obs.crossJoin(packed)
    psi = F.transform("_models", lambda m: linear_predictor(F.col(w), m["beta"], p))
    return j.withColumn("psi", psi).drop("_models")


def cross_candidates(mu1: DataFrame, mu0: DataFrame) -> DataFrame:
    """All treated x control candidates; both sides have one row per source."""
    a = mu1.select(F.col("candidate").alias("treated"), F.col("mean").alias("mean1"))
    b = mu0.select(F.col("candidate").alias("control"), F.col("mean").alias("mean0"))
    return a.crossJoin(b).withColumn("estimate", F.col("mean1") - F.col("mean0"))


def check_grid(results: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, unexpected or duplicated, from one grouped pass over both tables."""
    u = (results.select(*keys, F.lit(0).alias("_m"), F.lit(1).alias("_r"))
         .unionByName(manifest.select(*keys, F.lit(1).alias("_m"), F.lit(0).alias("_r"))))
    g = u.groupBy(*keys).agg(F.sum("_m").alias("in_manifest"), F.sum("_r").alias("in_results"))
    status = (F.when(F.col("in_results") == 0, "missing").when(F.col("in_manifest") == 0, "unexpected")
              .when((F.col("in_results") > 1) | (F.col("in_manifest") > 1), "duplicate"))
    return g.withColumn("status", status).filter("status IS NOT NULL")


def diff_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Per compared column: rows compared, rows that differ, largest absolute numeric difference; plus unmatched keys."""
    cols = [c for c in a.columns if c in b.columns and c not in keys and c not in exclude]
    numeric = {c for c, t in a.dtypes if t in ("double", "float", "int", "bigint", "long")}
    x = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    y = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    j = x.join(y, list(keys), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [F.count_if(both).alias("_both"), F.count_if(F.col("_b").isNull()).alias("_oa"), F.count_if(F.col("_a").isNull()).alias("_ob")]
    for c in cols:
        aggs.append(F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"d_{c}"))
        gap = F.max(F.when(both, F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).cast("double"))) if c in numeric else F.lit(None).cast("double")
        aggs.append(gap.alias(f"g_{c}"))
    s = j.agg(*aggs)
    return s.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col("_both").alias("n_compared"), F.col(f"d_{c}").alias("n_different"),
        F.col(f"g_{c}").alias("max_abs_difference"), F.col("_oa").alias("only_a"), F.col("_ob").alias("only_b")) for c in cols])).alias("s")).select("s.*")
