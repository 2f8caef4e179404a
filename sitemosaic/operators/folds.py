"""Fold assignment: balanced within (site, arm), a pure function of (seed, id)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as C
from .joins import attach

PREFIX_DIGITS = 3


def hash_order(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def balanced_number(df: DataFrame, strata: Sequence[str], order: str, tie: str, digits: int = PREFIX_DIGITS) -> DataFrame:
    """Adds `_rank` (0-based) by a hex hash column within strata.

    A stratum may hold a large share of all rows, so it is cut into 16^digits
    hash slices. Slice counts give each slice its offset; rows are only sorted
    inside a slice. Join and window share one hash partitioning.
    """
    keys = [*strata, "_slice"]
    sliced = df.withColumn("_slice", F.substring(order, 1, digits))
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*strata).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    within = W.partitionBy(*keys).orderBy(order, tie)
    return (sliced.join(offsets, keys)
            .withColumn("_rank", F.col("_off") + F.row_number().over(within) - 1).drop("_slice", "_off"))


def assign_folds(obs: DataFrame, k: int, seed: int = 7, strata: Sequence[str] = ("site", "a"), id_col: str = "obs_id",
                 out: str = "fold", digits: int = PREFIX_DIGITS) -> DataFrame:
    hashed = obs.withColumn("_h", hash_order(seed, id_col))
    ranked = balanced_number(hashed, strata, "_h", id_col, digits)
    return ranked.withColumn(out, (F.col("_rank") % k + 1).cast("int")).drop("_rank", "_h")


def assign_group_folds(obs: DataFrame, k: int, seed: int = 7, group: str = "group_id", out: str = "fold") -> DataFrame:
    """All rows of a unit share a fold; units are balanced within a site.

    Groups are deduplicated by an aggregate with map-side combine before
    numbering, so a unit with very many rows is one row in the shuffle.
    """
    units = obs.groupBy("site", group).agg(F.count(F.lit(1)).alias("_n"))
    folds = assign_folds(units, k, seed, strata=("site",), id_col=group, out=out).drop("_n")
    return attach(obs, folds, ["site", group])


def fold_view(obs: DataFrame, keep: Sequence[int] | None = None, drop: Sequence[int] | None = None, fold: str = "fold") -> DataFrame:
    out = obs
    if keep is not None:
        out = out.filter(F.col(fold).isin(list(keep)))
    if drop is not None:
        out = out.filter(~F.col(fold).isin(list(drop)))
    return out


def cv_fold_count(n, min_per_fold: int = 5, max_folds: int = C.CV_FOLDS, min_folds: int = C.CV_FOLDS_MIN) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    inner = F.least(F.lit(max_folds), F.floor(n / F.lit(min_per_fold)))
    return F.least(n, F.greatest(F.lit(min_folds), inner)).cast("int")


def assign_cv_folds(obs: DataFrame, folds: int = C.CV_FOLDS, seed: int = 11, id_col: str = "obs_id", out: str = "cv", digits: int = PREFIX_DIGITS, cache: bool = True) -> DataFrame:
    """Penalty-selection folds, as many per site as its smaller arm carries (at most `folds`).

    Rows are numbered within (site, arm) in order of (outer fold, hash), so the folds of an arm differ by one row at most, and by few without any outer
    fold: no selection fold of an arm is empty. Numbering goes by slices, as for the outer folds. Repeated units stay together: a unit is one row then.
    Rows with an outer fold are cached (with spill to disk): they are read several times, and each reading would number them again.
    cache=False: not here, as they come from files.
    """
    if cache and "fold" in obs.columns:
        obs = obs.persist(StorageLevel.MEMORY_AND_DISK)
    outer = F.lpad(F.coalesce(F.col("fold").cast("string"), F.lit("0")), 3, "0") if "fold" in obs.columns else F.lit("000")
    arms = obs.groupBy("site", "a").agg(F.count(F.lit(1)).alias("_n"))
    count = arms.groupBy("site").agg(F.min(cv_fold_count("_n", max_folds=folds)).alias("_k"))

    def numbered(rows: DataFrame, key: str, strata: Sequence[str]) -> DataFrame:
        ranked = balanced_number(rows.withColumn("_h", F.concat("_outer", hash_order(seed, key))), strata, "_h", key, digits + 3)
        return attach(ranked, count, ["site"]).withColumn(out, (F.col("_rank") % F.col("_k") + 1).cast("int")).drop("_rank", "_h", "_k", "_outer")

    obs = obs.withColumn("_outer", outer)
    if "group_id" not in obs.columns or obs.filter(F.col("group_id").isNotNull()).isEmpty():
        return numbered(obs, id_col, ["site", "a"])
    unit = F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("o"), F.col(id_col).cast("string")))
    obs = obs.withColumn("_unit", unit)
    units = numbered(obs.groupBy("site", "_unit").agg(F.max("a").alias("a"), F.min("_outer").alias("_outer")), "_unit", ["site", "a"])
    return attach(obs.drop("_outer"), units.select("site", "_unit", out), ["site", "_unit"]).drop("_unit")
