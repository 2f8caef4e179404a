"""Cohort preparation pipelines: raw table -> analysis cohort -> multi-site observations."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import TARGET
from ..functions import combine_indicators, flag01, merge_levels, missing_indicator
from ..operators import cohort as co

PROFILES = ("historical", "log_missing", "grouped_log_missing")


@dataclass(frozen=True)
class CohortRecipe:
    """Which raw columns play which part; the profile decides the optional steps."""
    site: str
    treatment: Column
    outcomes: Mapping[str, Column]
    continuous: tuple[str, ...]
    flags: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    log_columns: tuple[str, ...] = ()
    missing_flag: str | None = None
    combine: tuple[str, tuple[str, ...]] | None = None
    merge: tuple[str, tuple[str, ...], str] | None = None
    levels: Mapping[str, tuple[str, ...]] | None = None
    keep: tuple[str, ...] = ("obs_id",)


def build_cohort(raw: DataFrame, recipe: CohortRecipe, outcome: str, profile: str = "historical",
                 site_recode: Mapping[str, str | None] | None = None, train_pred: Column | None = None) -> DataFrame:
    """cohort(keep..., a, y, site_var, features...)."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    r, extended, grouped = recipe, profile != "historical", profile == "grouped_log_missing"
    df = co.recode_labels(raw, r.site, site_recode) if site_recode else raw
    df = df.withColumns({"a": r.treatment, "y": r.outcomes[outcome], "site_var": F.col(r.site).cast("string")})
    df = co.observed_cases(df)
    cont = [c for c in r.continuous if c != r.site]
    flags = [c for c in r.flags if c != r.site]
    cats = [c for c in r.categorical if c != r.site]
    add = {}
    if extended and r.missing_flag:
        add[f"{r.missing_flag}_missing"] = missing_indicator(r.missing_flag)
    numeric = {c for c, t in df.dtypes if t not in ("string", "boolean")}
    df = df.withColumns({**add, **{c: flag01(c) for c in flags if c not in numeric}})
    df = co.impute_median(df, cont + [c for c in flags if c in numeric], train_pred)
    names = list(cont)
    if extended:
        logs = [c for c in r.log_columns if c in cont]
        df = co.log1p_features(df, logs)
        names = [f"log1p_{c}" if c in logs else c for c in cont]
    binary = flags + list(add)
    if grouped and r.combine:
        name, parts = r.combine
        df = df.withColumn(name, combine_indicators(*parts)).drop(*parts)
        binary = [b for b in binary if b not in parts] + [name]
    if cats:
        df = co.impute_mode(df, cats, train_pred)
        if grouped and r.merge and r.merge[0] in cats:
            c, parts, label = r.merge
            df = df.withColumn(c, merge_levels(c, parts, label))
        df = df.select(*r.keep, "a", "y", "site_var", *names, *[F.col(b).cast("double").alias(b) for b in binary], *cats)
        return co.one_hot(df, cats, r.levels)
    return df.select(*r.keep, "a", "y", "site_var", *names, *[F.col(b).cast("double").alias(b) for b in binary])


def build_sites(cohort: DataFrame, k: int = 5, target: str | None = None,
                phi: Callable[[DataFrame], DataFrame] | None = None, standardize: bool = True,
                reserved=("obs_id", "a", "y", "site_var"), train_pred: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(obs, site_table). Keeps the k largest sites; the target is named or the largest."""
    if k < 2:
        raise ValueError("k must be at least 2: one target and one source")
    sites = co.collapse_sites(cohort, k)
    kept = sites.filter(F.col("r") <= k).select("site_var", "components", "r")
    retained = [x["site_var"] for x in kept.orderBy("r").collect()]
    if len(retained) < k:
        raise ValueError(f"only {len(retained)} distinct sites; cannot build {k}")
    target = retained[0] if target is None else target
    if target not in retained:
        raise ValueError(f"{target!r} is not among the retained sites {retained}")
    rank = F.row_number().over(W.orderBy("r"))
    table = kept.filter(F.col("site_var") == target).select("site_var", "components", F.lit(TARGET).alias("site")).unionByName(
        kept.filter(F.col("site_var") != target).select("site_var", "components", F.concat(F.lit("s"), rank).alias("site")))
    labels = sites.select("raw_site", "site_var").join(table, "site_var").select("raw_site", "site")
    df = phi(cohort) if phi else cohort
    features = [c for c in df.columns if c not in reserved]
    if standardize:
        df = co.standardize(df, features, ddof=0, train_pred=train_pred)
    packed = F.array(*[F.col(c).cast("double") for c in features])
    obs = df.withColumnRenamed("site_var", "raw_site").join(labels, "raw_site").select(
        "obs_id", "site", F.col("a").cast("int").alias("a"), F.col("y").cast("double").alias("y"),
        packed.alias("w"), packed.alias("z"))
    return obs, table
