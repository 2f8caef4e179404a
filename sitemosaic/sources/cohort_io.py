"""Cohort readers: CSV with a declared schema, and role mapping to one long table."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..constants import TARGET


@dataclass(frozen=True)
class CohortSpec:
    site: str
    treatment: str
    outcome: str
    features: tuple[str, ...]
    target: object
    obs_id: str
    z_features: tuple[str, ...] | None = None
    group_id: str | None = None
    keep: tuple[str, ...] = field(default=())

    def __post_init__(self):
        roles = [self.site, self.treatment, self.outcome]
        if len(set(roles)) != 3 or set(roles) & set(self.features):
            raise ValueError("site, treatment, outcome and features must be distinct columns")
        if not self.features:
            raise ValueError("at least one feature is required")


def read_cohort_csv(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema; empty fields are NULL."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def site_map(df: DataFrame, site: str, target) -> DataFrame:
    """One row per raw site: the target is `t`, sources are s1..sK in label order."""
    sites = df.select(F.col(site).alias("raw_site")).distinct()
    sources = sites.filter(F.col("raw_site") != F.lit(target))
    ranked = sources.select("raw_site", F.concat(F.lit("s"), F.row_number().over(W.orderBy("raw_site"))).alias("site"))
    return sites.filter(F.col("raw_site") == F.lit(target)).select("raw_site", F.lit(TARGET).alias("site")).unionByName(ranked)


def site_cohort(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """obs(obs_id, site, a, y, w, z, group_id): one long table, site is a column."""
    z = spec.z_features or spec.features
    mapping = site_map(df, spec.site, spec.target)

    def pack(cols):
        return F.array(*[F.col(c).cast("double") for c in cols])

    group = F.col(spec.group_id).cast("long") if spec.group_id else F.lit(None).cast("long")
    packed = df.select(
        F.col(spec.obs_id).cast("long").alias("obs_id"), F.col(spec.site).alias("raw_site"),
        F.col(spec.treatment).cast("int").alias("a"), F.col(spec.outcome).cast("double").alias("y"),
        pack(spec.features).alias("w"), pack(z).alias("z"), group.alias("group_id"), *spec.keep)
    return packed.join(mapping, "raw_site").drop("raw_site")
