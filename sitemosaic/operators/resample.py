"""Resampling by counter hashes: a row's multiplier is a function of (seed, id, draw), never of its partition."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as C
from .gram import _matrix
from .joins import attach

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def hash_bits(ids: np.ndarray, draw, seed: int) -> np.ndarray:
    """64 well-mixed bits per (id, draw)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(MIX[1]) + np.asarray(draw, dtype=np.uint64)[None, :] * np.uint64(MIX[0]) + np.uint64(seed) * np.uint64(MIX[2])
        x ^= x >> np.uint64(30)
        x *= np.uint64(MIX[1])
        x ^= x >> np.uint64(27)
        x *= np.uint64(MIX[2])
        return x ^ (x >> np.uint64(31))


def masses(ids: np.ndarray, b: int, seed: int) -> np.ndarray:
    """Exponential row masses of all draws."""
    u = (hash_bits(ids, np.arange(b), seed) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(u * 2.0 ** -53)


def _draw_sums(rows: DataFrame, group: str, cols: str, b: int, seed: int, kind: str) -> DataFrame:
    """(group, vec): sums over rows of multiplier[draw] * value[col], laid out draw-major; B x columns numbers per task and group."""

    def run(batches):
        acc: dict = {}
        n_col = 0
        for bt in batches:
            if not bt.num_rows:
                continue
            ids, g = bt.column("obs_id").to_numpy(zero_copy_only=False), bt.column(group).dictionary_encode()
            x = _matrix(bt.column(cols))
            n_col = x.shape[1]
            gi, labels = g.indices.to_numpy(zero_copy_only=False), g.dictionary.to_pylist()
            step = max(1, 4_000_000 // max(b, 1))
            for i, lab in enumerate(labels):
                idx = np.flatnonzero(gi == i)
                out = acc.setdefault(lab, np.zeros((b, n_col)))
                for lo in range(0, len(idx), step):
                    r = idx[lo:lo + step]
                    if kind == "sign":
                        # 64 signs per hash word
                        words = hash_bits(ids[r], np.arange((b + 63) // 64), seed)
                        bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(r), -1), axis=1)[:, :b]
                        mult = bits.astype(np.float64) * 2.0 - 1.0
                    else:
                        mult = masses(ids[r], b, seed)
                    out += mult.T @ x[r]
        for lab, v in acc.items():
            flat = pa.array(v.ravel())
            yield pa.RecordBatch.from_arrays([pa.array([lab]), pa.ListArray.from_arrays(pa.array([0, len(flat)], type=pa.int32()), flat)], names=[group, "vec"])

    schema = T.StructType([T.StructField(group, T.StringType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    part = rows.select("obs_id", F.col(group).cast("string").alias(group), cols).mapInArrow(run, schema)
    return part.groupBy(group).agg(Summarizer.sum(array_to_vector("vec")).alias("v")).select(group, vector_to_array("v").alias("vec"))


def multiplier_draws(influence: DataFrame, weights: DataFrame, b: int = C.BOOTSTRAP_REPLICATES, seed: int = 1, by: Sequence[str] = ("method",)) -> DataFrame:
    """(by..., draw, total): sum over sites of weight * mean(sign * centred influence). influence(by..., site, obs_id, influence)."""
    if b < 2:
        raise ValueError("at least two replicates are required")
    keys = [*by, "site"]
    m = influence.groupBy(*keys).agg(F.avg("influence").alias("_m"), F.count(F.lit(1)).alias("_n"))
    j = attach(influence, m, keys)
    g = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])
    v = F.array((F.col("influence") - F.col("_m")) / F.col("_n"))
    sums = _draw_sums(j.select("obs_id", g.alias("g"), v.alias("v")), "g", "v", b, seed, "sign")
    parts = F.split("g", "\x1f")
    types = dict(influence.dtypes)
    sums = sums.select(*[parts[i].cast(types[k]).alias(k) for i, k in enumerate(keys)], F.posexplode("vec").alias("draw", "s"))
    return sums.join(weights, keys).groupBy(*by, "draw").agg(F.sum(F.col("s") * F.col("weight")).alias("total"))


def multiplier_bootstrap(influence: DataFrame, weights: DataFrame, b: int = C.BOOTSTRAP_REPLICATES, seed: int = 1, by: Sequence[str] = ("method",)) -> DataFrame:
    return multiplier_draws(influence, weights, b, seed, by).groupBy(*by).agg(F.stddev_samp("total").alias("se_bootstrap"), F.count(F.lit(1)).alias("n_bootstrap"))


def resolve_variance(df: DataFrame, analytic: str = "variance_analytic", boot: str = "se_bootstrap") -> DataFrame:
    """Bootstrap variance when finite and positive, else the analytic one; floored."""
    s = F.col(boot)
    use = s.isNotNull() & ~F.isnan(s) & (s < float("inf")) & (s > 0)
    floor = F.lit(C.VARIANCE_FLOOR)
    a = F.greatest(F.col(analytic), floor)
    out = df.withColumns({"variance": F.when(use, F.greatest(s * s, floor)).otherwise(a), "variance_method": F.when(use, "bootstrap").otherwise("analytic"),
                          "se_analytic": F.sqrt(a)})
    return out.withColumn("se", F.sqrt("variance"))


def fixed_weight_draws(pseudo: DataFrame, b: int = C.WEIGHT_BOOTSTRAP_REPLICATES, seed: int = 1) -> DataFrame:
    """(draw, estimate): sum over sites of the exponential-mass weighted mean of the site's pseudo-values.

    pseudo(obs_id, site, value): values already carry their aggregation weights.
    """
    if b < 2:
        raise ValueError("at least two replicates are required")
    s = _draw_sums(pseudo.select("obs_id", "site", F.array(F.lit(1.0), F.col("value")).alias("v")), "site", "v", b, seed, "mass")
    pairs = s.select("site", F.posexplode(F.sequence(F.lit(0), F.lit(b - 1))).alias("draw", "_i"), "vec")
    ratio = pairs.select("site", "draw", (F.get("vec", 2 * F.col("draw") + 1) / F.get("vec", 2 * F.col("draw"))).alias("r"))
    return ratio.groupBy("draw").agg(F.sum("r").alias("estimate"))


def _products(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(1 + k) for j in range(i, 1 + k)]


def reweighted_moments(sums: DataFrame, sources: Sequence[str], b: int, arm: int = 2) -> DataFrame:
    """Inner-fold moments of every draw under exponential masses: (draw, arm, outer_fold, fold, moments...).

    sums: (outer_fold, fold, site, n, vec), draw-major sums of mass * (1, values, products): B x (products) numbers per fold and site,
    rows are never multiplied by B.
    """
    k = len(sources)
    prod = _products(k)

    def unfold(rows, width):
        e = rows.select(F.lit(arm).alias("arm"), "outer_fold", "fold", "site", "n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("draw"), "vec")
        return e.select("arm", "outer_fold", "fold", "site", "n", "draw", F.slice("vec", F.col("draw") * width + 1, width).alias("v"))

    keys = ["arm", "outer_fold", "fold"]
    t = unfold(sums.filter(F.col("site") == C.TARGET), 2 + k + len(prod))
    w = F.col("v")[0]
    mean = lambda i: F.col("v")[1 + i] / w
    cov = {pq: F.col("v")[2 + k + n] / w - mean(pq[0]) * mean(pq[1]) for n, pq in enumerate(prod)}
    c = lambda i, j: cov[(min(i, j), max(i, j))]
    t = t.select(*keys, "draw", F.col("n").alias("n_t"), w.alias("mass_t"), mean(0).alias("mu_t"), F.array(*[mean(i + 1) for i in range(k)]).alias("mu_pred"), c(0, 0).alias("v_ot"),
                 F.array(*[c(i + 1, i + 1) for i in range(k)]).alias("v_t"), F.array(*[c(0, i + 1) for i in range(k)]).alias("c_ot"),
                 F.array(*[F.array(*[F.lit(0.0) if i == j else c(i + 1, j + 1) for j in range(k)]) for i in range(k)]).alias("c_cross"))
    s = unfold(sums.filter(F.col("site") != C.TARGET), 3)
    m = F.col("v")[1] / F.col("v")[0]
    s = s.select(*keys, "draw", "site", "n", F.col("v")[0].alias("mass"), m.alias("d"), (F.col("v")[2] / F.col("v")[0] - m * m).alias("vs"))
    pick = lambda col: F.array(*[F.max(F.when(F.col("site") == x, F.col(col))) for x in sources])
    s = s.groupBy(*keys, "draw").agg(pick("n").alias("n_s"), pick("mass").alias("mass_s"), pick("d").alias("delta"), pick("vs").alias("v_s"))
    return t.join(s, [*keys, "draw"])


def summarize_draws(draws: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fixed, relearned) estimates per draw to their standard deviations and ratio."""
    g = draws.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bootstrap"), F.stddev_samp("fixed").alias("se_fixed"), F.stddev_samp("relearned").alias("se_relearn"))
    return g.withColumns({"variance_relearn": F.col("se_relearn") * F.col("se_relearn"), "uncertainty_ratio": F.col("se_relearn") / F.col("se_fixed")})


def sign_from_md5(seed: int, draw: Column, id_col: str) -> Column:
    """Deterministic +-1 multiplier expressible in SQL; for small B."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), F.col(id_col).cast("string"))), 1, 1)
    return F.when(h < "8", -1.0).otherwise(1.0)


def multiplier_draws_sql(influence: DataFrame, weights: DataFrame, b: int, seed: int = 1, by: Sequence[str] = ("method",)) -> DataFrame:
    """The same draws with md5 signs as B conditional sums of one aggregate (no row is repeated)."""
    keys = [*by, "site"]
    m = influence.groupBy(*keys).agg(F.avg("influence").alias("_m"), F.count(F.lit(1)).alias("_n"))
    x = (F.col("influence") - F.col("_m")) / F.col("_n")
    s = attach(influence, m, keys).groupBy(*keys).agg(*[F.sum(sign_from_md5(seed, F.lit(i), "obs_id") * x).alias(f"d{i}") for i in range(b)])
    long = s.select(*keys, F.posexplode(F.array(*[F.col(f"d{i}") for i in range(b)])).alias("draw", "s"))
    return long.join(weights, keys).groupBy(*by, "draw").agg(F.sum(F.col("s") * F.col("weight")).alias("total"))
