"""Result tables: heterogeneous CSV readers, settings in file names, sinks, fingerprints."""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns that are numeric even when a file holds no number in them.
NUMERIC_RESULT_COLUMNS = (
    "sim_id", "estimate", "truth", "bias", "se", "ci_lower", "ci_upper", "ci_width", "p", "K",
    "n_site", "n_folds", "rho", "cutoff", "se_bootstrap", "weight", "bootstrap_ratio",
)


def read_run_results(spark: SparkSession, paths: Iterable[str],
                     numeric: Iterable[str] = NUMERIC_RESULT_COLUMNS) -> DataFrame:
    """Union of result CSVs by column name; files sharing a header are read in one scan."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    for p in paths:
        header = spark.read.option("header", True).csv(p).columns
        groups[tuple(header)].append(p)
    if not groups:
        raise ValueError("at least one result file is required")
    frames = [spark.read.option("header", True).option("nullValue", "NA").csv(ps) for ps in groups.values()]
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    # a token that is no number fails the read instead of becoming a missing value
    return df.withColumns({c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).cast("double") for c in df.columns if c in set(numeric)})


def with_setting_from_path(df: DataFrame, path=None) -> DataFrame:
    """n_total/K/p, or K/p/seed/kf, parsed from the file name (NULL where the pattern is absent)."""
    name = F.col(path) if path else F.input_file_name()
    name = F.element_at(F.split(name, "/"), -1)

    def part(pattern, i):
        return F.nullif(F.regexp_extract(name, pattern, i), F.lit("")).cast("int")

    sized = r"_n([0-9]+)_K([0-9]+)_p([0-9]+)_"
    full = r"_K([0-9]+)_p([0-9]+)_seed([0-9]+)_kf([0-9]+)"
    tag = r"_k([0-9]+)p([0-9]+)_seed([0-9]+)"
    return df.withColumns({
        "n_total": part(sized, 1),
        "K": F.coalesce(part(full, 1), part(sized, 2), part(tag, 1)),
        "p": F.coalesce(part(full, 2), part(sized, 3), part(tag, 2)),
        "seed": part(r"_seed([0-9]+)", 1),
        "kf": part(full, 4),
    })


def write_results(result: DataFrame, path: str, include_scores: bool = False, scores: DataFrame | None = None,
                  fmt: str = "parquet") -> None:
    """Aggregates always; row-level scores only on request. Refuses to overwrite."""
    result.write.mode("errorifexists").partitionBy("method").format(fmt).save(f"{path}/results")
    if include_scores:
        if scores is None:
            raise ValueError("include_scores needs a scores table")
        scores.write.mode("errorifexists").parquet(f"{path}/scores")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row-order and column-order independent fingerprint of a table: MD5 of each row's values as text, columns by name, NULLs
    told apart from any text; two 48-bit parts of it are combined by exclusive or and by sum."""
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")))
    h = F.md5(F.concat_ws("\x1f", *[cell(c) for c in sorted(df.columns)]))
    part = lambda at: F.conv(F.substring("h", at, 12), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(part(1)).alias("xor_hash"), F.sum(part(13).cast("decimal(38,0)")).alias("sum_hash"))


def wrapped_long(c: str) -> Column:
    """A sum that is not negative as a 64-bit number: the same below 2^63, its low 64 bits in two's complement above."""
    low = F.col(c) % F.lit(str(2 ** 64)).cast("decimal(38,0)")
    return F.when(low >= F.lit(str(2 ** 63)).cast("decimal(38,0)"), low - F.lit(str(2 ** 64)).cast("decimal(38,0)")).otherwise(low).cast("long")
