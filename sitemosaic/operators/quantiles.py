"""Exact quantiles of large columns without sorting or collecting a column.

`percentile` keeps every distinct value of a group in one task, so it is only
given the rows inside a bracket that two mergeable sketches prove to contain the
wanted order statistics. Brackets are narrowed until they are small.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

BRACKET_ROWS = 1_000_000


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10_000,
                    bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (h = p(n-1)) of the non-NULL values of each column."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    out: dict[str, list] = {c: [None] * len(probs) for c in cols}
    # (column, prob index) -> (lo, hi, rows below lo, rows within [lo, hi])
    brackets = {(c, i): (-math.inf, math.inf, 0, counts[c])
                for c in cols if counts[c] for i in range(len(probs))}

    def inside(c, lo, hi):
        x = F.col(c).cast("double")
        if lo == -math.inf and hi == math.inf:
            return x
        return F.when((x >= lo) & (x <= hi), x)

    while True:
        wide = {k: b for k, b in brackets.items() if b[3] > bracket_rows and b[0] < b[1]}
        if not wide:
            break
        aggs, keys = [], list(wide)
        for j, (c, i) in enumerate(keys):
            lo, hi, below, m = wide[(c, i)]
            rank = probs[i] * (counts[c] - 1) - below
            q = rank / max(m - 1, 1)
            eps = 2.0 / accuracy
            aggs.append(F.percentile_approx(inside(c, lo, hi), [max(q - eps, 0.0), min(q + eps, 1.0)],
                                            accuracy).alias(f"b{j}"))
        row = df.agg(*aggs).first()
        bounds = []
        for j, (c, i) in enumerate(keys):
            lo, hi, _, _ = wide[(c, i)]
            b = row[f"b{j}"]
            bounds.append((max(lo, b[0]), min(hi, b[1])))
        aggs = []
        for j, (c, i) in enumerate(keys):
            lo, hi = bounds[j]
            x = F.col(c).cast("double")
            aggs += [F.count_if(x < lo).alias(f"l{j}"), F.count_if((x >= lo) & (x <= hi)).alias(f"m{j}")]
        row = df.agg(*aggs).first()
        progress = False
        for j, (c, i) in enumerate(keys):
            lo, hi = bounds[j]
            below, m = row[f"l{j}"], row[f"m{j}"]
            first, last = math.floor(probs[i] * (counts[c] - 1)), math.ceil(probs[i] * (counts[c] - 1))
            if below <= first and last < below + m and m < wide[(c, i)][3]:
                brackets[(c, i)] = (lo, hi, below, m)
                progress = True
        if not progress:
            break  # heavy ties: few distinct values remain, which percentile holds compactly
    if brackets:
        aggs, keys = [], list(brackets)
        for j, (c, i) in enumerate(keys):
            lo, hi, below, m = brackets[(c, i)]
            q = (probs[i] * (counts[c] - 1) - below) / max(m - 1, 1)
            aggs.append(F.percentile(inside(c, lo, hi), min(max(q, 0.0), 1.0)).alias(f"q{j}"))
        row = df.agg(*aggs).first()
        for j, (c, i) in enumerate(keys):
            out[c][i] = row[f"q{j}"]
    return out
