"""One distributed pass: loss, gradient and Hessian sums of many models at once.

Rows never leave executors. Each task turns its Arrow batches into one small
array per model; a JVM vector sum with map-side combine adds them up. Rows are
not repartitioned, so a site holding most rows costs no more per task.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from ..storage import stored
from ..tasks import tidy

STATE_BYTES = 96 << 20  # bound of the per-task accumulator and of the broadcast coefficients
HEAD = 4                # n_all, n_used, sum of weights, loss


@dataclass(frozen=True)
class Model:
    """Training rows and loss of one model.

    site None means all sites; arm None means all rows; `drop` are excluded folds;
    `cv` is an excluded penalty-selection fold. `plug` maps a fold to the initial
    coefficients whose predictor gives the row factor.
    """
    key: tuple
    site: str | None
    arm: int | None
    drop: tuple[int, ...] = ()
    cv: int = 0
    family: str = "gaussian"         # gaussian | binomial | tilt
    response: str = "y"              # y | a | arm
    plug: tuple | None = None        # ((fold, coefficients), ...) ; fold 0 = every fold
    plug_kind: str | None = None     # slope | tilt | tilt_derivative
    plug_family: str = "binomial"
    radius: float = float("inf")
    plug_radius: float = float("inf")
    weight: bool = False             # multiply by the row weight column


ROWS_PER_TASK = 500_000


def prepare(obs: DataFrame, fold: str = "fold", cv: str = "cv", weight: str | None = None, files: bool = False) -> DataFrame:
    """The columns a pass reads, cached with spill to disk and read by as many tasks as the row count warrants.

    Counting fills the cache; merging cached partitions is narrow, so small data does
    not pay for hundreds of tasks in every pass and large data keeps its own partitions.
    files: in Parquet files instead, for plans that put many steps on these rows and executors that need their memory for other things.
    """
    cols = obs.columns
    f = F.col(fold).cast("int") if fold in cols else F.lit(0)
    c = F.col(cv).cast("int") if cv in cols else F.lit(0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = obs.select("obs_id", "site", F.col("a").cast("int").alias("a"), F.col("y").cast("double").alias("y"), "w", "z", f.alias("fold"),
                      c.alias("cv"), w.alias("weight"))
    data = stored(data) if files else data.persist(StorageLevel.MEMORY_AND_DISK)
    tasks = max(obs.sparkSession.sparkContext.defaultParallelism, -(-data.count() // ROWS_PER_TASK))
    return data.coalesce(tasks)


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


BUFFER_BYTES = 6 << 20  # rows of small batches are put together: a cell is then worth its numpy calls; sorting them takes several times as much


def buffered(batches):
    """Batches joined up to a size: fewer, longer runs of rows per cell."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= BUFFER_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_cell(tables, codes: dict):
    """((features, arm, response, weight), (site code, arm, fold, selection fold), row numbers) of each cell of each table."""
    for t in tables:
        col = lambda c: t.column(c).combine_chunks()
        x_all = _matrix(col("x"))
        sites = col("site").dictionary_encode()
        code = np.array([codes.get(v, -9) for v in sites.dictionary.to_pylist()] or [-9])[sites.indices.to_numpy(zero_copy_only=False)]
        a, y, fold, cvf, rw = (col(c).to_numpy(zero_copy_only=False) for c in ("a", "y", "fold", "cv", "weight"))
        parts = [np.unique(v, return_inverse=True) for v in (code, a, fold, cvf)]
        sizes = [len(v) for v, _ in parts]
        flat = np.ravel_multi_index([i.ravel() for _, i in parts], sizes)
        order = np.argsort(flat.astype(np.uint16) if np.prod(sizes) < 65_536 else flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=int(np.prod(sizes))))
        start = 0
        for at, end in enumerate(ends.tolist()):
            if end > start:
                yield (x_all, a, y, rw), tuple(v[i].item() for (v, _), i in zip(parts, np.unravel_index(at, sizes))), order[start:end]
            start = end


def _row_factor(kind, pfam, radius, eta):
    if kind == "slope":
        if pfam != "binomial":
            return np.ones_like(eta)
        h = 1.0 / (1.0 + np.exp(-np.clip(np.clip(eta, -radius, radius), -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)))
        return h * (1.0 - h)
    w = np.clip(np.exp(-np.clip(np.clip(eta, -radius, radius), -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)), *C.TILT_GUARD)
    return np.where(np.abs(eta) >= radius, 0.0, w) if kind == "tilt_derivative" else w


def _terms(family, eta, y, factor, radius):
    """Row loss, d loss / d eta and second derivative, times the row factor."""
    if family == "gaussian":
        r = eta - y
        return 0.5 * factor * r * r, factor * r, factor * np.ones_like(eta)
    if family == "binomial":
        e = np.clip(eta, -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)
        mu = 1.0 / (1.0 + np.exp(-e))
        return factor * (np.logaddexp(0.0, e) - y * e), factor * (mu - y), factor * mu * (1.0 - mu)
    t = np.clip(eta, -radius, radius)                      # tangent continuation outside the radius
    w = np.clip(np.exp(-np.clip(t, -C.LOGISTIC_CLIP, C.LOGISTIC_CLIP)), *C.TILT_GUARD)
    inside = np.abs(eta) <= radius
    return factor * w * (1.0 - (eta - t)), -factor * w, factor * w * inside


def _pass_function(bc, derivatives: bool):
    """Arrow batches of one partition -> one vector per model seen there: HEAD sums, then the gradient, then the Hessian of those with `rep`."""

    @tidy
    def run(batches):
        s = bc.value
        site, arm, drop, cv, held, kind, beta, rep = (s[k] for k in ("site", "arm", "drop", "cv", "held", "kind", "beta", "rep"))
        m, p1 = beta.shape
        iu, ju = np.triu_indices(p1)
        q = len(iu)
        acc = np.zeros((m, HEAD + (p1 if derivatives else 0)))
        place = np.cumsum(rep) - 1
        second = np.zeros((int(rep.sum()) if derivatives else 0, q))
        users = {}  # cell -> models that count its rows, and those that use them by kind of loss

        def of_cell(cs, ca, cf, cc):
            match = ((site == -1) | (site == cs)) & (~drop[:, int(cf)] if cf < drop.shape[1] else True)
            match &= np.where(held, cv == cc, (cv == 0) | (cv != cc))
            use = match & ((arm == -1) | (arm == ca))
            return np.flatnonzero(match).astype(np.int32), [(kd, np.flatnonzero(use & (kind == kd)).astype(np.int32)) for kd in np.unique(kind[use])]

        for (x_all, a, y, rw), (cs, ca, cf, cc), idx in by_cell(buffered(batches), s["codes"]):
            if (cs, ca, cf, cc) not in users:
                users[cs, ca, cf, cc] = of_cell(cs, ca, cf, cc)
            match, kinds = users[cs, ca, cf, cc]
            acc[match, 0] += len(idx)
            for kd, mm in kinds:
                fam, resp, plug_kind, pfam, radius, plug_radius, weighted = s["kinds"][kd]
                full = rep[mm]
                step = max(16, min(250_000 // max(q, 1), 250_000 // len(mm)))
                for lo in range(0, len(idx), step):
                    r = idx[lo:lo + step]
                    x = np.concatenate([np.ones((len(r), 1)), x_all[r]], axis=1)
                    eta = x @ beta[mm].T
                    yy = (a[r] if resp == "a" else y[r]).astype(float)[:, None]
                    if plug_kind:
                        factor = _row_factor(plug_kind, pfam, plug_radius, x @ s["plug"][s["plug_at"][mm, int(cf) if cf < s["plug_at"].shape[1] else 0]].T)
                    else:
                        factor = np.ones_like(eta)
                    if weighted:
                        factor = factor * rw[r][:, None]
                    loss, g, h = _terms(fam, eta, yy, factor, radius)
                    acc[mm, 1] += len(r)
                    acc[mm, 2] += factor.sum(axis=0)
                    acc[mm, 3] += loss.sum(axis=0)
                    if derivatives:
                        acc[mm, HEAD:] += g.T @ x
                        if full.any():
                            second[place[mm[full]]] += (h if full.all() else h[:, full]).T @ (x[:, iu] * x[:, ju])
        # a row per group of neighbouring models: all their sums, then all their Hessians
        bounds = s["bounds"]
        reps = np.concatenate([[0], np.cumsum(rep)])
        seen = np.flatnonzero(np.add.reduceat(acc[:, 0], bounds[:-1]) > 0) if m else np.empty(0, np.int64)
        for lo in range(0, len(seen), 512):
            part = seen[lo:lo + 512]
            rows = []
            for i in part.tolist():
                rows.append(acc[bounds[i]:bounds[i + 1]].ravel())
                if derivatives:
                    rows[-1] = np.concatenate([rows[-1], second[reps[bounds[i]]:reps[bounds[i + 1]]].ravel()])
            offsets = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)))], names=["model", "vec"])

    return run


def partial_sums(data: DataFrame, models: list[Model], beta: np.ndarray, x: str = "w", derivatives: bool = True, held: bool = False,
                 at: np.ndarray | None = None, rep: np.ndarray | None = None, bounds: np.ndarray | None = None, then=None, schema: str = "model int, vec array<double>") -> DataFrame:
    """(model, vec) of every task and row of beta: the sums stay on the executors. `then` maps these batches in the same Python worker.

    at: the model of each row of beta (default one row each). rep: rows that give a Hessian too (default all).
    bounds: rows of beta from bounds[i] up to bounds[i + 1] come as one row `i`, their sums before their Hessians (default each alone)."""
    at = np.arange(len(models)) if at is None else at
    spark = data.sparkSession
    labels = sorted({k.site for k in models if k.site is not None})
    codes = {v: i for i, v in enumerate(labels)}
    folds = 1 + max([0, *(f for k in models for f in (*k.drop, *(x for x, _ in k.plug or ())))])
    any_site = any(k.site is None for k in models)
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault((k.family, k.response, k.plug_kind, k.plug_family, k.radius, k.plug_radius, k.weight), len(kinds)) for k in models]
    drops: dict[tuple, np.ndarray] = {}
    for k in models:
        if k.drop not in drops:
            drops[k.drop] = np.isin(np.arange(folds), k.drop)
    of = lambda values, **kw: np.array(values, **kw)[at]
    state = {
        "codes": codes, "site": of([-1 if k.site is None else codes[k.site] for k in models]), "arm": of([-1 if k.arm is None else k.arm for k in models]),
        "cv": of([k.cv for k in models]), "drop": of([drops[k.drop] for k in models]), "held": of([held and k.cv > 0 for k in models]),
        "kind": of(kind), "kinds": {v: k for k, v in kinds.items()}, "beta": beta,
        "rep": np.ones(len(at), dtype=bool) if rep is None else rep, "bounds": np.arange(len(at) + 1) if bounds is None else bounds}
    if any(k.plug for k in models):
        table, plug_at, seen, rows = [np.zeros(beta.shape[1])], np.zeros((len(models), folds), dtype=np.int32), {}, {}
        for i, k in enumerate(models):
            if id(k.plug) not in rows:
                row = np.zeros(folds, dtype=np.int32)
                for f, coef in (k.plug or ()):
                    if id(coef) not in seen:
                        seen[id(coef)] = len(table)
                        table.append(np.asarray(coef, dtype=float))
                    if f == 0:
                        row[:] = seen[id(coef)]
                    else:
                        row[f] = seen[id(coef)]
                rows[id(k.plug)] = row
            plug_at[i] = rows[id(k.plug)]
        state["plug"], state["plug_at"] = np.stack(table), plug_at[at]
    bc = spark.sparkContext.broadcast(state)
    rows = data if any_site or not labels else data.filter(F.col("site").isin(labels))
    rows = rows.select("site", "a", "y", F.col(x).alias("x"), "fold", "cv", "weight")
    run = _pass_function(bc, derivatives)
    return rows.mapInArrow(run if then is None else lambda batches: then(run(batches)), schema)


def accumulate(data: DataFrame, models: list[Model], beta: np.ndarray, x: str = "w", derivatives: bool = True, held: bool = False) -> np.ndarray:
    """Sums per model at the given coefficients, on the driver; models go in chunks whose state stays small."""
    m, p1 = beta.shape
    width = HEAD + (p1 + p1 * (p1 + 1) // 2 if derivatives else 0)
    chunk = max(1, STATE_BYTES // (8 * max(width, p1)))
    out = np.zeros((m, width))
    for lo in range(0, m, chunk):
        t = (partial_sums(data, models[lo:lo + chunk], beta[lo:lo + chunk], x, derivatives, held).groupBy("model")
             .agg(Summarizer.sum(array_to_vector("vec")).alias("v")).select("model", vector_to_array("v").alias("v"))).toArrow()
        ids = t.column("model").to_numpy()
        if len(ids):
            out[lo + ids] = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)
    return out


def held_out_sums(data: DataFrame, models: list[Model], at: np.ndarray, beta: np.ndarray, x: str = "w") -> np.ndarray:
    """HEAD sums of each row of beta over the rows of its model's left-out selection fold."""
    out = np.zeros((len(at), HEAD))
    chunk = max(1, STATE_BYTES // (8 * max(HEAD, beta.shape[1])))
    for lo in range(0, len(at), chunk):
        used, which = np.unique(at[lo:lo + chunk], return_inverse=True)
        rows = partial_sums(data, [models[i] for i in used], beta[lo:lo + chunk], x, derivatives=False, held=True, at=which)
        t = rows.groupBy("model").agg(*[F.sum(F.col("vec")[j]).alias(f"s{j}") for j in range(HEAD)]).toArrow()
        out[lo + t.column("model").to_numpy()] = np.stack([t.column(f"s{j}").to_numpy() for j in range(HEAD)], axis=1)
    return out


def unpack(sums: np.ndarray, p1: int):
    """n_all, n_used, weight, loss, gradient, Hessian."""
    iu, ju = np.triu_indices(p1)
    h = np.zeros((len(sums), p1, p1))
    h[:, iu, ju] = sums[:, HEAD + p1:]
    h[:, ju, iu] = sums[:, HEAD + p1:]
    return sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3], sums[:, HEAD:HEAD + p1], h


def with_cv(m: Model, cv: int) -> Model:
    return replace(m, cv=cv)
