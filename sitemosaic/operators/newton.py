"""Newton and L1 proximal-Newton fits of many models and penalties in lockstep, solved on the executors.

1. One pass sums each cell (site, arm, fold, selection fold) once. A model's training sums are those of its cells, so a row is multiplied out once and not
   once for every model that it trains. The models of a chunk meet their cells in one task, which finds the penalty grids, the null models and the first
   step of every penalty. Least squares is finished there, held-out losses included.
2. Every further pass sums loss and gradient of each (model, penalty) still moving. Neighbouring penalties of a model form a block and share one curvature, that of the
   block's middle penalty, so the p x p sums grow with blocks and not with penalties; with few features every penalty has its own. A block's sums meet in one task, which
   takes the L1 step by coordinate descent on the active coordinates.
3. With few features no further pass per step is needed: one pass sums power series of the loss per cell (series.py), and the task where a model's sums meet takes all
   its steps and its held-out losses from them. States that leave the reach of the series' references take another such pass, and those of 2 after that.
Only coefficients, losses and optimality residuals return to the driver; it accepts or halves the steps.
"""
from __future__ import annotations

import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from .. import constants as C
from . import series as se
from .gram import HEAD, STATE_BYTES, Model, held_out_sums, partial_sums, unpack, with_cv


class FitError(ValueError):
    pass


@dataclass
class Fitted:
    """One row per (model, penalty)."""
    model: Model
    beta: np.ndarray
    lam: float
    rule: str
    converged: bool
    iterations: int
    kkt: float
    n: float
    n_arm: float
    cv_mean: float = float("nan")
    path: list = field(default_factory=list)
    excluded: int = 0                # penalties without a usable fit in every selection fold


def lambda_grid(lambda_max: float, n: int, ratio: float) -> np.ndarray:
    """Log-spaced, descending."""
    if n < 2 or not lambda_max > 0:
        raise ValueError("a grid needs at least two points and a positive maximum")
    return np.exp(np.linspace(np.log(lambda_max), np.log(lambda_max * max(ratio, 2.220446049250313e-16)), n))


def select_lambda(grid: np.ndarray, scores: np.ndarray, rule: str = "min") -> tuple[int, np.ndarray]:
    """Index of the chosen penalty. A penalty counts only if finite in every fold."""
    ok = np.isfinite(scores).all(axis=1)
    if not ok.any():
        raise FitError("no penalty has a finite score in every fold")
    mean = np.where(ok, np.where(ok[:, None], scores, 0.0).mean(axis=1), np.inf)
    best = int(np.argmin(mean))
    if rule == "min":
        return best, mean
    se = scores[best].std(ddof=1) / np.sqrt(scores.shape[1])
    near = np.flatnonzero(mean <= mean[best] + se)
    return int(near[np.argmax(grid[near])]), mean


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def quadratic_l1(beta, g, h, pen, of=None, sweeps: int = 2000, tol: float = 1e-12):
    """argmin of g.(b - beta) + (b - beta)'H(b - beta)/2 + sum pen|b|, all problems at once.

    h: matrices; problem i has h[of[i]] (default h[i]). After a full sweep only coordinates that are not zero in some problem move, until they rest; then all are tried again."""
    of = np.arange(len(beta)) if of is None else of
    b = beta.copy()
    diag = np.maximum(np.einsum("mjj->mj", h)[of], 1e-300)
    free = np.isfinite(pen)
    bound = np.where(free, pen, 0.0)
    live, r = np.arange(len(b)), g.copy()  # r: gradient of the quadratic at b

    def sweep(coordinates):
        big = np.zeros(len(live))
        for j in coordinates:
            d, old = diag[live, j], b[live, j]
            new = np.where(free[live, j], soft(d * old - r[live, j], bound[live, j]) / d, 0.0)
            step = new - old
            r[live] += step[:, None] * h[of[live], j]
            b[live, j] = new
            big = np.maximum(big, np.abs(step) * np.sqrt(d))
        return big

    while sweeps > 0 and len(live):
        big = sweep(range(b.shape[1]))
        sweeps -= 1
        live = live[big > tol]
        active = np.flatnonzero((b[live] != 0).any(axis=0))
        while len(live) and sweeps > 0 and len(active) < b.shape[1]:
            sweeps -= 1
            if sweep(active.tolist()).max() <= tol:
                break
    return b


def kkt_residual(beta, g, pen):
    free = ~np.isfinite(pen)
    p = np.where(free, 0.0, pen)
    r = np.where(beta != 0, np.abs(g + p * np.sign(beta)), np.maximum(np.abs(g) - p, 0.0))
    return np.where(free, 0.0, r).max(axis=1)


def _null_state(models, sums, p1, norm, moment):
    """Intercept-only solution with its exact mean loss, gradient and Hessian, from sums taken at zero."""
    _, _, w, loss0, g0, h0 = unpack(sums, p1)
    m = len(models)
    beta, loss, g, h = np.zeros((m, p1)), np.zeros(m), np.zeros((m, p1)), np.zeros((m, p1, p1))
    for i, k in enumerate(models):
        if k.family == "gaussian":
            b0 = -g0[i, 0] / h0[i, 0, 0]
            beta[i, 0], h[i] = b0, h0[i]
            g[i] = g0[i] + h0[i, 0] * b0
            loss[i] = loss0[i] + g0[i, 0] * b0 + 0.5 * h0[i, 0, 0] * b0 * b0
        elif k.family == "binomial":
            mu = 0.5 - g0[i, 0] / w[i]
            mu = min(max(mu, 1e-12), 1 - 1e-12)
            beta[i, 0] = np.log(mu / (1 - mu))
            xs = 4.0 * h0[i]
            g[i] = g0[i] + (mu - 0.5) * xs[0]
            h[i] = mu * (1 - mu) * xs
            loss[i] = -w[i] * (mu * np.log(mu) + (1 - mu) * np.log(1 - mu))
        else:
            e = moment[i, 0] * norm[i] / h0[i, 0, 0]
            e = min(max(e, np.exp(-min(k.radius, 50.0))), np.exp(min(k.radius, 50.0)))
            beta[i, 0] = -np.log(e)
            g[i] = e * g0[i]
            h[i], loss[i] = e * h0[i], e * h0[i, 0, 0]
    return beta, loss, g, h


# -- on the executors ---------------------------------------------------------------
@dataclass(frozen=True)
class Shape:
    """What the steps need besides sums: the same for all models of a call."""
    p1: int
    standardize: bool
    norm: str
    nlambda: int
    ratio: float | None
    path: bool          # a penalty grid with selection folds; else one given penalty


@dataclass
class Start:
    """First state of a model: its grid's null model and the first step of each penalty."""
    n_all: float
    n_used: float
    weight: float
    ones: float
    grid: np.ndarray
    pf: np.ndarray
    beta: np.ndarray
    loss: float
    target: np.ndarray
    kkt: np.ndarray
    held: np.ndarray | None = None   # held-out losses of least squares
    error: str | None = None


def _steps(b, g, h, of, lams, pf):
    """Targets of many states, state i from the curvature h[of[i]]; their penalties; unpenalised states with an aliased design."""
    with np.errstate(invalid="ignore"):
        pen = np.where(np.isfinite(pf), lams[:, None] * np.where(np.isfinite(pf), pf, 0.0), np.inf)
    out, aliased = b.copy(), np.zeros(len(b), dtype=bool)
    plain = np.flatnonzero(lams == 0.0)
    if len(plain):
        hz = h[of[plain]]
        d = np.sqrt(np.maximum(np.einsum("mjj->mj", hz), 1e-300))
        hs = hz / d[:, :, None] / d[:, None, :]
        aliased[plain] = ~(np.linalg.eigvalsh(hs)[:, 0] >= 1e-12)
        fine = ~aliased[plain]
        out[plain[fine]] -= np.linalg.solve(hs[fine], (g[plain] / d)[fine][:, :, None])[:, :, 0] / d[fine]
    rest = np.flatnonzero(lams != 0.0)
    if len(rest):  # the free intercept is solved out: coordinate descent sees centred features and needs few sweeps
        b0, g0, at = b[rest], g[rest], of[rest]
        h00 = np.maximum(h[:, 0, 0], 1e-300)
        cross = h[:, 0, 1:]
        inner = h[:, 1:, 1:] - cross[:, :, None] * cross[:, None, :] / h00[:, None, None]
        new = quadratic_l1(b0[:, 1:], g0[:, 1:] - cross[at] * (g0[:, :1] / h00[at, None]), inner, pen[rest, 1:], at)
        out[rest, 1:] = new
        out[rest, 0] = b0[:, 0] - (g0[:, 0] + (cross[at] * (new - b0[:, 1:])).sum(axis=1)) / h00[at]
    return out, pen, aliased


def _start(k: Model, sums, held_sums, shape: Shape, moment, grid, floor) -> Start:
    n_all, n_used, w, loss0, g0, h0 = (v[0] for v in unpack(sums[None], shape.p1))
    p1 = shape.p1
    if n_used < 1:
        return Start(n_all, n_used, w, 0, np.zeros(1), np.zeros(p1), np.zeros(p1), 0, np.zeros((1, p1)), np.zeros(1), error="no training rows")
    denom = n_used if shape.norm == "used" else n_all
    mean = h0[0] / h0[0, 0]
    sd = np.sqrt(np.maximum(np.diag(h0) / h0[0, 0] - mean * mean, 0.0))
    flat = sd <= 1e-10 * np.maximum(1.0, np.abs(mean))
    pf = np.where(shape.standardize, np.where(flat, np.inf, sd), 1.0)
    pf[0] = 0.0
    beta, loss, g, h = (v[0] for v in _null_state([k], sums[None], p1, np.array([denom]), moment[None]))
    loss = loss / denom + float(moment @ beta)
    g, h = g / denom + moment, h / denom
    if grid is None:
        with np.errstate(divide="ignore", invalid="ignore"):
            lmax = np.nanmax(np.where(np.isfinite(pf[1:]), np.abs(g[1:]) / pf[1:], 0.0), initial=0.0)
        ratio = shape.ratio or (C.LAMBDA_RATIO_TALL if n_used > p1 - 1 else C.LAMBDA_RATIO_WIDE)
        grid = np.maximum(lambda_grid(max(lmax, C.LAMBDA_FLOOR), shape.nlambda, ratio), floor)
    b = np.repeat(beta[None], len(grid), axis=0)
    target, pen, aliased = _steps(b, np.repeat(g[None], len(grid), axis=0), h[None], np.zeros(len(grid), dtype=int), grid, pf)
    out = Start(n_all, n_used, w, 0.5 * w - g0[0], grid, pf, beta, loss, target, np.full(len(grid), np.inf), error="aliased or separated design" if aliased.any() else None)
    if k.family == "gaussian" and not aliased.any():
        out.kkt = kkt_residual(target, g + (target - beta) @ h, pen)
        if held_sums is not None:
            nv_all, nv, _, l0, gv, hv = (v[0] for v in unpack(held_sums[None], p1))
            scale = nv if shape.norm == "used" else nv * n_all / n_used
            out.held = (l0 + target @ gv + 0.5 * np.einsum("lj,jk,lk->l", target, hv, target)) / max(scale, 1.0) + target @ moment if nv > 0 else np.full(len(grid), np.inf)
    return out


def _groups(batches):
    """(block, {model: summed vec}) from rows sorted by block."""
    at, sums = None, {}
    for b in batches:
        vec = b.column("vec")
        flat, ends = vec.flatten().to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
        ends = ends - ends[0]
        for i, (m, g) in enumerate(zip(b.column("model").to_pylist(), b.column("block").to_pylist())):
            if g != at:
                if at is not None:
                    yield at, sums
                at, sums = g, {}
            v = flat[ends[i]:ends[i + 1]]
            if m in sums:
                sums[m] += v
            else:
                sums[m] = v.copy()
    if at is not None:
        yield at, sums


def _met(rows: DataFrame, blocks: int) -> DataFrame:
    """Partial sums of a block in one partition, one block after the other."""
    n = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("model", "block", "vec").repartition(n, "block").sortWithinPartitions("block")


CHUNK_BASES = 6


@dataclass
class Plan:
    """Cells of the models: which model adds up which, and where they meet."""
    cells: list[Model]
    fold: list[int]              # outer fold and kind of each cell
    kind: list[int]
    members: list[list[tuple[int, int]]]
    chunks: list[list[int]]
    users: dict[int, list[int]]
    of_base: list[int]           # kind of each base model


def plan_cells(data: DataFrame, bases: list[Model], cvs: list[list[int]]) -> Plan:
    folds = sorted({r["fold"] for r in data.select("fold").distinct().collect()})
    cells, of_cell, members, chunk_of, last = [], {}, [], [], {}
    fold_of, kind_of, of_base, kinds = [], [], [], {}
    chunks: list[list[int]] = []
    for i, k in enumerate(bases):
        kind = (k.site, k.arm, k.family, k.response, k.weight, k.radius, tuple(cvs[i])) if k.plug is None else ("plug", i)
        if kind not in last or len(chunks[last[kind]]) >= CHUNK_BASES:
            last[kind] = len(chunks)
            chunks.append([])
        of_base.append(kinds.setdefault(kind, len(kinds)))
        chunks[last[kind]].append(i)
        chunk_of.append(last[kind])
        mine = []
        for f in folds:
            if f in k.drop:
                continue
            for c in cvs[i] or [0]:
                name = (*kind[:-1], f, c) if k.plug is None else (i, f, c)
                if name not in of_cell:
                    of_cell[name] = len(cells)
                    plug = None if k.plug is None else tuple((g, coef) for g, coef in k.plug if g in (0, f))
                    cells.append(replace(k, drop=tuple(g for g in folds if g != f), cv=c, plug=plug))
                    fold_of.append(f)
                    kind_of.append(of_base[i])
                mine.append((of_cell[name], c))
        members.append(mine)
    users: dict[int, list[int]] = {}
    for i, mine in enumerate(members):
        for j, _ in mine:
            if chunk_of[i] not in (u := users.setdefault(j, [])):
                u.append(chunk_of[i])
    return Plan(cells, fold_of, kind_of, members, chunks, users, of_base)


def _copies(batches, users, shift=0, per=1):
    """A row for each chunk of models that adds up the row's cell; `per` rows belong to a cell."""
    for b in batches:
        ids = b.column("model").to_numpy() + shift
        times = np.array([len(users[j // per]) for j in ids.tolist()], dtype=int)
        take = np.repeat(np.arange(len(ids)), times)
        block = np.array([u for j in ids.tolist() for u in users[j // per]], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids[take].astype(np.int32)), pa.array(block), b.column("vec").take(pa.array(take))], ["model", "block", "vec"])


def starts(data: DataFrame, bases: list[Model], cvs: list[list[int]], plan: Plan, x: str, shape: Shape, moments: dict | None, grids: np.ndarray | None, floors: np.ndarray) -> list[list[Start]]:
    """First states of every base model and of its copies without one selection fold, from sums over cells."""
    cells, members, chunks, users = plan.cells, plan.members, plan.chunks, plan.users
    sc = data.sparkSession.sparkContext
    p1 = shape.p1
    width = HEAD + p1 + p1 * (p1 + 1) // 2
    zero = np.zeros(p1)
    todo = sc.broadcast((bases, cvs, members, chunks, users, [np.asarray(moments[k.key], float) if k.family == "tilt" else zero for k in bases], grids, floors))

    def solve(batches):
        bases, cvs, members, chunks, _, moment, grids, floors = todo.value
        for chunk, sums in _groups(batches):
            for i in chunks[chunk]:
                parts = {}
                for j, c in members[i]:
                    if j in sums:
                        parts[c] = parts[c] + sums[j] if c in parts else sums[j]
                none = np.zeros(width)
                grid = None if grids is None else grids[i]
                first = _start(bases[i], sum(parts.values(), none), None, shape, moment[i], grid, floors[i])
                got = [first]
                for c in cvs[i]:
                    rest = sum((v for d, v in parts.items() if d != c), none)
                    got.append(_start(bases[i], rest, parts.get(c, none), shape, moment[i], first.grid, 0.0))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps([vars(s) for s in got])])], ["base", "blob"])

    at_once = max(1, STATE_BYTES // (8 * width))
    parts = []
    for lo in range(0, len(cells), at_once):
        part = cells[lo:lo + at_once]
        parts.append(partial_sums(data, part, np.zeros((len(part), p1)), x, held=True, then=lambda b, lo=lo: _copies(b, todo.value[4], lo), schema="model int, block int, vec array<double>"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    out: list = [None] * len(bases)
    t = _met(rows, len(chunks)).mapInArrow(solve, "base int, blob binary").toArrow()
    for i, blob in zip(t.column("base").to_pylist(), t.column("blob").to_pylist()):
        out[i] = [Start(**s) for s in pickle.loads(blob)]
    todo.unpersist()
    return out


def advance(data: DataFrame, every: list[Model], x: str, shape: Shape, at, block, trial, lams, pf, denom, moment):
    """One pass at the trial coefficients: objective, residual and next target of each state (a row of trial)."""
    p1 = shape.p1
    q, width = p1 * (p1 + 1) // 2, HEAD + p1
    out_fv, out_kkt, out_target = np.full(len(at), np.inf), np.full(len(at), np.inf), trial.copy()
    failed = np.zeros(len(at), dtype=bool)
    sc = data.sparkSession.sparkContext
    first = np.flatnonzero(np.diff(block, prepend=-1))
    rep = np.zeros(len(at), dtype=bool)
    rep[(first + np.append(first[1:], len(at))) // 2] = True
    lead = np.cumsum(np.isin(np.arange(len(at)), first)) - 1   # block of each state, counted through
    bounds = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))  # states of a model
    cost = np.add.reduceat(2 * p1 + q * rep, bounds[:-1])
    lo = 0
    while lo < len(bounds) - 1:
        hi = lo + max(1, int(np.searchsorted(np.cumsum(cost[lo:]), STATE_BYTES // 8, side="right")))
        span = slice(bounds[lo], bounds[hi])
        mine = bounds[lo:hi + 1] - span.start
        lo = hi
        todo = sc.broadcast((trial[span], lams[span], pf[span], denom[span], moment[span], rep[span], lead[span], mine))

        def solve(batches, todo=todo):
            b0, lam, pfs, den, mom, rep, lead, mine = todo.value
            iu, ju = np.triu_indices(p1)

            def out(held):
                ids = np.concatenate([np.arange(mine[g], mine[g + 1]) for g, _ in held])
                vec = np.concatenate([v[:width * (mine[g + 1] - mine[g])].reshape(-1, width) for g, v in held])
                hv = np.concatenate([v[width * (mine[g + 1] - mine[g]):].reshape(-1, q) for g, v in held])
                h = np.zeros((len(hv), p1, p1))
                h[:, iu, ju] = h[:, ju, iu] = hv / den[ids[rep[ids]], None]
                _, of = np.unique(lead[ids], return_inverse=True)
                b = b0[ids]
                g = vec[:, HEAD:] / den[ids, None] + mom[ids]
                target, pen, aliased = _steps(b, g, h, of, lam[ids], pfs[ids])
                fv = vec[:, 3] / den[ids] + (mom[ids] * b).sum(axis=1) + (np.where(np.isfinite(pen), pen, 0.0) * np.abs(b)).sum(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(ids) + 1) * p1, p1, dtype=np.int32)), pa.array(target.ravel()))
                return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(fv), pa.array(kkt_residual(b, g, pen)), flat, pa.array(aliased)], ["state", "fv", "kkt", "target", "aliased"])

            held, size, most = [], 0, max(1, min(4096, 4_000_000 // (p1 * p1)))
            for g, sums in _groups(batches):
                held.append((g, sums[g]))
                size += mine[g + 1] - mine[g]
                if size >= most:
                    yield out(sorted(held, key=lambda x: x[0]))
                    held, size = [], 0
            if held:
                yield out(sorted(held, key=lambda x: x[0]))

        rows = partial_sums(data, every, trial[span], x, at=at[span], rep=rep[span], bounds=mine).withColumn("block", F.col("model"))
        t = _met(rows, len(mine) - 1).mapInArrow(solve, "state int, fv double, kkt double, target array<double>, aliased boolean").toArrow()
        ids = t.column("state").to_numpy() + span.start
        if len(ids):
            out_fv[ids], out_kkt[ids], failed[ids] = t.column("fv").to_numpy(), t.column("kkt").to_numpy(), t.column("aliased").to_numpy()
            out_target[ids] = t.column("target").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p1)
        todo.unpersist()
    return out_fv, out_kkt, out_target, failed


@dataclass
class Moves:
    """Where each state (model, penalty) stands."""
    B: np.ndarray
    FV: np.ndarray
    t: np.ndarray
    kkt: np.ndarray
    target: np.ndarray
    iters: np.ndarray
    idle: np.ndarray
    size: np.ndarray
    done: np.ndarray
    failed: np.ndarray
    stalled: np.ndarray
    aliased: np.ndarray

    def of(self, ids) -> "Moves":
        return Moves(**{k: v[ids] for k, v in vars(self).items()})

    def put(self, ids, part: dict) -> None:
        for k, v in part.items():
            getattr(self, k)[ids] = v

    def moving(self) -> np.ndarray:
        return ~self.done & ~self.failed & ~self.stalled

    def trial(self, ids) -> np.ndarray:
        return self.B[ids] + self.t[ids, None] * (self.target[ids] - self.B[ids])

    def accept(self, ids, trial, fv, res, nxt, alias, tol: float) -> None:
        """Takes or halves the steps of these states."""
        self.failed[ids[alias]] = self.aliased[ids[alias]] = True
        good = np.isfinite(fv) & (fv <= self.FV[ids] + 1e-12 * np.maximum(1.0, np.abs(self.FV[ids])))
        self.iters[ids] += 1
        ok = ids[good]
        self.idle[ok] = np.where(self.FV[ok] - fv[good] > 1e-12 * np.maximum(1.0, np.abs(self.FV[ok])), 0, self.idle[ok] + 1)
        self.B[ok], self.FV[ok], self.t[ok], self.kkt[ok], self.target[ok] = trial[good], fv[good], 1.0, res[good], nxt[good]
        self.done[ok] = self.kkt[ok] <= tol * self.size[ok]
        bad = ids[~good]
        self.t[bad] *= 0.5
        stuck = np.concatenate([bad[self.t[bad] < 1e-8], ids[~self.done[ids] & (self.idle[ids] >= 10)]])
        # no decrease is left at working precision: usable if close to the optimum, but not reported as converged
        near = self.kkt[stuck] <= 1e4 * tol
        self.stalled[stuck[near]] = True
        self.failed[stuck[~near]] = True


SERIES_PASSES = 6


def settle(data: DataFrame, plan: Plan, bases: list[Model], cvs: list[list[int]], main: np.ndarray, x: str, shape: Shape, moves: Moves, lams, pf, denom, moment, tol: float) -> np.ndarray:
    """Moves states to their optimum by series of the loss, as far as these reach; their held-out losses (NaN: not from here). Arrays pf, denom, moment: by model and copy."""
    p1, L = shape.p1, len(lams) // len(pf)
    held = np.full(len(lams), np.nan)
    if p1 not in se.ORDER or not moves.moving().any():
        return held
    scale = se.scaling(data, x, p1 - 1)
    if scale is None:
        return held
    sc = data.sparkSession.sparkContext
    of_base = np.array(plan.of_base)
    spans = [slice(main[i] * L, (main[i] + 1 + len(cvs[i])) * L) for i in range(len(bases))]
    state_base = np.repeat(np.arange(len(bases)), [s.stop - s.start for s in spans])
    gone = np.zeros(len(lams), dtype=bool)
    for _ in range(SERIES_PASSES):
        live = np.flatnonzero(moves.moving() & ~gone)
        if not len(live):
            break
        kind = of_base[state_base[live]]
        points = moves.trial(live) @ scale.T
        refs = {int(k): se.references(points[kind == k], se.reach(bases[plan.of_base.index(k)].family, p1)) for k in np.unique(kind)}
        busy = set(np.unique(state_base[live]).tolist())
        states = {i: (moves.of(spans[i]), lams[spans[i]], pf[main[i]:main[i] + 1 + len(cvs[i])], denom[main[i]:main[i] + 1 + len(cvs[i])],
                      moment[main[i]:main[i] + 1 + len(cvs[i])], gone[spans[i]]) for i in busy}
        todo = sc.broadcast((cvs, plan.members, plan.chunks, plan.users, plan.of_base, [k.family for k in bases], refs, states, scale))

        def solve(batches, todo=todo):
            cvs, members, chunks, _, of_base, families, refs, states, scale = todo.value
            for chunk, sums in _groups(batches):
                for i in chunks[chunk]:
                    if i in states:
                        part, loss = _settle_model(members[i], cvs[i], refs[of_base[i]], sums, se.reach(families[i], len(scale)), scale, L, *states[i], tol)
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pickle.dumps((part, loss))])], ["base", "blob"])

        wanted = [j for j in range(len(plan.cells)) if plan.kind[j] in refs]
        at_once = max(1, STATE_BYTES // (8 * se.REFERENCES * len(se.terms(p1).k)))
        rows = None
        for lo in range(0, len(wanted), at_once):
            more = se.series_sums(data, [(j, plan.cells[j], plan.fold[j], refs[plan.kind[j]]) for j in wanted[lo:lo + at_once]], scale, x)
            rows = more if rows is None else rows.unionByName(more)
        rows = rows.groupBy("model").agg(Summarizer.sum(array_to_vector("vec")).alias("v")).select("model", vector_to_array("v").alias("vec"))
        rows = rows.mapInArrow(lambda b, todo=todo: _copies(b, todo.value[3], per=se.REFERENCES), "model int, block int, vec array<double>")
        t = _met(rows, len(plan.chunks)).mapInArrow(solve, "base int, blob binary").toArrow()
        for i, blob in zip(t.column("base").to_pylist(), t.column("blob").to_pylist()):
            part, loss = pickle.loads(blob)
            gone[spans[i]] = part.pop("gone")
            moves.put(spans[i], part)
            held[spans[i]] = np.where(np.isnan(loss), held[spans[i]], loss)
        todo.unpersist()
    return held


def _settle_model(members, cvs, refs, sums, far, scale, L, moves: Moves, lams, pf, denom, moment, gone, tol):
    """All steps of a model and of its copies from the series of their cells."""
    p1 = len(scale)
    t = se.terms(p1)
    moves = Moves(**{k: v.copy() for k, v in vars(moves).items()})   # the broadcast stays as it is
    at = np.repeat(np.arange(len(pf)), L)
    by_cv: dict[tuple[int, int], np.ndarray] = {}
    for j, c in members:
        for r in range(len(refs)):
            v = sums.get(j * se.REFERENCES + r)
            if v is not None:
                by_cv[c, r] = by_cv[c, r] + v if (c, r) in by_cv else v
    none = np.zeros(len(t.k) + 1)
    fact = np.append(t.fact, 1.0)
    own = np.array([[fact * sum((v for (c, q), v in by_cv.items() if q == r and (m == 0 or c != cvs[m - 1])), none) for r in range(len(refs))] for m in range(len(pf))])

    def place(b):
        d = (b @ scale.T)[:, None, :] - refs[None]
        length = np.abs(d).sum(axis=2)
        near = length.argmin(axis=1)
        rows = np.arange(len(b))
        return near, d[rows, near], length[rows, near] <= far

    gone, away = gone.copy(), np.zeros(len(lams), dtype=bool)
    gone |= ~np.isfinite(own).all(axis=(1, 2))[at]
    while len(ids := np.flatnonzero(moves.moving() & ~gone & ~away)):
        trial = moves.trial(ids)
        near, d, inside = place(trial)
        away[ids[~inside]] = True
        ids, trial, near, d = ids[inside], trial[inside], near[inside], d[inside]
        if not len(ids):
            continue
        fv, g, h = np.empty(len(ids)), np.empty((len(ids), p1)), np.empty((len(ids), p1, p1))
        group = at[ids] * len(refs) + near
        for q in np.unique(group):
            on = group == q
            fv[on], g[on], h[on] = t.derivatives(own[q // len(refs), q % len(refs), :-1], d[on], scale)
        den, mom = denom[at[ids]], moment[at[ids]]
        nxt, pen, aliased = _steps(trial, g / den[:, None] + mom, h / den[:, None, None], np.arange(len(ids)), lams[ids], pf[at[ids]])
        fv = fv / den + (mom * trial).sum(axis=1) + (np.where(np.isfinite(pen), pen, 0.0) * np.abs(trial)).sum(axis=1)
        moves.accept(ids, trial, fv, kkt_residual(trial, g / den[:, None] + mom, pen), nxt, aliased, tol)
    loss = np.full(len(lams), np.nan)
    near, d, inside = place(moves.B)
    settled = (moves.done | moves.stalled) & ~moves.failed & inside & ~gone
    for m, c in enumerate(cvs, 1):
        for r in range(len(refs)):
            on = np.flatnonzero(settled & (at == m) & (near == r))
            if len(on):
                v = fact * by_cv.get((c, r), none)
                loss[on] = t.value(v[:-1], d[on]) / v[-1] if v[-1] > 0 else np.inf
    return {**{k: v for k, v in vars(moves).items() if k != "size"}, "gone": gone}, loss


def fit_models(data: DataFrame, models: list[Model], x: str = "w", lam: float | list | None = 0.0, moments: dict | None = None,
               standardize: bool = False, norm: str = "used", nlambda: int = C.LAMBDA_GRID_SIZE, rule: str = "min", cv_folds: int = C.CV_FOLDS,
               ratio: float | None = None, tol: float = C.SOLVER_TOL, lambda_floor: dict | None = None,
               on_fail: str = "raise", min_class: int = 0, degenerate: str = "constant", share: int | None = None) -> list[Fitted]:
    """Fit all models. lam: a number (one fit each), or None (penalty path with cross-validation over the site's selection folds, at most cv_folds).

    standardize: penalise beta_j times the population sd of feature j over the model's own rows.
    norm: "used" divides by the rows of the arm, "all" by all rows of the training folds.
    moments[model.key] is the target moment of a tilt model, intercept first.
    min_class: binary responses with a smaller minority class become the constant mean (or fail).
    share: neighbouring penalties with one curvature; by default one each for few features, an eighth of the coefficients for many.
    """
    if not models:
        return []
    p1 = int(data.select(x).first()[0].__len__()) + 1
    base, nb, path = list(models), len(models), lam is None
    cvs = [[] for _ in base]
    if path:
        most = {r["site"]: r["cv"] for r in data.groupBy("site").agg(F.max("cv").alias("cv")).collect()}
        cvs = [list(range(1, 1 + min(cv_folds, max(most.values()) if k.site is None else most.get(k.site, cv_folds)))) for k in base]
    shape = Shape(p1, standardize, norm, nlambda, ratio, path)
    floors = np.array([(lambda_floor or {}).get(m.key, 0.0) for m in base])
    grids = None if path else np.maximum(np.broadcast_to(np.asarray(lam, dtype=float), (nb,)), floors)[:, None]
    plan = plan_cells(data, base, cvs)
    first = starts(data, base, cvs, plan, x, shape, moments, grids, floors)
    empty = [base[i].key for i in range(nb) if first[i] is None or first[i][0].error == "no training rows"]
    if empty:
        raise FitError(f"no training rows for {empty[:3]}")
    constant_fit = np.zeros(nb, dtype=bool)
    if min_class:
        for i, k in enumerate(base):
            s = first[i][0]
            constant_fit[i] = k.family == "binomial" and min(s.ones, s.weight - s.ones) < min_class - 0.5
        if constant_fit.any() and degenerate == "error":
            raise FitError(f"too few rows in a class for {base[int(np.argmax(constant_fit))].key}")
    L = len(first[0][0].grid)
    every, full, flat_starts = [], [], []
    for i, k in enumerate(base):      # a model, then its copies without one selection fold
        for c, s in zip([0, *cvs[i]], first[i]):
            if s.error and not constant_fit[i] and on_fail == "raise" and (c == 0 or s.error != "no training rows"):
                raise FitError(f"{s.error} for {k.key}")
            every.append(k if c == 0 else with_cv(k, c))
            full.append(i)
            flat_starts.append(s)
    full = np.array(full)
    main = np.searchsorted(full, np.arange(nb))
    M = len(every)
    at, lams = np.repeat(np.arange(M), L), np.concatenate([first[i][0].grid for i in full])
    pf, moment = np.stack([s.pf for s in flat_starts]), np.stack([np.asarray(moments[k.key], float) if k.family == "tilt" else np.zeros(p1) for k in every])
    denom = np.array([s.n_used if norm == "used" else s.n_all for s in flat_starts])
    S = len(at)
    B = np.repeat(np.stack([s.beta for s in flat_starts]), L, axis=0)
    target = np.concatenate([s.target if len(s.target) == L else np.zeros((L, p1)) for s in flat_starts])
    with np.errstate(invalid="ignore"):
        FV = np.repeat([s.loss for s in flat_starts], L) + (np.where(np.isfinite(pf[at]), lams[:, None] * np.where(np.isfinite(pf[at]), pf[at], 0.0), 0.0) * np.abs(B)).sum(axis=1)
    kkt, iters = np.full(S, np.inf), np.zeros(S, dtype=int)
    gaussian = np.array([k.family == "gaussian" for k in every])[at]
    flat = constant_fit[full[at]]
    failed = np.repeat([s.error is not None for s in flat_starts], L) & ~flat
    done = gaussian | flat
    if gaussian.any():                # exact quadratic: no further pass
        ids = np.flatnonzero(gaussian & ~flat)
        B[ids], kkt[ids], iters[ids] = target[ids], np.concatenate([s.kkt if len(s.kkt) == L else np.full(L, np.inf) for s in flat_starts])[ids], 1
    kkt[flat] = 0.0
    share = share or max(1, p1 // 8)
    blocks = at * (L // share + 1) + np.tile(np.arange(L) // share, M)
    s = Moves(B, FV, np.ones(S), kkt, target, iters, np.zeros(S, dtype=int), np.maximum(1.0, np.abs(moment).max(axis=1))[at], done, failed, np.zeros(S, dtype=bool), np.zeros(S, dtype=bool))
    held_loss = settle(data, plan, base, cvs, main, x, shape, s, lams, pf, denom, moment, tol)
    if s.aliased.any() and on_fail == "raise":
        raise FitError(f"aliased or separated design for {every[at[int(np.argmax(s.aliased))]].key}")
    while len(ids := np.flatnonzero(s.moving())):  # until the conditions hold or no step lowers the loss
        trial = s.trial(ids)
        used, which = np.unique(at[ids], return_inverse=True)
        fv, res, nxt, alias = advance(data, [every[i] for i in used], x, shape, which, blocks[ids], trial, lams[ids], pf[at[ids]], denom[at[ids]], moment[at[ids]])
        s.accept(ids, trial, fv, res, nxt, alias, tol)
        if alias.any() and on_fail == "raise":
            raise FitError(f"aliased or separated design for {every[at[ids[int(np.argmax(alias))]]].key}")
    stalled = s.stalled
    usable = (done | stalled) & ~failed
    out = []
    chosen = np.zeros(nb, dtype=int)
    cv_mean = np.full((nb, L), np.nan)
    if path:
        value = np.full(S, np.inf)
        held = np.flatnonzero(~gaussian & ~flat & usable & (at != main[full[at]]))
        n_all, n_used = (np.array([getattr(s, c) for s in flat_starts])[main][full[at]] for c in ("n_all", "n_used"))
        per = np.ones(S) if norm == "used" else n_all / n_used
        value[held] = held_loss[held] / per[held] + (moment[at[held]] * B[held]).sum(axis=1)
        held = held[np.isnan(held_loss[held])]
        if len(held):
            hs = held_out_sums(data, every, at[held], B[held], x)
            nv = np.maximum(hs[:, 1], 1.0) * per[held]
            value[held] = np.where(hs[:, 1] > 0, hs[:, 3] / nv + (moment[at[held]] * B[held]).sum(axis=1), np.inf)
        for j, s in enumerate(flat_starts):
            if s.held is not None:
                value[j * L:(j + 1) * L] = s.held
        for i in range(nb):
            if constant_fit[i]:
                continue
            lo, k = main[i] * L, len(cvs[i])
            sc = np.where(usable[lo:lo + L, None], value[lo + L:lo + L + k * L].reshape(k, L).T, np.inf)
            chosen[i], cv_mean[i] = select_lambda(first[i][0].grid, sc, rule)
    for i, k in enumerate(base):
        j, s = main[i] * L + chosen[i], first[i][0]
        if not usable[j] and on_fail == "raise":
            raise FitError(f"fit did not converge for {k.key} (kkt {kkt[j]:.3g})")
        label = "degenerate_constant" if constant_fit[i] else rule if path else "fixed"
        out.append(Fitted(k, B[j], float(s.grid[chosen[i]]), label, bool(done[j] and not failed[j]), int(iters[j]), float(kkt[j]),
                          float(s.n_all), float(s.n_used), float(cv_mean[i, chosen[i]]), list(zip(s.grid, cv_mean[i])), int(np.count_nonzero(~np.isfinite(cv_mean[i]))) if path and not constant_fit[i] else 0))
    return out
