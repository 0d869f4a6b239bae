"""Least-squares fits as distributed sums (A20-A23, A36): every group of rows is fitted in the same job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.functions.geometry import Vec, cross
from sensorframe.operators.quantiles import attach
from sensorframe.session import stage

# One scalar equation: coefficient column per parameter name, and the right-hand side.
Equation = tuple[dict[str, Column], Column]


def _solve(sums: DataFrame, keys: Sequence[str], params: Sequence[str], pairs: Sequence[tuple[int, int]], ridge: float) -> DataFrame:
    """Solve the normal equations of each group; one row in, one row out."""
    fields = [sums.schema[k] for k in keys] + [T.StructField(p, T.DoubleType()) for p in params]

    def run(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), len(params), len(params)))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"].fillna(0.0)
            a += ridge * np.eye(len(params))
            y = np.stack([pdf[f"y_{i}"].fillna(0.0) for i in range(len(params))], axis=1)
            theta = np.full((len(pdf), len(params)), np.nan)
            for r in range(len(pdf)):
                try:
                    theta[r] = np.linalg.solve(a[r], y[r])
                except np.linalg.LinAlgError:
                    pass
            out = pdf[list(keys)].copy()
            for i, p in enumerate(params):
                out[p] = theta[:, i]
            yield out

    return sums.mapInPandas(run, T.StructType(fields))


def least_squares(df: DataFrame, keys: Sequence[str], params: Sequence[str], equations: Sequence[Equation], *, ridge: float = 0.0, weights: Sequence[Column] | None = None) -> DataFrame:
    """Parameters per group from sums of products; a group's rows never meet in one place."""
    at = {p: i for i, p in enumerate(params)}
    a: dict[tuple[int, int], list[Column]] = {}
    y: dict[int, list[Column]] = {i: [] for i in range(len(params))}
    for k, (coef, rhs) in enumerate(equations):
        w = weights[k] if weights is not None else F.lit(1.0)
        names = sorted(coef, key=at.get)
        for m, p in enumerate(names):
            y[at[p]].append(w * coef[p] * rhs)
            for q in names[m:]:
                a.setdefault((at[p], at[q]), []).append(w * coef[p] * coef[q])
    cols = [F.sum(reduce(add, v)).alias(f"a_{i}_{j}") for (i, j), v in a.items()]
    cols += [F.sum(reduce(add, v)).alias(f"y_{i}") for i, v in y.items() if v]
    sums = df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols).withColumn("_all", F.lit(0))
    out = _solve(sums, list(keys) or ["_all"], params, list(a), ridge)
    return out if keys else out.drop("_all")


def residuals(equations: Sequence[Equation]) -> list[Column]:
    """Right-hand side minus model for each equation, on rows from ``with_params``."""
    return [rhs - reduce(add, [c * F.col(f"_th_{p}") for p, c in coef.items()], F.lit(0.0)) for coef, rhs in equations]


def with_params(df: DataFrame, theta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the parameters of their group, under names that cannot meet the rows' own."""
    side = theta.select(*keys, *[F.col(c).alias(f"_th_{c}") for c in theta.columns if c not in keys])
    return attach(df, side, keys)


def soft_l1(df: DataFrame, keys: Sequence[str], params: Sequence[str], equations: Sequence[Equation], *, rounds: int = 60, tol: float = 1e-10, start: DataFrame | None = None) -> DataFrame:
    """Minimum of the smooth L1 loss of a linear model by reweighted least squares, one aggregate per round.

    The loss is convex, so this is the minimum any other method finds. The rounds end when no parameter of any
    group moves by more than ``tol`` of its size. ``start`` replaces the plain least-squares start; ``df`` is then a
    table already.
    """
    if start is None:
        df = stage(df)
        start = stage(least_squares(df, keys, params, equations, ridge=1e-12))
    theta = start
    for _ in range(rounds):
        rows = with_params(df, theta, keys)
        weights = [F.lit(1.0) / F.sqrt(F.lit(1.0) + r * r) for r in residuals(equations)]
        new = stage(least_squares(rows, keys, params, equations, ridge=1e-12, weights=weights))
        old = theta.select(*keys, *[F.col(p).alias(f"_o_{p}") for p in params])
        moved = F.greatest(*[F.abs(F.col(p) - F.col(f"_o_{p}")) / (F.lit(1.0) + F.abs(p)) for p in params])
        step = attach(new, old, keys).agg(F.max(moved).alias("m")).first()["m"]
        theta = new
        if step is None or step <= tol:
            break
    return theta


F0 = ("f0x", "f0y", "f0z")
TAU0 = ("t0x", "t0y", "t0z")
COG = ("cx", "cy", "cz")
MOMENT = ("px", "py", "pz")
INERTIA = ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")


def _turn(v: Vec, names: Sequence[str]) -> list[dict[str, Column]]:
    """Coefficients of ``p x v`` (equal to ``-[v]x p``) for an unknown vector ``p``."""
    x, y, z = v
    px, py, pz = names
    return [{py: z, pz: -y}, {px: -z, pz: x}, {px: y, py: -x}]


def tool_params_static(df: DataFrame, keys: Sequence[str], force: Vec, torque: Vec, g_s: Vec, *, mass: float | None = None, cog: Sequence[float] | None = None) -> DataFrame:
    """Bias, mass and centre of gravity of the tool from still samples, by what is known of mass and centre.

    The model is ``F = f0 + m g`` and ``tau = tau0 + c x m g``. Adds the root mean square residuals.
    """
    eqs: list[Equation] = []
    params = list(F0)
    if mass is None:
        params.append("m")
    if cog is None:
        params += list(MOMENT if mass is None else COG)
    params += list(TAU0)
    for i in range(3):
        if mass is None:
            eqs.append(({F0[i]: F.lit(1.0), "m": g_s[i]}, force[i]))
        else:
            eqs.append(({F0[i]: F.lit(1.0)}, force[i] - F.lit(mass) * g_s[i]))
    for i in range(3):
        coef, rhs = {TAU0[i]: F.lit(1.0)}, torque[i]
        if cog is None:
            arm = [g if mass is None else F.lit(mass) * g for g in g_s]
            coef.update(_turn(arm, MOMENT if mass is None else COG)[i])
        else:
            lever = cross([F.lit(float(c)) for c in cog], g_s)[i]
            if mass is None:
                coef["m"] = lever
            else:
                rhs = rhs - F.lit(mass) * lever
        eqs.append((coef, rhs))
    theta = stage(least_squares(df, keys, params, eqs, ridge=1e-6))
    res = residuals(eqs)
    rms = with_params(df, theta, keys).groupBy(*keys).agg(
        F.sqrt(F.avg(reduce(add, [r * r for r in res[:3]]))).alias("rmsF"),
        F.sqrt(F.avg(reduce(add, [r * r for r in res[3:]]))).alias("rmsT"),
    )
    out = attach(theta, rms, keys)
    m = F.lit(mass) if mass is not None else F.col("m")
    if cog is not None:
        c = [F.lit(float(x)) for x in cog]
    elif mass is None:
        c = [F.when(F.abs(m) > 1e-9, F.col(p) / m).otherwise(F.lit(0.0)) for p in MOMENT]
    else:
        c = [F.col(p) for p in COG]
    return out.select(
        *keys, m.alias("m"), *[x.alias(n) for x, n in zip(c, COG)], *F0, *TAU0, "rmsF", "rmsT"
    )


def _moving_tool(x: np.ndarray, gyro: np.ndarray, lin: np.ndarray, mass: float, cog: np.ndarray, fit_cog: bool, torque_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Residuals (rows, 6) and their model's slopes (rows, 6, parameters) of G13 at ``lin``: biases, centre if it is free, INERTIA.

    ``x`` holds force, torque, gravity, acceleration, angular velocity and angular acceleration, three columns each.
    """
    force, torque, grav, acc, omega, alpha = (x[:, 3 * k:3 * k + 3] for k in range(6))
    n, eye = len(x), np.eye(3)

    def through(v: np.ndarray) -> np.ndarray:
        """Inertia times ``v`` by the six entries."""
        a, b, c = v.T
        o = np.zeros(n)
        return np.stack([np.stack(row, axis=1) for row in ((a, o, o, b, c, o), (o, b, o, a, o, c), (o, o, c, o, a, b))], axis=1)

    spin = np.stack([np.cross(omega, through(omega)[:, :, k]) for k in range(6)], axis=2)
    by_inertia = through(alpha) + gyro[:, None, None] * spin
    center = lin[6:9] if fit_cog else cog
    inner = mass * (grav + acc + np.cross(alpha, center) + np.cross(omega, np.cross(omega, center)))
    slope = np.zeros((n, 6, len(lin)))
    slope[:, :3, :3] = eye
    slope[:, 3:, 3:6] = eye
    slope[:, 3:, -6:] = by_inertia
    if fit_cog:
        for k in range(3):
            turn = mass * (np.cross(alpha, eye[k]) + np.cross(omega, np.cross(omega, eye[k])))
            slope[:, :3, 6 + k] = turn
            slope[:, 3:, 6 + k] = np.cross(eye[k], inner) + np.cross(center, turn)
    left = np.concatenate([force - inner - lin[:3], torque - np.cross(center, inner) - by_inertia @ lin[-6:] - lin[3:6]], axis=1)
    left[:, 3:] *= torque_weight
    slope[:, 3:] *= torque_weight
    return left, slope


# Logarithms of the Cholesky factor's diagonal, and what stands below it.
FACTOR = ("l11", "l22", "l33", "l21", "l31", "l32")
# No diagonal entry of the factor is below e to this: no principal moment is numerically zero.
_LEAST_LOG = -13.8
# Step control: damping at the start, and where a step that still does not help ends a fit.
_DAMPING, _MOST_DAMPING = 1e-3, 1e10


def _factor(theta: np.ndarray) -> np.ndarray:
    a, b, c, d, e, f = theta
    return np.array([[np.exp(a), 0.0, 0.0], [d, np.exp(b), 0.0], [e, f, np.exp(c)]])


def _inertia_of(theta: np.ndarray) -> np.ndarray:
    """``INERTIA`` entries of the factor's parameters."""
    low = _factor(theta)
    m = low @ low.T
    return np.array([m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]])


def _inertia_slope(theta: np.ndarray) -> np.ndarray:
    """Derivatives of the ``INERTIA`` entries (rows) by the factor's parameters."""
    low = _factor(theta)
    out = np.zeros((6, 6))
    for k, (i, j) in enumerate(((0, 0), (1, 1), (2, 2), (1, 0), (2, 0), (2, 1))):
        d = np.zeros((3, 3))
        d[i, j] = low[i, j] if i == j else 1.0
        m = d @ low.T
        m = m + m.T
        out[:, k] = m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]
    return out


def _factor_of(inertia: np.ndarray) -> np.ndarray:
    """Parameters of the nearest inertia whose principal moments are positive; a small ball where there is nothing to go by."""
    xx, yy, zz, xy, xz, yz = np.nan_to_num(inertia)
    values, vectors = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))
    top = max(float(np.abs(values).max()), 1e-3)
    low = np.linalg.cholesky((vectors * np.maximum(values, 1e-2 * top)) @ vectors.T)
    return np.array([*np.log(np.diag(low)), low[1, 0], low[2, 0], low[2, 1]])


def _damped_step(state: dict, found: dict, names: Sequence[str], tol: float) -> dict:
    """One fit's next state from the sums at its trial point.

    The trial point becomes the current one if the cost fell there, and the damping falls; else the damping rises and a shorter step
    from the current point is tried. ``status`` is set when no step is worth while any more.
    """
    out = dict(state)
    out["rounds"] += 1
    wide = len(names)
    n_lin = wide - 6
    if found["cost"] is not None and np.isfinite(found["cost"]) and (state["cost"] is None or found["cost"] <= state["cost"]):
        fell = None if state["cost"] is None else state["cost"] - found["cost"]
        out.update(found, theta=state["trial"], damping=max(state["damping"] / 10, 1e-12))
        moved = np.max(np.abs(np.subtract(state["trial"], state["theta"])) / (1 + np.abs(state["theta"])))
        out["near"] = float(fell is not None and fell <= 0.02 * found["cost"])
        if fell is not None and (moved <= tol or fell <= 1e-3 * tol * found["cost"]):
            out["status"] = "converged"
            return out
    elif state["cost"] is None:
        out.update(status="no usable rows")
        return out
    else:
        out["damping"] = state["damping"] * 10
        if out["damping"] > _MOST_DAMPING:
            # Not even the shortest step along the slope helps: a minimum within rounding.
            out["status"] = "converged"
            return out
    theta = np.array(out["theta"])
    a = np.zeros((wide, wide))
    a[np.triu_indices(wide)] = out["b" if out["near"] else "a"]
    a = a + np.triu(a, 1).T
    t = np.eye(wide)
    t[n_lin:, n_lin:] = _inertia_slope(theta[n_lin:])
    hess, slope = t.T @ a @ t, t.T @ np.array(out["g"])
    scale = np.sqrt(np.maximum(np.diag(hess), 1e-300))
    if np.max(np.abs(slope / scale)) <= tol * np.sqrt(1 + out["cost"]) * 1e-3:
        out["status"] = "converged"
        return out
    step = np.linalg.lstsq(hess + out["damping"] * np.diag(np.maximum(np.diag(hess), 1e-12)), slope, rcond=1e-15)[0]
    # The factor's diagonal may change by e a step.
    step[n_lin:n_lin + 3] = np.clip(step[n_lin:n_lin + 3], -1.0, 1.0)
    trial = theta + step
    trial[n_lin:n_lin + 3] = np.maximum(trial[n_lin:n_lin + 3], _LEAST_LOG)
    out["trial"] = trial.tolist()
    return out


def tool_params_dynamic(
    df: DataFrame, keys: Sequence[str], force: Vec, torque: Vec, g_s: Vec, acc: Vec, omega: Vec, alpha: Vec, *,
    mass: float, cog: Sequence[float], fit_cog: bool = False, gyro: bool | Column = False, torque_weight: float = 1.0,
    rounds: int = 200, tol: float = 1e-9,
) -> DataFrame:
    """Biases and inertia (and centre of gravity) of a moving tool under the smooth L1 loss; the inertia is positive definite.

    The inertia is ``L L'`` of a factor whose diagonal is given by logarithms, so no step can leave the positive definite ones. All
    groups take damped Gauss-Newton steps together: a round is one aggregate of products over the rows, at each group's own
    trial point, and a small solve per group with a damping of its own. Groups that are done leave the rows. ``gyro`` may differ by row.

    ``status`` is ``converged``, ``no usable rows`` or, after ``rounds``, ``not converged``; ``converged`` and ``rounds`` stand beside it.
    Rows with a null or non-finite value take no part and are not counted in ``n``.
    """
    if not isinstance(gyro, Column):
        gyro = F.lit(bool(gyro))
    used = {f"_u{i}": c.cast("double") for i, c in enumerate([*force, *torque, *g_s, *acc, *omega, *alpha])}
    columns = list(used)
    usable = reduce(lambda x, y: x & y, [F.abs(F.col(c)) <= 1.7976931348623157e308 for c in columns])
    rows = df.select(*keys, *[c.alias(n) for n, c in used.items()], F.coalesce(gyro, F.lit(False)).cast("double").alias("_gyro"))
    rows = stage(rows.withColumns({n: F.when(usable, F.col(n)) for n in columns}))
    start_cog = np.array([float(v) for v in cog])
    params = [*F0, *TAU0, *(COG if fit_cog else []), *INERTIA]
    wide = len(params)
    pairs = [(i, j) for i in range(wide) for j in range(i, wide)]
    key_fields = [df.schema[k] for k in keys]
    sums_schema = T.StructType(key_fields + [T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def products(weighted: bool):
        """Sums of products over a task's rows, one row for each group in it."""
        def run(batches):
            held: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                groups = pdf.groupby(list(keys), sort=False, dropna=False).indices.items() if keys else [((), np.arange(len(pdf)))] if len(pdf) else []
                values, turns = pdf[columns].to_numpy(float), pdf["_gyro"].to_numpy(float)
                for key, at in groups:
                    lin = np.asarray(pdf["lin"].iloc[at[0]], float)
                    at = at[np.isfinite(values[at]).all(axis=1)]
                    r, j = _moving_tool(values[at], turns[at], lin, mass, start_cog, fit_cog, torque_weight)
                    w = 1 / np.sqrt(1 + r * r) if weighted else np.ones_like(r)
                    # A bound of the loss's curvature, which is safe from afar, and the curvature itself, which is quick near by.
                    a, b = (np.einsum("nkp,nkq->pq", j * u[:, :, None], j, optimize=True) for u in (w, w**3))
                    g = np.einsum("nkp,nk->p", j, w * r)
                    own = [*a[np.triu_indices(wide)], *b[np.triu_indices(wide)], *g, (np.sqrt(1 + r * r) - 1).sum(), (r[:, :3] ** 2).sum(), (r[:, 3:] ** 2).sum() / torque_weight**2, len(at)]
                    key = key if isinstance(key, tuple) else (key,)
                    held[key] = held.get(key, 0.0) + np.array(own)
                if len(held) > 20_000:
                    yield out(held)
                    held = {}
            if held:
                yield out(held)

        def out(held):
            pdf = pd.DataFrame(list(held), columns=list(keys)) if keys else pd.DataFrame(index=range(len(held)))
            return pdf.assign(sums=[v.tolist() for v in held.values()])

        return run

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[:1].assign(sums=[np.sum(pdf["sums"].tolist(), axis=0).tolist()])

    def summed(at: DataFrame, weighted: bool) -> DataFrame:
        # A group has a row of sums from each task at most.
        return at.mapInPandas(products(weighted), sums_schema).groupBy(*keys).applyInPandas(added, sums_schema)

    array = T.ArrayType(T.DoubleType())
    state_schema = T.StructType(key_fields + [T.StructField(n, array) for n in ("theta", "trial", "lin", "a", "b", "g")] + [
        T.StructField(n, T.DoubleType()) for n in ("cost", "damping", "near", "sq_f", "sq_t", "n")] + [T.StructField("rounds", T.IntegerType()), T.StructField("status", T.StringType())])
    fields = ("theta", "trial", "a", "b", "g", "cost", "damping", "near", "sq_f", "sq_t", "n", "rounds", "status")

    def linear(theta: Sequence[float]) -> list[float]:
        return [*theta[:-6], *_inertia_of(np.asarray(theta[-6:]))]

    def rows_of(states: list[dict], pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[list(keys)].copy()
        for n in fields:
            out[n] = pd.Series([s[n] for s in states], index=out.index, dtype=object if n in ("theta", "trial", "a", "b", "g", "status") else None)
        out["lin"] = pd.Series([linear(s["trial"]) for s in states], index=out.index, dtype=object)
        return out[[f.name for f in state_schema]]

    def found_in(r: dict) -> dict:
        a, b, g, rest = np.split(np.asarray(r["sums"], float), np.cumsum([len(pairs), len(pairs), wide]))
        return {"a": a, "b": b, "g": g, **dict(zip(("cost", "sq_f", "sq_t", "n"), rest.tolist()))}

    def begin(batches):
        """Plain least squares with the given centre: one full step from nothing."""
        kept = [i for i in range(wide) if not (fit_cog and 6 <= i < 9)]
        for pdf in batches:
            states = []
            for r in pdf.to_dict("records"):
                sums = found_in(r)
                a = np.zeros((wide, wide))
                a[np.triu_indices(wide)] = sums["a"]
                a = a + np.triu(a, 1).T
                lin = np.linalg.lstsq(a[np.ix_(kept, kept)], np.array(sums["g"])[kept], rcond=1e-13)[0]
                theta = [*lin[:6], *(start_cog if fit_cog else []), *_factor_of(lin[6:])]
                states.append({"theta": theta, "trial": theta, "a": None, "b": None, "g": None, "cost": None, "damping": _DAMPING, "near": 0.0, "sq_f": None, "sq_t": None, "n": sums["n"], "rounds": 0, "status": None if sums["n"] else "no usable rows"})
            yield rows_of(states, pdf)

    def update(batches):
        for pdf in batches:
            states = []
            for r in pdf.to_dict("records"):
                state = {n: r[f"_{n}"] for n in fields}
                state["cost"] = None if pd.isna(state["cost"]) else state["cost"]
                states.append(_damped_step(state, found_in(r), params, tol))
            yield rows_of(states, pdf)

    nothing = [0.0] * wide
    if fit_cog:
        nothing[6:9] = start_cog.tolist()
    zero = F.array(*map(F.lit, nothing))
    first = summed(rows.withColumn("lin", zero), False)
    state = stage(first.mapInPandas(begin, state_schema), "fit")
    done = []
    for _ in range(rounds):
        done.append(state.where("status is not null"))
        state = state.where("status is null")
        if state.isEmpty():
            break
        sums = summed(attach(rows, state.select(*keys, "lin"), keys, written=True).where("lin is not null"), True)
        before = state.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[F.col(n).alias(f"_{n}") for n in fields])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], F.lit(True))
        state = stage(sums.join(before, same).mapInPandas(update, state_schema), "fit")
    done += [state.where("status is not null"), state.where("status is null").withColumn("status", F.lit("not converged"))]
    fitted = reduce(DataFrame.unionByName, done)

    double = [*F0, *TAU0, *COG, *INERTIA, "cost", "rmsF", "rmsT", "moment1", "moment2", "moment3", "inertia_det"]
    result = T.StructType(key_fields + [T.StructField(n, T.DoubleType()) for n in double] + [
        T.StructField("n", T.LongType()), T.StructField("rounds", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("converged", T.BooleanType()), T.StructField("inertia_is_spd", T.BooleanType())])

    def finish(batches):
        for pdf in batches:
            out = pdf[list(keys)].copy()
            none = pdf["n"].to_numpy() == 0
            values = np.array([linear(t) for t in pdf["theta"]]).reshape(len(pdf), wide)
            values[none] = np.nan
            for n, v in zip(COG, start_cog):
                out[n] = v
            for i, n in enumerate(params):
                out[n] = values[:, i]
            for n in ("cost", "rounds", "status"):
                out[n] = pdf[n].to_numpy()
            out["n"] = pdf["n"].to_numpy().astype(np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                out["rmsF"], out["rmsT"] = (np.sqrt(pdf[c].to_numpy(float) / pdf["n"].to_numpy(float)) for c in ("sq_f", "sq_t"))
            out["converged"] = out["status"] == "converged"
            m = np.nan_to_num(values[:, [-6, -3, -2, -3, -5, -1, -2, -1, -4]]).reshape(-1, 3, 3)
            moments = np.linalg.eigvalsh(m) if len(m) else np.zeros((0, 3))
            moments[none] = np.nan
            for k in range(3):
                out[f"moment{k + 1}"] = moments[:, k]
            out["inertia_det"] = moments.prod(axis=1)
            out["inertia_is_spd"] = (moments > 0).all(axis=1)
            yield out[[f.name for f in result]]

    return stage(fitted.mapInPandas(finish, result), "fitted")


def through_origin(df: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Slope ``sum(xy)/sum(xx)`` and rms error; null where all ``x`` are zero.

    The error comes from the same sums, so one pass is enough.
    """
    sums = df.groupBy(*keys).agg(
        F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"), F.count("*").alias("n")
    )
    slope = F.col("_xy") / F.when(F.col("_xx") != 0, F.col("_xx"))
    sse = F.col("_yy") - 2 * slope * F.col("_xy") + slope * slope * F.col("_xx")
    return sums.select(*keys, "n", slope.alias("slope"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")).alias("rmse"))


def binned_slope(df: DataFrame, keys: Sequence[str], where: Column, x: Column, y: Column, *, low: float = -200.0, high: float = 1200.0, bins: int = 20, min_rows: int = 5, cap: float = 1.5) -> DataFrame:
    """Slope through the origin per bin of ``where``; thin bins are interpolated, all are held in 0..cap."""
    from pyspark.sql import Window as W

    width = (high - low) / bins
    bin_no = F.least(F.floor((where - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where((where >= low) & (where <= high)).withColumn("_bin", bin_no)
    per = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"))
    grid = df.select(*keys).distinct().withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    all_bins = grid.join(per, [*keys, "_bin"], "left")
    all_bins = all_bins.withColumn("_s", F.when((F.col("n") >= min_rows) & (F.col("_xx") > 0), F.col("_xy") / F.col("_xx")))
    # A key has a fixed number of bins, so this window is small.
    back = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, 0)
    node = F.when(F.col("_s").isNotNull(), F.struct(F.col("_bin").alias("b"), F.col("_s").alias("v")))
    near = all_bins.withColumn("_p", F.last(node, True).over(back)).withColumn("_q", F.last(node, True).over(ahead))
    mid = F.col("_p.v") + (F.col("_bin") - F.col("_p.b")) / F.when(F.col("_q.b") != F.col("_p.b"), F.col("_q.b") - F.col("_p.b")) * (F.col("_q.v") - F.col("_p.v"))
    value = F.coalesce(F.col("_s"), mid, F.col("_p.v"), F.col("_q.v"))
    return near.select(
        *keys, F.col("_bin").alias("bin"), F.coalesce("n", F.lit(0)).alias("n"),
        F.greatest(F.least(value, F.lit(cap)), F.lit(0.0)).alias("eta"),
    )
