"""Optimal depths on an inventory grid.

One-side optimum, the symmetric problem and its full (t, q) surface are column expressions (array folds inside one row,
no shuffle); the asymmetric problem is a small dense solve, many symbols at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import let

FLOOR = 1e-300
SURFACE = "symbol string, q int, h double, delta_plus double, delta_minus double, method string"


def one_side(lam: Column, kappa: Column, eps: Column, dh: Column, clip: bool = False) -> tuple[Column, Column]:
    """Optimal depth and the value of quoting it; with ``clip`` depths are not negative."""
    lam, kappa = F.greatest(lam, F.lit(0.0)), F.greatest(kappa, F.lit(1e-12))
    depth = 1 / kappa + eps - dh
    value = lam / kappa * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -kappa * depth)))
    if not clip:
        return depth, value
    touch = depth <= 0
    return F.when(touch, 0.0).otherwise(depth), F.when(touch, F.greatest(lam * (dh - eps), F.lit(0.0))).otherwise(value)


def _system(params: DataFrame, qs: list[int], phi: float, horizon: float, span: float) -> DataFrame:
    """The linear system's coefficients: k, down, up, diag (all of it shifted by c, so that none is negative), and cuts,
    the parts of ``horizon`` over which c and the coefficients integrate to ``span`` at most."""
    k = F.greatest(F.lit(1e-8), (F.col("kappa_p") + F.col("kappa_m")) / 2)
    base = params.select(
        "symbol", "epsilon_p", "epsilon_m", k.alias("k"),
        (F.col("lambda_p") * F.exp(-1 - k * F.col("epsilon_p"))).alias("down"),
        (F.col("lambda_m") * F.exp(-1 - k * F.col("epsilon_m"))).alias("up"),
        (k * (F.col("lambda_p") * F.col("epsilon_p") - F.col("lambda_m") * F.col("epsilon_m"))).alias("drift"),
    ).where("k is not null and down is not null and up is not null and drift is not null")
    far = max(abs(q) for q in qs)
    diagonal = F.array(*[q * F.col("drift") - phi * F.col("k") * (q * q) for q in qs])
    base = base.withColumn("c", far * F.abs(F.col("drift")) + phi * F.col("k") * (far * far)).withColumn("diag", F.transform(diagonal, lambda x: x + F.col("c")))
    base = base.withColumn("cuts", F.greatest(F.lit(1), F.ceil((2 * F.col("c") + F.col("down") + F.col("up")) * horizon / span)).cast("int"))
    base = base.withColumn("step", F.lit(float(horizon)) / F.col("cuts"))
    reach = (2 * F.col("c") + F.col("down") + F.col("up")) * F.col("step")
    # Terms fall like a Poisson law's: eight deviations leave less than a double's precision.
    return base.withColumn("terms", F.ceil(reach + 8 * F.sqrt(reach) + 12).cast("int"))


def _series(v: Column) -> Column:
    """exp((A + c I) step) v, by its series, in which every term adds."""
    zero = F.lit(0.0)

    def add(acc: Column, n: Column) -> Column:
        t = acc["term"]
        term = F.transform(t, lambda x, i: (F.get("diag", i) * x + F.col("down") * F.coalesce(F.get(t, i - 1), zero) + F.col("up") * F.coalesce(F.get(t, i + 1), zero)) * F.col("step") / n)
        return let(term, lambda t: F.struct(t.alias("term"), F.zip_with(acc["sum"], t, lambda a, b: a + b).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), F.col("terms")), F.struct(v.alias("term"), v.alias("sum")), add)["sum"]


def symmetric(params: DataFrame, horizon: float = 60.0, q_max: int = 3, alpha: float = 0.0, phi: float = 0.0, span: float = 10.0) -> DataFrame:
    """symbol, q, h, delta_plus, delta_minus: the linear system for one kappa, the mean of both sides.

    exp(A T) z is summed by uniformisation: with c at least the largest diagonal magnitude, A + c I has no negative
    entry, so every term of its series adds.  Time is cut so that a cut's series stays short, and the vector is
    rescaled after each cut; h only needs ratios.
    """
    qs = list(range(-q_max, q_max + 1))
    base = _system(params, qs, phi, horizon, span)
    start = F.array(*[F.exp(-alpha * F.col("k") * (q * q)) for q in qs])

    def cut(v: Column, _: Column) -> Column:
        return let(_series(v), lambda out: let(F.array_max(out), lambda top: F.transform(out, lambda x: x / top)))

    solved = base.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.col("cuts")), start, cut))
    logs = F.transform("w", lambda x: F.ln(F.greatest(x, F.lit(FLOOR))) / F.col("k"))
    rows = solved.withColumn("top", F.array_max(logs)).select("symbol", "epsilon_p", "epsilon_m", "k", "top", F.posexplode(F.transform(logs, lambda x, i: F.struct(x.alias("x"), F.get(logs, i - 1).alias("below"), F.get(logs, i + 1).alias("above")))).alias("i", "l"))
    plus = 1 / F.col("k") + F.col("epsilon_p") - (F.coalesce("l.below", "l.x") - F.col("l.x"))
    minus = 1 / F.col("k") + F.col("epsilon_m") - (F.coalesce("l.above", "l.x") - F.col("l.x"))
    return rows.select("symbol", (F.col("i") - q_max).alias("q"), (F.col("l.x") - F.col("top")).alias("h"), plus.alias("delta_plus"), minus.alias("delta_minus"), F.lit("symmetric").alias("method"))


def _neighbours(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences to the lower and the upper neighbour along the last axis, 0 at the bounds."""
    return np.concatenate([h[..., :1], h[..., :-1]], axis=-1) - h, np.concatenate([h[..., 1:], h[..., -1:]], axis=-1) - h


def _newton_steps(jacobians: np.ndarray, f: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(jacobians, -f[..., None])[..., 0]
    except np.linalg.LinAlgError:  # a singular system takes the plain step, the others theirs
        out = -f
        for i, (j, g) in enumerate(zip(jacobians, f, strict=True)):
            try:
                out[i] = np.linalg.solve(j, -g)
            except np.linalg.LinAlgError:
                pass
        return out


def solve_asymmetric(lam: tuple, kappa: tuple, eps: tuple, horizon: float = 60.0, q_max: int = 3, alpha: float = 0.0, phi: float = 0.0, steps: int = 200, boundary: str = "clamp", clip: bool = False, damping: float = 0.7, tol: float = 1e-8, most: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, delta_plus, delta_minus on -q_max..q_max, a row for each entry of the parameters' arrays (plus, minus).

    Implicit Euler steps with damped Newton iterations and the exact Jacobian, all rows at once; a row that has settled
    waits for the others.  ``boundary``: ``clamp`` keeps the arrival term of the side that can't trade at a bound, with
    its difference of h at 0; ``indicator`` drops it.  h is shifted to maximum 0 in every iteration, which stops on the
    step's size.
    """
    q = np.arange(-q_max, q_max + 1).astype(float)
    lam, kappa, eps = (np.array(x, float).reshape(2, -1, 1) for x in (lam, kappa, eps))
    lam, kappa = np.maximum(lam, 0.0), np.maximum(kappa, 1e-8)
    dt = max(horizon / max(int(steps), 1), 1e-6)
    drift = q * (lam[0] * eps[0] - lam[1] * eps[1]) - phi * q * q
    live = np.ones((2, len(q)))
    if boundary == "indicator":
        live[0, 0] = live[1, -1] = 0.0

    def side(s: int, dh: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and its derivative in dh."""
        a, k, e = lam[s][on], kappa[s][on], eps[s][on]
        depth = 1 / k + e - dh
        value = a / k * np.exp(np.clip(-k * depth, -700, 700))
        slope = np.where(np.abs(k * depth) < 700, k * value, 0.0)
        if clip:
            touch, gain = depth <= 0, a * (dh - e)
            value, slope = np.where(touch, np.maximum(gain, 0.0), value), np.where(touch, a * (gain > 0), slope)
        return value * live[s], slope * live[s]

    n, rows = len(q), lam.shape[1]
    h, inner = np.tile(-alpha * q * q, (rows, 1)), np.arange(n)
    for _ in range(max(int(steps), 1)):
        old = h - h.max(axis=1, keepdims=True)
        new, on = old.copy(), np.arange(rows)
        for _ in range(most):
            now = new[on]
            down, up = _neighbours(now)
            (vp, sp), (vm, sm) = side(0, down, on), side(1, up, on)
            f = now - old[on] - dt * (vp + vm + drift[on])
            far = np.abs(f).max(axis=1) >= tol
            if not far.any():
                break
            on, now, f, sp, sm = on[far], now[far], f[far], sp[far], sm[far]
            jac = np.zeros((len(on), n, n))
            jac[:, inner[1:], inner[1:] - 1] += sp[:, 1:]
            jac[:, inner[1:], inner[1:]] -= sp[:, 1:]
            jac[:, inner[:-1], inner[:-1] + 1] += sm[:, :-1]
            jac[:, inner[:-1], inner[:-1]] -= sm[:, :-1]
            trial = now + damping * _newton_steps(np.eye(n) - dt * jac, f)
            trial -= trial.max(axis=1, keepdims=True)
            new[on] = trial
            on = on[np.abs(trial - now).max(axis=1) >= tol]
            if not len(on):
                break
        h = new
    down, up = _neighbours(h)
    plus, minus = 1 / kappa[0] + eps[0] - down, 1 / kappa[1] + eps[1] - up
    return h, np.maximum(plus, 0) if clip else plus, np.maximum(minus, 0) if clip else minus


def asymmetric(params: DataFrame, q_max: int = 3, boundary: str = "clamp", **options) -> DataFrame:
    """The same surface with a kappa for each side.  Symbols without kappa or epsilon have no rows; lambda defaults to 0."""
    needed = params.where("kappa_p is not null and kappa_m is not null and epsilon_p is not null and epsilon_m is not null")
    filled = needed.select("symbol", "kappa_p", "kappa_m", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lambda_p", "lambda_m")], "epsilon_p", "epsilon_m")
    q = np.arange(-q_max, q_max + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                pair = lambda c: (pdf[f"{c}_p"].to_numpy(), pdf[f"{c}_m"].to_numpy())  # noqa: B023, E731
                h, plus, minus = solve_asymmetric(pair("lambda"), pair("kappa"), pair("epsilon"), q_max=q_max, boundary=boundary, **options)
                yield pd.DataFrame({"symbol": np.repeat(pdf["symbol"].to_numpy(), len(q)), "q": np.tile(q, len(pdf)), "h": h.ravel(), "delta_plus": plus.ravel(), "delta_minus": minus.ravel(), "method": "asymmetric"})

    return filled.mapInPandas(run, SURFACE)


def surface(params: DataFrame, horizon: float = 30.0, steps: int = 200, q_min: int = -3, q_max: int = 3, alpha: float = 0.0, phi: float = 0.0, floor: float = 1e-16, span: float = 10.0) -> DataFrame:
    """symbol, n, t, q, h, delta_plus, delta_minus on the whole time grid; depths are infinite at the bounds.

    One fold goes from the horizon back, a time step at a time, by the series above.  The vector is rescaled to maximum
    1 and its scale's logarithm carried beside it, so h is absolute; entries below ``floor`` of the maximum count as it.
    """
    qs, n_q = list(range(q_min, q_max + 1)), q_max - q_min + 1
    known = params.na.drop(subset=["kappa_p", "kappa_m", "lambda_p", "lambda_m", "epsilon_p", "epsilon_m"])
    # Few rows with much to compute: a task for each, as far as there are tasks.
    base = _system(known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol"), qs, phi, horizon / steps, span)

    def scaled(v: Column, log: Column) -> Column:
        return let(v, lambda v: let(F.array_max(v), lambda top: F.struct(F.transform(v, lambda x: x / top).alias("v"), (log + F.ln(top)).alias("log"))))

    def cut(acc: Column, _: Column) -> Column:
        return scaled(_series(acc["v"]), acc["log"] - F.col("c") * F.col("step"))

    def back(acc: Column, _: Column) -> Column:
        now = F.aggregate(F.sequence(F.lit(1), F.col("cuts")), F.get(acc, F.size(acc) - 1), cut)
        return F.concat(acc, F.array(now))

    start = scaled(F.array(*[F.exp(-alpha * F.col("k") * (q * q)) for q in qs]), F.lit(0.0))
    solved = base.withColumn("w", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(start), back))
    each = solved.select("symbol", "k", "epsilon_p", "epsilon_m", F.posexplode("w").alias("left", "w")).withColumn("n", F.lit(steps) - F.col("left"))
    each = each.withColumn("h", F.transform("w.v", lambda x: (F.ln(F.greatest(x, F.lit(floor))) + F.col("w.log")) / F.col("k")))
    rows = each.select("symbol", "k", "epsilon_p", "epsilon_m", "n", F.col("h").alias("all"), F.posexplode("h").alias("i", "h"))
    infinite = F.lit(float("inf"))
    plus = F.when(F.col("i") == 0, infinite).otherwise(1 / F.col("k") + F.col("epsilon_p") - (F.get("all", F.col("i") - 1) - F.col("h")))
    minus = F.when(F.col("i") == n_q - 1, infinite).otherwise(1 / F.col("k") + F.col("epsilon_m") - (F.get("all", F.col("i") + 1) - F.col("h")))
    return rows.select("symbol", F.col("n").cast("int").alias("n"), (F.col("n") * (horizon / steps)).alias("t"), (F.col("i") + q_min).alias("q"), "h", plus.alias("delta_plus"), minus.alias("delta_minus"))
