"""Logistic regressions of a whole grid of penalties in shared passes.

All points are columns of one coefficient matrix.  A pass is one job: each task
adds up losses, gradients and curvatures of its rows for all points, Spark adds
up the tasks' sums, and the driver, which holds points times features squared
numbers, takes a proximal Newton step of each point: it minimises the quadratic
model with its L1 and L2 terms exactly.  A step that doesn't lower
the objective is halved.  A point leaves the passes when it has settled.

The objective is that of Spark ML: the weighted mean of the log-loss, plus
regParam times (elasticNetParam * L1 + (1 - elasticNetParam) / 2 * L2) of the
coefficients of features scaled to unit deviation; the intercept is free.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import summed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that are worth a task of a pass.
TASK = 8192


@dataclass
class Logistic:
    """A point's fit: coefficients of scaled features, the intercept first."""

    feats: list
    means: list
    deviations: list
    regParam: float
    elasticNetParam: float
    coefficients: list
    objective: float
    passes: int

    def predicted(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """df with probability and out (0 or 1); missing features count as their means."""
        z = F.lit(float(self.coefficients[0]))
        for c, m, d, b in zip(self.feats, self.means, self.deviations, self.coefficients[1:]):
            if b and d:
                z = z + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)) - F.lit(m), F.lit(0.0)) * F.lit(float(b / d))
        return df.withColumn("probability", 1 / (1 + F.exp(-z))).withColumn(out, (F.col("probability") > 0.5).cast("int"))


def confusions(models: list[Logistic], df: DataFrame, label: str) -> DataFrame:
    """tn, fp, fn, tp of each point (a model's place), by one pass over df; all models have the same features and means."""
    import numpy as np

    feats, means = models[0].feats, np.array(models[0].means)
    scale = np.array([1 / d if d else 0.0 for d in models[0].deviations])
    start = np.array([m.coefficients[0] for m in models])
    slopes = np.stack([np.array(m.coefficients[1:]) * scale for m in models], axis=1)

    def run(batches):
        import pyarrow as pa

        cells = np.zeros((len(models), 4), np.int64)
        for batch in batches:
            for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1) - means
                z = start + np.where(np.isnan(x), 0.0, x) @ slopes
                key = 2 * part.column(0).to_numpy()[:, None] + (z > 0)
                for m in range(len(models)):
                    cells[m] += np.bincount(key[:, m], minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), *(pa.array(cells[:, k]) for k in range(4))], ["point", "tn", "fp", "fn", "tp"])

    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).cast("long").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(feats)])
    return rows.mapInArrow(run, "point int, tn long, fp long, fn long, tp long").groupBy("point").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def grid(cs: list[float], penalties: list[str], weight: float) -> list[dict]:
    """The points of strengths C (of the summed loss over the given weight) and penalties, as Spark ML names them."""
    return [{"regParam": 1 / (c * weight), "elasticNetParam": {"l1": 1.0, "l2": 0.0}[p]} for c in cs for p in penalties]


def moments(df: DataFrame, feats: list[str], label: str, weight: str):
    """The weight of class 1 and of all rows, their number, and each feature's mean and deviation, in one job; a missing value counts as the mean of the others."""
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in feats]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], F.sum(F.when(F.col(label) == 1, F.col(weight))).alias("one"), F.sum(weight).alias("all")).first()
    m = [means[f"m{i}"] or 0.0 for i in range(len(feats))]
    # weighted, as Spark ML scales
    w = F.col(weight)
    filled = [F.coalesce(c, F.lit(v)) for c, v in zip(x, m)]
    rows = df.agg(F.sum(w).alias("w"), F.count("*").alias("n"), *[f(i, c) for i, c in enumerate(filled) for f in (lambda i, c: F.sum(w * (c - m[i])).alias(f"s{i}"), lambda i, c: F.sum(w * (c - m[i]) * (c - m[i])).alias(f"q{i}"))]).first()
    total, n = rows["w"] or 0.0, rows["n"]
    deviation = []
    for i in range(len(feats)):
        mean = (rows[f"s{i}"] or 0.0) / total if total else 0.0
        spread = ((rows[f"q{i}"] or 0.0) / total - mean * mean) * (n / (n - 1) if n > 1 else 1.0) if total else 0.0
        deviation.append(max(spread, 0.0) ** 0.5 if spread > 1e-24 else 0.0)
    return means["one"] or 0.0, means["all"] or 0.0, n, m, deviation


def newton_step(b, grad, hess, l1, l2, rounds: int = 2000):
    """The b' that minimises grad (b' - b) + (b' - b) hess (b' - b) / 2 + l1 |b'| + l2 b'^2 / 2, the intercept without penalty.

    Given which coefficients aren't zero, and their signs, the minimum is a linear system; a solution that changes signs
    is followed to the best point where one becomes zero, and coefficients join while their slope exceeds l1 (feature-sign search).
    """
    import numpy as np

    n = len(b)
    free = np.r_[0.0, np.ones(n - 1)]
    curve = hess + np.diag(l2 * free)
    varies = np.diag(curve) > 1e-14
    # columns that others make up get a little curvature of their own
    curve = curve + np.diag(1e-11 * np.maximum(np.diag(curve), 1e-14))
    start = grad + l2 * free * b
    slope_at = lambda x: start + curve @ (x - b)
    value_at = lambda x: start @ (x - b) + (x - b) @ curve @ (x - b) / 2 + l1 * np.abs(x[1:]).sum()
    x, bar = b.copy(), l1 * (1 + 1e-9) + 1e-13
    sign = np.sign(x) * free
    active = varies & ((x != 0) if l1 else True)
    active[0] = varies[0]
    for _ in range(rounds):
        i = np.flatnonzero(active)
        to = x.copy()
        to[i] -= np.linalg.solve(curve[np.ix_(i, i)], (slope_at(x) + l1 * sign)[i]) if len(i) else 0.0
        turned = np.flatnonzero(active & (free > 0) & (to * sign < 0)) if l1 else []
        if len(turned):
            # where each of them is zero, and the end
            shares = x[turned] / (x[turned] - to[turned])
            points = []
            for share, j in zip(shares, turned):
                y = x + share * (to - x)
                y[j] = 0.0
                points.append(y)
            best = min([*points, to], key=value_at)
            if not value_at(best) < value_at(x):
                best = points[int(np.argmin(shares))]
            x = best
            sign = np.sign(x) * free
            active &= (x != 0) | (free == 0)
            continue
        x = to
        outside = np.where(varies & ~active, np.abs(slope_at(x)), 0.0)
        j = int(outside.argmax())
        if not l1 or outside[j] <= bar:
            break
        active[j], sign[j] = True, -np.sign(slope_at(x)[j])
    return x


def lr_grid(df: DataFrame, feats: list[str], label: str, points: list[dict], weight: str = "weight", passes: int = 50, tol: float = 1e-9) -> list[Logistic]:
    """A fit of each point (regParam, elasticNetParam); the number of jobs doesn't depend on the number of points.

    A point has settled when a step lowers its objective by less than ``tol``.  Missing features count as their means; rows without a label don't count.
    """
    import numpy as np

    df = df.where(F.col(label).isNotNull())
    one, total, n_rows, means, deviations = moments(df, feats, label, weight)
    if not 0 < one < total:
        raise ValueError("both classes need rows")
    n, scale = len(feats) + 1, np.array([1 / d if d else 0.0 for d in deviations])
    columns = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)).alias(f"f{i}") for i, (c, m) in enumerate(zip(feats, means))]
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), *columns).coalesce(-(-n_rows // TASK)).persist()
    size, tasks = 1 + n + n * n, rows.rdd.getNumPartitions()

    def sums(asked: dict) -> dict:
        names = sorted(asked)
        matrix = np.stack([asked[i] for i in names], axis=1)

        def add(batches):
            out = np.zeros((len(names), size))
            for batch in batches:
                for part in (batch.slice(i, 8192) for i in range(0, batch.num_rows, 8192)):
                    x = np.stack([np.ones(part.num_rows), *(c.to_numpy() for c in part.columns[2:])], axis=1)
                    x[:, 1:] = (x[:, 1:] - means) * scale
                    y, w = part.column(0).to_numpy(), part.column(1).to_numpy()
                    z = x @ matrix
                    p = 1 / (1 + np.exp(-z))
                    loss = (w[:, None] * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                    grad, curve = x.T @ (w[:, None] * (p - y[:, None])), w[:, None] * p * (1 - p)
                    for j in range(len(names)):
                        out[j] += np.r_[loss[j], grad[:, j], (x.T @ (x * curve[:, j : j + 1])).ravel()]
            return out.ravel()

        out = summed(rows, tasks, len(names) * size, add).reshape(len(names), size) / total
        return {i: (o[0], o[1 : n + 1], o[n + 1 :].reshape(n, n)) for i, o in zip(names, out)}

    state = {}
    start = np.r_[np.log(one / (total - one)), np.zeros(n - 1)]
    for i, p in enumerate(points):
        reg, share = p["regParam"], p.get("elasticNetParam", 0.0)
        state[i] = {"l1": reg * share, "l2": reg * (1 - share), "best": None, "b": None, "try": start, "objective": np.inf, "passes": 0, "halved": 0}
    live = set(state)
    try:
        for _ in range(passes):
            for i, (loss, grad, hess) in sums({i: state[i]["try"] for i in live}).items():
                s = state[i]
                s["passes"] += 1
                b = s["try"]
                value = loss + s["l1"] * np.abs(b[1:]).sum() + s["l2"] / 2 * (b[1:] ** 2).sum()
                if value > s["objective"]:
                    # no gain: half the way back, until nothing is left to gain
                    s["halved"] += 1
                    s["try"] = (b + s["b"]) / 2
                    if s["halved"] > 20:
                        live.discard(i)
                    continue
                gain, s["objective"], s["b"], s["halved"] = s["objective"] - value, value, b, 0
                s["try"] = newton_step(b, grad, hess, s["l1"], s["l2"])
                if gain < tol:
                    live.discard(i)
            if not live:
                break
    finally:
        rows.unpersist()
    return [Logistic(list(feats), means, deviations, p["regParam"], p.get("elasticNetParam", 0.0), state[i]["b"].tolist(), float(state[i]["objective"]), state[i]["passes"]) for i, p in enumerate(points)]
