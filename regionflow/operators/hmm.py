"""Hidden Markov models of one-dimensional Gaussian sequences.

Fitting is distributed expectation-maximisation: each task runs forward and
backward passes over its sequences, those of equal length and all restarts at once, and gives a few
sums; only these reach the driver, which has the parameters.  The variational
form has posterior distributions in their place, and its evidence bound as the
objective.  Decoding runs over batches of sequences of equal length in Arrow.
"""

from __future__ import annotations

import math
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, Config
from ..functions.exprs import half_even
from .reports import split_by_sample_list
from .sums import summed

# Functions of this module travel to the executors with the job, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flatten_observations(df: DataFrame, arr: str, keys: list[str]) -> DataFrame:
    """One row an observation: keys, idx, x; sequences stay apart."""
    return df.select(*keys, F.posexplode(arr).alias("idx", "x"))


def start_params(stats: dict, k: int, restart: int, seed: int) -> dict:
    """Means at quantiles, moved a little by a seeded jitter; sticky transitions."""
    import numpy as np

    rng = np.random.default_rng([seed, restart])
    q = np.array(stats["quantiles"])[np.linspace(0, len(stats["quantiles"]) - 1, k).round().astype(int)]
    sd = max(stats["sd"], 1e-3)
    trans = np.full((k, k), 0.3 / max(k - 1, 1)) + np.eye(k) * (0.7 - (0.3 / max(k - 1, 1)))
    return {"start": np.full(k, 1 / k), "trans": trans / trans.sum(1, keepdims=True), "mean": q + rng.normal(0, 0.1 * sd * (restart > 0), k), "var": np.full(k, sd * sd)}


def stacked(models: list[dict]) -> dict:
    """Parameters of several models of one size as arrays, one row a model."""
    import numpy as np

    out = {name: np.stack([np.asarray(m[name], float) for m in models]) for name in ("start", "trans", "mean", "var")}
    return out | {"bias": np.stack([np.asarray(m.get("bias", np.zeros(len(m["mean"]))), float) for m in models])}


def by_length(sequences, cells: int):
    """Arrays of sequences of equal length, each of about ``cells`` values at most; empty ones are left out."""
    import numpy as np

    held: dict[int, list] = {}
    for x in sequences:
        if x is not None and len(x):
            held.setdefault(len(x), []).append(x)
    for n, xs in held.items():
        step = max(1, cells // n)
        for i in range(0, len(xs), step):
            yield np.asarray(xs[i : i + step], float)


def forward(x, p):
    """Scaled forward pass over sequences x (rows of equal length) for all models: alpha and emissions by step, scales, log-likelihoods."""
    import numpy as np

    # models by states by sequences, for each step: sums over states and over sequences both go along whole rows
    b = x.T[:, None, None, :] - p["mean"][:, :, None]
    b *= b
    b *= -0.5 / p["var"][:, :, None]
    b += (p["bias"] - 0.5 * np.log(2 * np.pi * p["var"]))[:, :, None]
    shift = b.max(2, keepdims=True)
    b -= shift
    np.exp(b, out=b)
    into = np.ascontiguousarray(p["trans"].transpose(0, 2, 1))
    alpha, c = np.empty_like(b), np.empty((b.shape[0], b.shape[1], b.shape[3]))
    for t in range(len(b)):
        a = (into @ alpha[t - 1] if t else p["start"][:, :, None]) * b[t]
        c[t] = np.maximum(a.sum(1), 1e-300)
        np.divide(a, c[t][:, None], out=alpha[t])
    return alpha, b, c, np.log(c).sum(0) + shift.sum((0, 2))


def expected_sums(x, p):
    """For each model: log-likelihood, first states, transitions, and the states' weights, values and squares, added up over sequences x."""
    import numpy as np

    alpha, b, c, ll = forward(x, p)
    k = b.shape[2]
    xi, weight, first, square = np.zeros_like(p["trans"]), np.zeros_like(p["mean"]), np.zeros_like(p["mean"]), np.zeros_like(p["mean"])
    beta = np.ones(b.shape[1:])
    for t in range(len(b) - 1, -1, -1):
        if t < len(b) - 1:
            ahead = b[t + 1] * beta
            ahead /= c[t + 1][:, None]
            xi += p["trans"] * (alpha[t] @ ahead.transpose(0, 2, 1))
            beta = p["trans"] @ ahead
        gamma = alpha[t] * beta
        gamma /= gamma.sum(1, keepdims=True)
        weight += gamma.sum(2)
        first += gamma @ x[:, t]
        square += gamma @ (x[:, t] * x[:, t])
    return np.concatenate([ll.sum(1)[:, None], gamma.sum(2), xi.reshape(-1, k * k), weight, first, square], axis=1)


def m_step(s: dict) -> dict:
    """The likeliest parameters for sums."""
    import numpy as np

    start, trans, n = s["start"] + 1e-6, s["xi"] + 1e-6, s["n"] + 1e-9
    mean = s["x"] / n
    return {"start": start / start.sum(), "trans": trans / trans.sum(1, keepdims=True), "mean": mean, "var": np.maximum(s["xx"] / n - mean**2, 1e-4)}


# --- the variational form: Dirichlet rows of starts and transitions, a normal-gamma for each state's mean and precision


def digamma(x):
    """By its recurrence up to 10, then by its asymptotic series."""
    import numpy as np

    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _ln_gamma(x):
    import numpy as np

    return np.vectorize(math.lgamma, otypes=[float])(x)


def prior_of(k: int, mean: float) -> dict:
    """Weak priors: one observation in all for each Dirichlet row, the data's mean with the weight of one observation, half an observation of precision."""
    import numpy as np

    return {"start": np.full(k, 1 / k), "trans": np.full((k, k), 1 / k), "beta": np.ones(k), "m": np.full(k, mean), "a": np.full(k, 0.5), "b": np.full(k, 5e-4)}


def posterior_of(s: dict, prior: dict) -> dict:
    """The posterior of sums under a prior."""
    import numpy as np

    n, beta = s["n"], prior["beta"] + s["n"]
    m = (prior["beta"] * prior["m"] + s["x"]) / beta
    spread = s["xx"] + prior["beta"] * prior["m"] ** 2 - beta * m**2
    return {"start": prior["start"] + s["start"], "trans": prior["trans"] + s["xi"], "beta": beta, "m": m, "a": prior["a"] + n / 2, "b": prior["b"] + np.maximum(spread, 0.0) / 2}


def expected_model(q: dict) -> dict:
    """What a pass takes for a posterior: exponentials of expected logs of starts and transitions, and emissions by expected logs, too."""
    import numpy as np

    rows = lambda a: np.exp(digamma(a) - digamma(a.sum(-1, keepdims=True)))
    return {"start": rows(q["start"]), "trans": rows(q["trans"]), "mean": q["m"], "var": q["b"] / q["a"], "bias": 0.5 * (digamma(q["a"]) - np.log(q["a"])) - 0.5 / q["beta"]}


def divergence(q: dict, p: dict) -> float:
    """The divergence of a posterior from the prior, over all its parts."""
    import numpy as np

    def dirichlet(a, b):
        gain = ((a - b) * (digamma(a) - digamma(a.sum(-1, keepdims=True)))).sum(-1)
        return (_ln_gamma(a.sum(-1)) - _ln_gamma(a).sum(-1) - _ln_gamma(b.sum(-1)) + _ln_gamma(b).sum(-1) + gain).sum()

    mean_precision = q["a"] / q["b"]
    normal = 0.5 * (np.log(q["beta"] / p["beta"]) + p["beta"] / q["beta"] - 1 + p["beta"] * mean_precision * (q["m"] - p["m"]) ** 2)
    gamma = (q["a"] - p["a"]) * digamma(q["a"]) - _ln_gamma(q["a"]) + _ln_gamma(p["a"]) + p["a"] * np.log(q["b"] / p["b"]) + q["a"] * (p["b"] / q["b"] - 1)
    return float(dirichlet(q["start"], p["start"]) + dirichlet(q["trans"], p["trans"]) + normal.sum() + gamma.sum())


def settled_model(q: dict) -> dict:
    """The posterior's means as parameters."""
    return {"start": q["start"] / q["start"].sum(), "trans": q["trans"] / q["trans"].sum(1, keepdims=True), "mean": q["m"], "var": q["b"] / q["a"]}


def first_posterior(model: dict, prior: dict, n: int) -> dict:
    """A posterior around a model's parameters, as if each state had its share of the n observations."""
    k = len(model["mean"])
    share = max(n / k, 1.0)
    a = prior["a"] + share / 2
    return {"start": prior["start"] + model["start"], "trans": prior["trans"] + model["trans"] * share, "beta": prior["beta"] + share, "m": model["mean"], "a": a, "b": model["var"] * a}


# --- passes

#: Values times states times models that a pass holds at once, those that are worth a task, and values of a row of ``blocks`` at most.
CELLS, TASK_CELLS, BLOCK_VALUES = 1 << 17, 1 << 21, 1 << 17


def blocks(df: DataFrame, arr: str, size_of_row: int = BLOCK_VALUES) -> DataFrame:
    """Sequences by length, many in a row: n (their length) and x (``size_of_row`` values as 64-bit floats, or one sequence); empty ones are left out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0).drop_null()
            size = np.diff(column.offsets.to_numpy())
            values = column.values.to_numpy(zero_copy_only=False).astype(float)
            first, rows = column.offsets.to_numpy()[:-1], []
            for n in np.unique(size[size > 0]).tolist():
                at, step = first[size == n], max(1, size_of_row // n)
                rows += [(n, values[at[i : i + step, None] + np.arange(n)].tobytes()) for i in range(0, len(at), step)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["n", "x"])

    return df.select(F.col(arr).cast("array<double>")).mapInArrow(run, "n long, x binary")


def pass_over(rows: DataFrame, tasks: int, models: dict) -> dict:
    """Expected sums of each model, {(k, restart): parameters}, over all sequences of ``blocks``, added up in one job."""
    import numpy as np

    names = sorted(models)
    sizes = sorted({k for k, _ in names})
    width = {k: 1 + k + k * k + 3 * k for k in sizes}
    of = {k: [n for n in names if n[0] == k] for k in sizes}

    def add(batches):
        params = {k: stacked([models[n] for n in of[k]]) for k in sizes}
        total = {k: np.zeros((len(of[k]), width[k])) for k in sizes}
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x).reshape(-1, n)
                for k, p in params.items():
                    step = max(1, CELLS // (n * k * len(of[k])))
                    for i in range(0, len(x), step):
                        total[k] += expected_sums(x[i : i + step], p)
        return np.concatenate([total[k].ravel() for k in sizes])

    flat, out, at = summed(rows, tasks, sum(width[k] * len(of[k]) for k in sizes), add), {}, 0
    for k, r in names:
        ll, start, xi, n, x, xx = np.split(flat[at : at + width[k]], np.cumsum([1, k, k * k, k, k]))
        out[k, r] = {"ll": float(ll[0]), "start": start, "xi": xi.reshape(k, k), "n": n, "x": x, "xx": xx}
        at += width[k]
    return out


def hmm_fits(df: DataFrame, arr: str, ks: list[int], n_iter: int = 20, restarts: int = 3, seed: int = 0, variational: bool = False, tol: float = 1e-2) -> list[dict]:
    """A fit of each number of states; all sizes and restarts share each pass over the sequences.

    A restart ends, and leaves the passes, when a pass gains less than ``tol``: of the log-likelihood or, in the
    variational form, of the evidence bound.  A fit is a dict of parameters (states in order of mean; the
    posterior's means in the variational form), loglik, n, bound (null without priors) and the path of the best
    restart's objective.  The best restart is the one of the highest objective.
    """
    import numpy as np

    values = df.select(F.explode(arr).alias("x"))
    quantiles = [i / 20 for i in range(1, 20)]
    row = values.agg(F.percentile_approx("x", quantiles, 1000).alias("q"), F.stddev_pop("x").alias("sd"), F.avg("x").alias("mean"), F.count("*").alias("n")).first()
    if not row["n"]:
        raise ValueError("no observations")
    stats = {"quantiles": row["q"], "sd": row["sd"] or 0.0}
    models = {(k, r): start_params(stats, k, r, seed) for k in ks for r in range(restarts)}
    priors = {k: prior_of(k, row["mean"]) for k in ks}
    posteriors = {n: first_posterior(m, priors[n[0]], row["n"]) for n, m in models.items()} if variational else {}
    path: dict = {n: [] for n in models}
    live = sorted(models)
    # what a task is worth is counted in values of all states: a pass over few isn't worth many tasks, nor may tasks be few where states are many
    values = min(BLOCK_VALUES, max(1, TASK_CELLS // (sum(ks) * restarts)))
    rows = blocks(df, arr, values).repartition(-(-row["n"] // values)).persist()
    tasks = rows.rdd.getNumPartitions()
    try:
        for left in range(n_iter, -1, -1):
            sums = pass_over(rows, tasks, {n: expected_model(posteriors[n]) if variational else models[n] for n in live})
            for n, s in sums.items():
                path[n].append(s["ll"] - (divergence(posteriors[n], priors[n[0]]) if variational else 0.0))
            live = [n for n in live if left and not (len(path[n]) > 1 and path[n][-1] - path[n][-2] < tol)]
            if not live:
                break
            for n in live:
                if variational:
                    posteriors[n] = posterior_of(sums[n], priors[n[0]])
                else:
                    models[n] = m_step(sums[n])
        best = {k: max(range(restarts), key=lambda r: path[k, r][-1]) for k in ks}
        if variational:
            models = {(k, r): settled_model(posteriors[k, r]) for k, r in best.items()}
            loglik = {k: s["ll"] for (k, _), s in pass_over(rows, tasks, models).items()}
        else:
            loglik = {k: path[k, r][-1] for k, r in best.items()}
    finally:
        rows.unpersist()
    out = []
    for k in ks:
        p, own = models[k, best[k]], path[k, best[k]]
        order = np.argsort(p["mean"], kind="stable")
        fit = {"start": p["start"][order].tolist(), "trans": p["trans"][np.ix_(order, order)].tolist(), "mean": p["mean"][order].tolist(), "var": p["var"][order].tolist()}
        out.append({"k": k, "restarts": restarts, **fit, "loglik": loglik[k], "bound": own[-1] if variational else None, "n": row["n"], "path": own})
    return out


def hmm_fit(df: DataFrame, arr: str, k: int, n_iter: int = 20, restarts: int = 3, seed: int = 0, variational: bool = False, tol: float = 1e-2) -> dict:
    """The fit of one number of states."""
    return hmm_fits(df, arr, [k], n_iter, restarts, seed, variational, tol)[0]


def hmm_score(df: DataFrame, arr: str, params: dict) -> DataFrame:
    """One row: total log-likelihood and number of observations, by forward passes in the tasks."""
    import numpy as np

    def run(frames):
        import pandas as pd

        p = stacked([params])
        for frame in frames:
            yield pd.DataFrame({"loglik": [float(np.sum([forward(x, p)[3].sum() for x in by_length(frame[arr], CELLS // len(params["mean"]))]))]})

    total = df.where(F.size(arr) > 0).select(arr).mapInPandas(run, "loglik double").agg(F.sum("loglik").alias("loglik"))
    n = df.agg(F.sum(F.when(F.size(arr) > 0, F.size(arr))).alias("n"))
    return total.join(F.broadcast(n))  # one row by one row


def information(loglik: float, n: int, k: int) -> tuple[float, float]:
    """AIC and BIC of a model of k states."""
    free = (k - 1) + k * (k - 1) + 2 * k
    return 2 * free - 2 * loglik, free * math.log(n) - 2 * loglik


def hmm_model_selection(df: DataFrame, arr: str, ks: list[int], n_iter: int = 10, restarts: int = 2, seed: int = 0) -> DataFrame:
    """k, loglik, aic, bic of the fit of each number of states."""
    rows = [(m["k"], m["loglik"], *information(m["loglik"], m["n"], m["k"])) for m in hmm_fits(df, arr, ks, n_iter, restarts, seed)]
    return df.sparkSession.createDataFrame(rows, "k int, loglik double, aic double, bic double")


def viterbi(x, log_start, log_trans, mean, var):
    """The likeliest states of sequences x (rows of equal length); of equal ones the lower state."""
    import numpy as np

    k = len(mean)
    emit = [-0.5 * math.log(2 * math.pi * var[j]) - (x - mean[j]) * (x - mean[j]) / (2 * var[j]) for j in range(k)]
    if len(x) < 4:
        return np.stack([_viterbi_of_one([e[i] for e in emit], log_start, log_trans) for i in range(len(x))])
    emit = np.stack(emit, axis=2)
    n = x.shape[1]
    back = np.zeros((n, len(x), k), np.uint8)
    v = np.asarray(log_start) + emit[:, 0]
    for t in range(1, n):
        came = v[:, :, None] + np.asarray(log_trans)
        back[t] = came.argmax(1)
        v = came.max(1) + emit[:, t]
    out = np.empty((len(x), n), np.int32)
    out[:, -1] = v.argmax(1)
    each = np.arange(len(x))
    for t in range(n - 1, 0, -1):
        out[:, t - 1] = back[t][each, out[:, t]]
    return out


def _viterbi_of_one(emit, log_start, log_trans):
    """The same for one sequence, whatever its length: plain numbers, and one byte a state and step."""
    import numpy as np

    k, n = len(emit), len(emit[0])
    columns = [e.tolist() for e in emit]
    into = [[row[j] for row in log_trans] for j in range(k)]
    v, back, states = [s + c[0] for s, c in zip(log_start, columns)], bytearray(n * k), range(1, k)
    for t in range(1, n):
        new, at = [], t * k
        for j, way in enumerate(into):
            best, arg = v[0] + way[0], 0
            for i in states:
                other = v[i] + way[i]
                if other > best:
                    best, arg = other, i
            back[at + j] = arg
            new.append(best + columns[j][t])
        v = new
    out = np.empty(n, np.int32)
    state = v.index(max(v))
    for t in range(n - 1, -1, -1):
        out[t] = state
        state = back[t * k + state]
    return out


def hmm_decode(df: DataFrame, arr: str, params: dict) -> DataFrame:
    """df with hidden_states: the most likely path of each sequence; ties go to the lower state; empty without values.

    Linear in a sequence: sequences of a batch are decoded by length, all of one length at once, with one byte a step and state.
    """
    log = lambda v: math.log(max(float(v), 1e-300))
    start, trans = [log(v) for v in params["start"]], [[log(v) for v in row] for row in params["trans"]]
    mean, var = [float(v) for v in params["mean"]], [float(v) for v in params["var"]]
    others = [c for c in df.columns if c.lower() != "hidden_states"]
    place = others.index(next(c for c in others if c.lower() == arr.lower()))
    schema = T.StructType([df.schema[c] for c in others]).add("hidden_states", T.ArrayType(T.IntegerType()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            column = batch.column(place)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # a null row may stand on any values
            first = column.offsets.to_numpy()[:-1].astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False).astype(float)
            ends = np.r_[0, np.cumsum(size)]
            states = np.empty(ends[-1], np.int32)
            for n in np.unique(size[size > 0]).tolist():
                rows, step = np.flatnonzero(size == n), max(1, CELLS // n)
                for i in range(0, len(rows), step):
                    at = rows[i : i + step]
                    states[ends[at][:, None] + np.arange(n)] = viterbi(values[first[at][:, None] + np.arange(n)], start, trans, mean, var)
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(states))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], schema.names)

    # numbered names, as mapInArrow takes no names with dots
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).mapInArrow(run, schema)


def hmm_state_features(df: DataFrame, states: str, k: int) -> DataFrame:
    """df with counts and shares of states, transition counts and shares, ends, changes, dwell times and entropy; k is fixed."""
    s, n = F.col(states), F.size(states)
    pairs = F.zip_with(F.slice(s, 1, F.greatest(n - 1, F.lit(0))), F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * k + b)
    df = df.withColumn("_t", pairs)
    # runs: where one starts, and how far the next one is
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(states, i) != F.get(states, i - 1)))
    df = df.withColumn("_s", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_r", F.zip_with("_s", ends, lambda a, z: F.struct(F.get(states, a).cast("int").alias("s"), (z - a).alias("n"))))
    out: dict = {}
    share = lambda a, b: half_even(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, x: p + x)
    held = lambda i: F.size(F.filter(states, lambda x: x == i))
    left = lambda i: F.size(F.filter("_t", lambda t: F.floor(t / k) == i))
    moved = lambda i, j: F.size(F.filter("_t", lambda t: t == i * k + j))
    dwell = lambda i: F.transform(F.filter("_r", lambda r: r["s"] == i), lambda r: r["n"].cast("double"))
    for i in range(k):
        out[f"state_{i}_count"] = held(i)
        out[f"state_{i}_prop"] = share(held(i), n)
        for j in range(k):
            out[f"trans_{i}_{j}_count"] = moved(i, j)
            out[f"trans_{i}_{j}_prob"] = share(moved(i, j), left(i))
        mean = F.try_divide(total(dwell(i)), F.size(dwell(i)))
        square = F.try_divide(total(F.transform(dwell(i), lambda x: x * x)), F.size(dwell(i)))
        out[f"dwell_{i}_mean"] = half_even(F.coalesce(mean, F.lit(0.0)), 4)
        out[f"dwell_{i}_var"] = half_even(F.coalesce(square - mean * mean, F.lit(0.0)), 4)
    out["start_state"] = F.get(states, F.lit(0)).cast("int")
    out["end_state"] = F.try_element_at(states, F.lit(-1)).cast("int")
    out["n_changes"] = F.size(F.filter("_t", lambda t: F.floor(t / k) != t % k))
    p = [F.coalesce(F.try_divide(held(i), n), F.lit(0.0)) for i in range(k)]
    entropy = sum((F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p[1:]), F.when(p[0] > 0, -p[0] * F.log(p[0])).otherwise(0.0))
    out["state_entropy"] = half_even(entropy, 4)
    return df.withColumns(out).drop("_t", "_s", "_r")


def hmm_features_table(df: DataFrame, states: str, k: int, cfg: Config = DEFAULT) -> DataFrame:
    """State features with the dataset of each sample."""
    return split_by_sample_list(hmm_state_features(df, states, k), cfg.datasets)


def hmm_run_log(spark, params: dict) -> DataFrame:
    """One row that sums up a fit, to append to a table of runs."""
    aic, bic = information(params["loglik"], params["n"], params["k"])
    row = (params["k"], params["restarts"], len(params["path"]), params["n"], params["loglik"], aic, bic, [float(x) for x in params["mean"]])
    return spark.createDataFrame([row], "k int, restarts int, iterations int, n long, loglik double, aic double, bic double, means array<double>")
