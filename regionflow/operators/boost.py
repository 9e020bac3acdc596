"""Boosted trees with second-order gain, grown by sums over bins.

Features are binned once, at quantiles.  A level of a tree takes one job: each
task adds up gradients and hessians of its rows by node, feature and bin, Spark
adds up the tasks' sums, and the driver, which gets as many numbers as nodes,
features and bins make, chooses the splits.  A node of ``SMALL`` rows or fewer
needs no more levels: Spark deals its rows to a task of its own, which grows all
that is below it, so that a tree of few rows is one job, not one a level.  If all rows are no more
than that, and trees more than ``FEW``, a task grows all trees of a model, and all models are one job.  Trees
of several parameter points grow at once, all that wait in every job, so their number costs no jobs.
A task walks its rows down the trees, from the margins that
were written last (every ``REST`` trees), so a lost executor costs what its rows cost.

A split's gain is G_l^2 / (H_l + lambda) + G_r^2 / (H_r + lambda) - G^2 / (H +
lambda), each G cut by alpha towards zero (L1), and must exceed gamma; both sides
need a hessian of min_child_weight.  Rows without a value go to the side where
the gain is larger.  A leaf adds -eta G / (H + lambda), G cut by alpha.
"""

from __future__ import annotations

import json
import sys
import zlib
from dataclasses import asdict, dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trees between two writes of margins; depth of a tree without a bound; sums of a job; rows that are worth a task.
REST, DEEPEST, SUMS, TASK = 5, 30, 1 << 22, 1024
#: Trees that are a job each, however few rows they have, so that a lost task costs one tree.
FEW = 5
#: Rows of a node below which one task grows the rest; nodes that it splits at once.
SMALL, NODES = 1 << 20, 32
#: Values of a pack of features that are counted together, for nodes of few and of many rows; bins of features whose sums are searched together.
PACKS, WIDTHS = (64, 1024), (3, 5, 9, 17)
DEFAULTS = {"n_estimators": 100, "max_depth": 6, "eta": 0.3, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0, "reg_lambda": 1.0, "reg_alpha": 0.0, "gamma": 0.0, "scale_pos_weight": 1.0, "seed": 0}


@dataclass
class Tree:
    """Nodes by number: feature (-1: a leaf), the last bin that goes left, whether missing values go left, children, value."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    missing_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self, value: float = 0.0) -> int:
        for x, v in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            x.append(v)
        return len(self.feature) - 1

    def node_of(self, bins):
        """The node where each row of bins (0: missing) ends."""
        import numpy as np

        feature, cut, missing, left, right = (np.asarray(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at, i = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            n = at[i]
            inner = feature[n] >= 0
            if not inner.all():
                i, n = i[inner], n[inner]
            if not len(i):
                return at
            b = bins[i, feature[n]]
            at[i] = np.where(np.where(b == 0, missing[n], b <= cut[n]), left[n], right[n])


@dataclass
class Boosted:
    """A fitted model: the features' cuts and the trees."""

    feats: list
    cuts: list
    params: dict
    trees: list = field(default_factory=list)

    def margin(self, bins):
        import numpy as np

        total = np.zeros(len(bins))
        for t in self.trees:
            total += np.asarray(t.value)[t.node_of(bins)]
        return total

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=lambda x: x.tolist())

    @staticmethod
    def from_json(text: str) -> Boosted:
        held = json.loads(text)
        return Boosted(**held | {"trees": [Tree(**t) for t in held["trees"]]})

    def predicted(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """df with probability and out (0 or 1)."""
        import numpy as np

        kept = [c for c in df.columns if c.lower() not in ("probability", out.lower())]
        schema = T.StructType([df.schema[c] for c in kept]).add("probability", "double").add(out, "integer")
        places = [kept.index(c) for c in self.feats]

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                bins = binned([batch.column(i) for i in places], self.cuts)
                p = 1 / (1 + np.exp(-self.margin(bins)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p > 0.5).astype(np.int32))], schema.names)

        return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]).mapInArrow(run, schema)


def confusions(models: list[Boosted], df: DataFrame, label: str) -> DataFrame:
    """tn, fp, fn, tp of each point (a model's place), by one pass over df; all models have the same features and cuts, so rows are binned once."""
    import numpy as np

    cuts = models[0].cuts

    def run(batches):
        import pyarrow as pa

        cells = np.zeros((len(models), 4), np.int64)
        for batch in batches:
            y, bins = batch.column(0).to_numpy(), binned(batch.columns[1:], cuts)
            for m, model in enumerate(models):
                pred = (1 / (1 + np.exp(-model.margin(bins))) > 0.5).astype(np.int64)
                cells[m] += np.bincount(2 * y + pred, minlength=4)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), *(pa.array(cells[:, k]) for k in range(4))], ["point", "tn", "fp", "fn", "tp"])

    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).cast("long").alias("y"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(models[0].feats)])
    return rows.mapInArrow(run, "point int, tn long, fp long, fn long, tp long").groupBy("point").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])


def cuts_of(df: DataFrame, feats: list[str], bins: int = 32, accuracy: int = 2000) -> tuple[list[list[float]], int]:
    """The distinct quantiles of each feature, and the number of rows, in one job; values up to the i-th one are bin i + 1, missing ones bin 0."""
    levels = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(F.count("*").alias("n"), *[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), levels, accuracy).alias(f"q{i}") for i, c in enumerate(feats)]).first()
    return [sorted(set(q or [])) for q in row[1:]], row["n"]


def binned(columns, cuts):
    """Bins of Arrow columns: rows by features."""
    import numpy as np

    out = np.zeros((len(columns[0]), len(columns)), np.uint8)
    for i, (c, q) in enumerate(zip(columns, cuts)):
        v = c.cast("float64").to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(np.array(q), v) + 1)
    return out


def drawn(row, tree: int, seed: int):
    """A number in [0, 1) for each row and a tree, the same wherever the row is."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((tree + 1) * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB) % 2**64)
        for shift, mix in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mix)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53


def columns_of(tree: int, n: int, params: dict):
    """The features that a tree may split by."""
    import numpy as np

    m = max(1, int(round(params["colsample_bytree"] * n)))
    return np.sort(np.random.default_rng([params["seed"], tree]).permutation(n)[:m]) if m < n else np.arange(n)


def cut_towards_zero(g, alpha: float):
    import numpy as np

    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0) if alpha else g


def best_split(g, h, allowed, p: dict):
    """gain, feature, bin, missing_left of sums g, h (features by bins, bin 0 missing), or None if none may split; ties: first feature, then bin, then missing to the right."""
    return best_splits(g[None], h[None], allowed, p)[0]


def best_splits(g, h, allowed, p: dict) -> list:
    """``best_split`` of each of several nodes, whose sums are g, h (nodes by features by bins)."""
    import numpy as np

    found = splits_of([(np.flatnonzero(allowed), g[:, allowed], h[:, allowed])], p)
    return [(gain, f, b, missing) if good else None for good, gain, f, b, missing, _, _ in zip(*(x.tolist() for x in found))]


def splits_of(parts: list, p: dict):
    """Of each node: whether it may be split, gain, feature, bin, missing_left, and the left side's sums; ties as ``best_split`` has them.

    parts: the numbers of features that have as many bins, ascending, and their sums g, h (nodes by features by bins).
    """
    import numpy as np

    lam, alpha = p["reg_lambda"], p["reg_alpha"]
    score = lambda a, b: cut_towards_zero(a, alpha) ** 2 / (b + lambda_of(b, lam))
    least, every = max(p["min_child_weight"], 1e-12), []
    for _, g, h in parts:
        total_g, total_h = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
        whole = score(total_g, total_h)
        gains, below_g, below_h = [], np.cumsum(g[:, :, 1:], 2), np.cumsum(h[:, :, 1:], 2)
        # where no value is missing, both sides are the same for them
        for missing in (0, 1) if h[:, :, 0].any() else (0,):
            gl, hl = (below_g + g[:, :, :1], below_h + h[:, :, :1]) if missing else (below_g, below_h)
            gr, hr = total_g - gl, total_h - hl
            gain = score(gl, hl) + score(gr, hr) - whole
            gain[(hl < least) | (hr < least) | (hl <= 1e-12) | (hr <= 1e-12)] = -np.inf
            gains.append(gain)
        every.append(np.stack(gains, 3))
    nodes = np.arange(len(parts[0][1]))
    best = np.max([x.reshape(len(nodes), -1).max(1, initial=-np.inf) for x in every], axis=0)
    # sums are added in any order, so gains within rounding are equal
    least_gain = best - 1e-9 * np.maximum(1.0, np.abs(best))
    out = [np.full(len(nodes), v) for v in (-np.inf, 1 << 30, 0, False, 0.0, 0.0)]
    for (numbers, g, h), gain in zip(parts, every):
        if not len(numbers):
            continue
        flat = gain.reshape(len(nodes), -1)
        at = np.argmax(flat >= least_gain[:, None], axis=1)
        f, b, missing = np.unravel_index(at, gain.shape[1:])
        here = np.flatnonzero((flat[nodes, at] >= least_gain) & (numbers[f] < out[1]))
        f, b, missing = f[here], b[here], missing[here]
        left = [np.cumsum(x[here, f, 1:], 1)[np.arange(len(here)), b] + missing * x[here, f, 0] for x in (g, h)]
        for x, v in zip(out, (flat[here, at[here]], numbers[f], b + 1, missing > 0, *left)):
            x[here] = v
    return np.isfinite(out[0]) & (out[0] > max(p["gamma"], 1e-6)), *out


def lambda_of(h, lam: float):
    """lambda, kept from dividing by zero."""
    import numpy as np

    return lam if lam > 0 else np.where(h + lam > 0, lam, 1.0)


def leaf_value(g: float, h: float, p: dict) -> float:
    return float(-p["eta"] * cut_towards_zero(g, p["reg_alpha"]) / (h + lambda_of(h, p["reg_lambda"])))


def deepest_of(p: dict) -> int:
    return DEEPEST if p["max_depth"] is None else p["max_depth"]


def divide(tree: Tree, node: int, depth: int, total: tuple, found, left: tuple, p: dict) -> list[int]:
    """Makes a node a leaf or splits it as found, by its sums g, h and those of its left side; the children that may be split again."""
    deepest, (total_g, total_h) = deepest_of(p), total
    tree.value[node] = leaf_value(total_g, total_h, p)
    if not found:
        return []
    tree.feature[node], tree.cut[node], tree.missing_left[node] = found
    open_ = []
    for side, (a, b) in ((tree.left, left), (tree.right, (total_g - left[0], total_h - left[1]))):
        side[node] = tree.add(leaf_value(a, b, p))
        # one that can't be split needs no sums of its own
        if depth + 1 < deepest and b >= 2 * p["min_child_weight"] - 1e-9:
            open_.append(side[node])
    return open_


def packs_of(values: list[int], most: int) -> list[list[int]]:
    """Features in packs whose numbers of values have a product of ``most`` at most; a larger one is alone."""
    packs, size = [], most + 1
    for f in sorted(range(len(values)), key=values.__getitem__):
        if size * values[f] > most:
            packs.append([])
            size = 1
        packs[-1].append(f)
        size *= values[f]
    return packs


def codes_of(by_feature, values: list[int], packs: list[list[int]]) -> list[tuple]:
    """Of each pack: its features, and one number a row that stands for the values of all."""
    import numpy as np

    out = []
    for pack in packs:
        code = by_feature[pack[0]].astype(np.uint16)
        for f in pack[1:]:
            code = code * np.uint16(values[f]) + by_feature[f]
        out.append((pack, code))
    return out


def margins_of(sums, pack: list[int], values: list[int], put) -> None:
    """Calls put(feature, sums by its values) for each of a pack, from sums (two by nodes by codes)."""
    if len(pack) == 1:
        put(pack[0], sums)
        return
    half = len(pack) // 2
    first, second = pack[:half], pack[half:]
    size = 1
    for f in first:
        size *= values[f]
    both = sums.reshape(*sums.shape[:2], size, -1)
    margins_of(both.sum(3), first, values, put)
    margins_of(both.sum(2), second, values, put)


def subtree(bins, g, h, columns, depth: int, width: int, p: dict) -> Tree:
    """All that grows from a node at a depth, from its rows: their bins of the columns (features by number), gradients and hessians.

    Features of few values are counted in packs, one number a row for all of a pack, whose sums are added up to those of each.
    """
    import numpy as np

    tree, m = Tree(), len(columns)
    at, waiting = np.zeros(len(bins), np.int64), [tree.add()]
    by_feature = np.ascontiguousarray(bins.T)
    values = (by_feature.max(1) + 1).tolist()
    coded = {most: codes_of(by_feature, values, packs_of(values, most)) for most in PACKS}
    # features by width, so that those of few values have few sums
    classes = {w: [f for f in range(m) if max(v for v in (0, *WIDTHS) if v < w) < values[f] <= w] for w in (*WIDTHS, width)}
    classes = {w: np.array(c) for w, c in classes.items() if c}
    place_of = {int(f): (w, i) for w, c in classes.items() for i, f in enumerate(c)}
    while waiting:
        following = []
        for i in range(0, len(waiting), max(1, SUMS // (m * width))):
            nodes = waiting[i : i + max(1, SUMS // (m * width))]
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            # rows that stand at a node that was split after the places were made wait for the next level
            here = np.flatnonzero((at < len(place)) & (place[np.minimum(at, len(place) - 1)] >= 0))
            own, weights = place[at[here]], (g[here], h[here])
            total = [np.bincount(own, v, len(nodes)) for v in weights]
            deep = depth >= deepest_of(p)
            sums = {w: np.zeros((2, len(nodes), len(c), w)) for w, c in classes.items()} if not deep else {}

            def put(f, x):
                w, j = place_of[f]
                sums[w][:, :, j, : x.shape[2]] = x

            # packs of many values pay where a node has more rows than those
            for pack, code in () if deep else coded[PACKS[len(here) >= PACKS[1] * len(nodes)]]:
                size = 1
                for f in pack:
                    size *= values[f]
                key = own * size + (code if len(here) == len(code) else code[here])
                margins_of(np.stack([np.bincount(key, v, len(nodes) * size) for v in weights]).reshape(2, len(nodes), size), pack, values, put)
            for j in range(0, len(nodes), NODES):
                part = slice(j, j + NODES)
                own_total = list(zip(*(t[part].tolist() for t in total)))
                if deep:
                    splits = [(False, 0, 0, 0, False, 0.0, 0.0)] * len(own_total)
                else:
                    splits = zip(*(x.tolist() for x in splits_of([(c, *sums[w][:, part]) for w, c in classes.items()], p)))
                for node, both, (good, _, f, cut, missing, *left) in zip(nodes[part], own_total, splits):
                    following += divide(tree, node, depth, both, good and (f, cut, missing), left, p)
        feature, cut, missing, left, right = (np.array(x) for x in (tree.feature, tree.cut, tree.missing_left, tree.left, tree.right))
        moves = np.flatnonzero(feature[at] >= 0)
        n = at[moves]
        b = bins[moves, feature[n]]
        at[moves] = np.where(np.where(b == 0, missing[n], b <= cut[n]), left[n], right[n])
        waiting, depth = following, depth + 1
    tree.feature = [int(columns[f]) if f >= 0 else -1 for f in tree.feature]
    return tree


class Growing:
    """One model while its trees grow: the tree, its nodes that a next job has to split with their depths, and the rows that a node has at most."""

    def __init__(self, model: Boosted, n_rows: int):
        self.model, self.n_rows, self.waiting = model, n_rows, {}
        self.begin()

    @property
    def done(self) -> bool:
        return len(self.model.trees) >= self.model.params["n_estimators"]

    def begin(self) -> None:
        self.tree = Tree()
        root = self.tree.add()
        self.waiting, self.rows = {root: 0}, {root: self.n_rows}

    def columns(self):
        return columns_of(len(self.model.trees), len(self.model.feats), self.model.params)

    def split(self, node: int, g, h) -> None:
        """Makes a node that waits a leaf or splits it, by its sums; a tree without such nodes is finished."""
        import numpy as np

        depth, columns, p = self.waiting.pop(node), self.columns(), self.model.params
        allowed = np.zeros(len(g), bool)
        allowed[columns] = True
        found = best_split(g, h, allowed, p) if depth < deepest_of(p) else None
        total, left = [float(x[columns[0]].sum()) for x in (g, h)], None
        if found:
            _, f, cut, missing = found
            left, found = [float(x[f, 1 : cut + 1].sum() + missing * x[f, 0]) for x in (g, h)], found[1:]
        for child in divide(self.tree, node, depth, total, found, left, p):
            self.waiting[child], self.rows[child] = depth + 1, self.rows[node]
        self.end()

    def graft(self, node: int, below: Tree) -> None:
        """Puts a tree in the place of a node that waits."""
        self.waiting.pop(node)
        t, start = self.tree, len(self.tree.feature) - 1
        number = lambda n: -1 if n < 0 else node if n == 0 else n + start
        for i in range(len(below.feature)):
            at = node if i == 0 else t.add()
            t.feature[at], t.cut[at], t.missing_left[at], t.value[at] = below.feature[i], below.cut[i], below.missing_left[i], below.value[i]
            t.left[at], t.right[at] = number(below.left[i]), number(below.right[i])
        self.end()

    def end(self) -> None:
        if not self.waiting:
            self.model.trees.append(by_level(self.tree))
            if not self.done:
                self.begin()


def by_level(t: Tree) -> Tree:
    """The tree with its nodes numbered level by level, whichever way it grew."""
    order = [0]
    for n in order:
        if t.feature[n] >= 0:
            order += [t.left[n], t.right[n]]
    number = {n: i for i, n in enumerate(order)} | {-1: -1}
    pick = lambda x: [x[n] for n in order]
    return Tree(pick(t.feature), pick(t.cut), pick(t.missing_left), [number[n] for n in pick(t.left)], [number[n] for n in pick(t.right)], pick(t.value))


ROWS = T.StructType().add("row", "long").add("bins", "binary").add("y", "integer").add("margins", T.ArrayType(T.DoubleType()))


def jobs_of(growing: list[Growing], asked: list[tuple[int, int]], rested: list[int]) -> list[tuple]:
    """What a task has to know of each model with asked (model, node)s, which stand by model: its number, parameters, trees since its margins were
    written, the tree that grows and its number, the nodes, the first one's place, and the features."""
    number = {a: i for i, a in enumerate(asked)}
    out = []
    for m in sorted({m for m, _ in asked}):
        g = growing[m]
        nodes = [n for mm, n in asked if mm == m]
        out.append((m, g.model.params, g.model.trees[rested[m] :], g.tree, len(g.model.trees), nodes, number[m, nodes[0]], g.columns()))
    return out


def derivatives(batch, jobs: list[tuple], n_feats: int):
    """For each job with rows here: the job, those rows' bins, places among the job's nodes, gradients and hessians."""
    import numpy as np

    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n_feats)
    row, y = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(float)
    margins = batch.column(3).flatten().to_numpy().reshape(len(row), -1)
    for job in jobs:
        m, p, trees, tree, nth, nodes = job[:6]
        at = tree.node_of(bins)
        # the nodes of a model stand in a row
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        here = place[at] >= 0
        if p["subsample"] < 1:
            here &= drawn(row, nth, p["seed"]) < p["subsample"]
        i = np.flatnonzero(here)
        if len(i):
            own = bins[i]
            margin = margins[i, m] + sum((np.array(t.value)[t.node_of(own)] for t in trees), np.zeros(len(i)))
            prob = 1 / (1 + np.exp(-margin))
            weight = np.where(y[i] > 0, p["scale_pos_weight"], 1.0)
            yield job, own, place[at[i]], (prob - y[i]) * weight, np.maximum(prob * (1 - prob), 1e-16) * weight


def level(rows: DataFrame, growing: list[Growing], asked: list[tuple[int, int]], rested: list[int], width: int):
    """Sums (asked, features, width, 2) of gradients and hessians of the asked (model, node)s, whose numbers of rows are noted."""
    import numpy as np

    n_feats = len(growing[0].model.feats)
    jobs = jobs_of(growing, asked, rested)
    cells = len(asked) * n_feats * width

    def run(batches):
        import pyarrow as pa

        total, count = np.zeros((2, cells)), np.zeros(len(asked))
        for batch in batches:
            for (_, _, _, _, _, nodes, first, columns), bins, place, *sums in derivatives(batch, jobs, n_feats) if batch.num_rows else ():
                start, size = first * n_feats * width, len(nodes) * n_feats * width
                count[first : first + len(nodes)] += np.bincount(place, minlength=len(nodes))
                for k, v in enumerate(sums):
                    key = ((place * n_feats)[:, None] + columns) * width + bins[:, columns]
                    total[k, start : start + size] += np.bincount(key.ravel(), np.repeat(v, len(columns)), size)
        some, held = np.flatnonzero(total[1]), np.flatnonzero(count)
        # numbers of rows stand behind the sums
        at, g, h = np.r_[some, cells + held], np.r_[total[0][some], count[held]], np.r_[total[1][some], np.zeros(len(held))]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g), pa.array(h)], ["at", "g", "h"])

    sums = rows.mapInArrow(run, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, cells + len(asked)))
    for k, c in enumerate(("g", "h")):
        out[k][sums.column("at").to_numpy()] = sums.column(c).to_numpy()
    for (m, node), n in zip(asked, out[0, cells:]):
        growing[m].rows[node] = int(n)
    return out[:, :cells].reshape(2, len(asked), n_feats, width)


def grown_below(rows: DataFrame, growing: list[Growing], asked: list[tuple[int, int]], rested: list[int], width: int) -> dict[int, Tree]:
    """The trees that grow from the asked (model, node)s of ``SMALL`` rows at most, by place in asked; each is one task's, to which Spark deals the node's rows."""
    import numpy as np

    n_feats = len(growing[0].model.feats)
    jobs = jobs_of(growing, asked, rested)
    # what a task has to know of a node: its depth, the features, the parameters
    known = [(growing[m].waiting[n], growing[m].columns(), growing[m].model.params) for m, n in asked]

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for (_, _, _, _, _, nodes, first, columns), bins, place, g, h in derivatives(batch, jobs, n_feats) if batch.num_rows else ():
                order = np.argsort(place, kind="stable")
                ends = np.searchsorted(place[order], np.arange(len(nodes) + 1))
                for j in np.flatnonzero(np.diff(ends)).tolist():
                    i = order[ends[j] : ends[j + 1]]
                    out.append((first + j, np.ascontiguousarray(bins[i][:, columns]).tobytes(), g[i].tobytes(), h[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["node", "bins", "g", "h"])

    def grow(batches):
        import pyarrow as pa

        held: dict = {}
        for batch in batches:
            for node, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(node, []).append(parts)
        for node, parts in held.items():
            depth, columns, p = known[node]
            bins, g, h = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts), (np.uint8, float, float)))
            tree = subtree(bins.reshape(-1, len(columns)), g, h, columns, depth, width, p)
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([json.dumps(asdict(tree))])], ["node", "tree"])

    # one node a task
    dealt = rows.mapInArrow(deal, "node int, bins binary, g binary, h binary").repartitionById(len(asked), "node")
    got = dealt.mapInArrow(grow, "node int, tree string").toArrow()
    return {n: Tree(**json.loads(t)) for n, t in zip(got.column("node").to_pylist(), got.column("tree").to_pylist())}


def packed(trees: list[Tree]) -> bytes:
    """Trees as bytes; their nodes are numbered level by level, so the k-th inner node's children are 2 k + 1 and 2 k + 2."""
    import numpy as np

    parts = [np.array([len(t.feature) for t in trees], np.int32)]
    parts += [np.concatenate([np.asarray(x, kind) for x in column]) for column, kind in (([t.feature for t in trees], np.int16), ([t.cut for t in trees], np.uint8), ([t.missing_left for t in trees], bool), ([t.value for t in trees], float))]
    return zlib.compress(b"".join(x.tobytes() for x in parts), 1)


def unpacked(data: bytes, n: int) -> list[Tree]:
    """The n trees of ``packed``, as arrays."""
    import numpy as np

    data, at = zlib.decompress(data), 0
    sizes = np.frombuffer(data, np.int32, n)
    at, columns, ends = sizes.nbytes, [], np.cumsum(sizes)
    for kind in (np.int16, np.uint8, bool, float):
        columns.append(np.split(np.frombuffer(data, kind, ends[-1], at), ends[:-1]))
        at += columns[-1][0].itemsize * int(ends[-1])
    trees = []
    for feature, cut, missing, value in zip(*columns):
        inner = feature >= 0
        left = np.where(inner, 2 * np.cumsum(inner, dtype=np.int32) - 1, -1)
        trees.append(Tree(feature, cut, missing, left, np.where(inner, left + 1, -1), value))
    return trees


def trees_of(bins, row, y, width: int, p: dict):
    """All trees of a model, one after another, from all rows: their bins (features by number), numbers and classes."""
    import numpy as np

    margin, weight = np.zeros(len(y)), np.where(y > 0, p["scale_pos_weight"], 1.0)
    for nth in range(p["n_estimators"]):
        columns = columns_of(nth, bins.shape[1], p)
        i = np.flatnonzero(drawn(row, nth, p["seed"]) < p["subsample"]) if p["subsample"] < 1 else np.arange(len(y))
        prob = 1 / (1 + np.exp(-margin[i]))
        g, h = (prob - y[i]) * weight[i], np.maximum(prob * (1 - prob), 1e-16) * weight[i]
        tree = subtree(bins[i][:, columns], g, h, columns, 0, width, p) if len(i) else leaf(p)
        margin += np.array(tree.value)[tree.node_of(bins)]
        yield by_level(tree)


def leaf(p: dict) -> Tree:
    """The tree of no rows."""
    return Tree([-1], [0], [False], [-1], [-1], [leaf_value(0.0, 0.0, p)])


def dealt(rows: DataFrame, cuts: list, places: int) -> DataFrame:
    """The bins of rows (part, row, y, features), all of them to each of so many tasks."""
    import numpy as np

    def deal(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            part, row, y = (batch.column(k).to_numpy() for k in range(3))
            bins = binned(batch.columns[3:], cuts)
            for k in np.unique(part).tolist():
                i = np.flatnonzero(part == k)
                own = [x[i].tobytes() for x in (row, y, bins)]
                for place in range(places):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((place, k, *own), kinds)], ["place", "part", "row", "y", "bins"])

    return rows.mapInArrow(deal, "place int, part int, row binary, y binary, bins binary").repartitionById(places, "place")


def gathered(batches, n_feats: int):
    """From what ``dealt`` gives a task: each place, and of the rows of parts 0 and 1 by their numbers: those, classes, bins."""
    import numpy as np

    held: dict = {}
    for batch in batches:
        for place, part, *own in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(place, ([], []))[part].append(own)
    while held:
        place, parts = held.popitem()
        out = []
        for own in parts:
            row, y, bins = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*own) if own else ((), (), ()), (np.int64, np.int32, np.uint8)))
            own.clear()
            order = np.argsort(row)
            out.append((row[order], y[order], bins.reshape(-1, n_feats)[order]))
        yield place, out


def places_of(points: list[dict]) -> list[int]:
    """The points by their tasks: the longest ones begin first."""
    return sorted(range(len(points)), key=lambda i: -points[i]["n_estimators"] * deepest_of(points[i]) * points[i]["subsample"])


def parts_of(df: DataFrame, part: int, feats: list[str], label: str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(feats)])


def grown_and_scored(df: DataFrame, held: DataFrame, feats: list[str], label: str, points: list[dict], bins: int = 32, trees: bool = False) -> tuple[DataFrame, list]:
    """A table of point (its place), tn, fp, fn, tp on ``held`` and, if asked for, its packed trees; and the cuts.

    For df and held of ``SMALL`` rows at most: each point is one task's, which gets all rows, grows its trees and scores them, so that the driver gets four numbers a point.
    """
    import numpy as np

    points = [DEFAULTS | p for p in points]
    df, held = df.where(F.col(label).isNotNull()), held.where(F.col(label).isin(0, 1))
    cuts, _ = cuts_of(df, feats, bins)
    width, n_feats, order = max(map(len, cuts)) + 2, len(feats), places_of(points)

    def grow(batches):
        import pyarrow as pa

        for place, ((row, y, b), (_, held_y, held_b)) in gathered(batches, n_feats):
            point, margin, own = order[place], np.zeros(len(held_y)), []
            for tree in trees_of(b, row, y.astype(float), width, points[point]):
                margin += np.array(tree.value)[tree.node_of(held_b)]
                if trees:
                    own.append(tree)
            cells = np.bincount(2 * held_y.astype(np.int64) + (1 / (1 + np.exp(-margin)) > 0.5), minlength=4)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((point, pa.int32()), *((int(c), pa.int64()) for c in cells), (packed(own) if own else None, pa.binary()))], ["point", "tn", "fp", "fn", "tp", "trees"])

    rows = parts_of(df, 0, feats, label).unionAll(parts_of(held, 1, feats, label))
    return dealt(rows, cuts, len(points)).mapInArrow(grow, "point int, tn long, fp long, fn long, tp long, trees binary"), cuts


def save_packed(table: DataFrame, feats: list[str], cuts: list, params: dict, path: str) -> None:
    """The model of a table of ``grown_and_scored``, as one row of JSON, written by a task; ``Boosted.from_json`` reads it."""
    params = DEFAULTS | params

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [Boosted(list(feats), cuts, params, unpacked(data, params["n_estimators"])).to_json() for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["model"])

    table.where("trees IS NOT NULL").select("trees").mapInArrow(run, "model string").write.mode("overwrite").text(path)


def grown_whole(df: DataFrame, models: list[Boosted], label: str, width: int) -> None:
    """Grows all trees of models of ``SMALL`` rows at most in one job: each model is one task's, to which Spark deals all rows."""
    import numpy as np

    feats, cuts, points = models[0].feats, models[0].cuts, [m.params for m in models]
    n_feats, order = len(feats), places_of(points)

    def grow(batches):
        import pyarrow as pa

        for place, ((row, y, b), _) in gathered(batches, n_feats):
            trees = list(trees_of(b, row, y.astype(float), width, points[order[place]]))
            yield pa.RecordBatch.from_arrays([pa.array([order[place]], pa.int32()), pa.array([packed(trees)], pa.binary())], ["point", "trees"])

    # one model a task
    got = dealt(parts_of(df, 0, feats, label), cuts, len(points)).mapInArrow(grow, "point int, trees binary").toArrow()
    found = dict(zip(got.column("point").to_pylist(), got.column("trees").to_pylist()))
    for i, m in enumerate(models):
        n = m.params["n_estimators"]
        m.trees = unpacked(found[i], n) if i in found and n else [leaf(m.params) for _ in range(n)]


def with_margins(rows: DataFrame, growing: list[Growing], rested: list[int], n_feats: int) -> DataFrame:
    """rows with the margins that the finished trees give."""
    import numpy as np

    new = [g.model.trees[r:] for g, r in zip(growing, rested)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, n_feats)
            margins = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1).copy()
            for m, trees in enumerate(new):
                for t in trees:
                    margins[:, m] += np.array(t.value)[t.node_of(bins)]
            ends = pa.array(np.arange(batch.num_rows + 1) * margins.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(margins.ravel()))], ROWS.names)

    return rows.mapInArrow(run, ROWS)


def boost_fits(df: DataFrame, feats: list[str], label: str, points: list[dict], keep, bins: int = 32) -> list[Boosted]:
    """A model of each point (parameters, DEFAULTS beside them); ``keep`` writes a table to the shared folder and reads it back.

    Rows without a label don't count.  Without rows, all trees are leaves of value 0 and give every row 0.5.
    """
    import numpy as np

    if not 2 <= bins <= 255:
        raise ValueError("a bin is one byte")
    models = [Boosted(list(feats), [], DEFAULTS | p) for p in points]
    df = df.where(F.col(label).isNotNull())
    cuts, n_rows = cuts_of(df, feats, bins)
    for m in models:
        m.cuts = cuts
    width = max(map(len, cuts)) + 2
    n_feats, n_points = len(feats), len(points)
    if n_rows <= SMALL and max(m.params["n_estimators"] for m in models) > FEW:
        grown_whole(df, models, label, width)
        return models

    def to_bins(batches):
        import pyarrow as pa

        for batch in batches:
            b = binned(batch.columns[2:], cuts)
            zero = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * n_points, pa.int32()), pa.array(np.zeros(len(b) * n_points)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in b], pa.binary()), batch.column(1), zero], ROWS.names)

    # the number of a row is written with it, so that it stays the same
    rows = keep(df.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(feats)]).mapInArrow(to_bins, ROWS).coalesce(max(1, -(-n_rows // TASK))))
    growing, rested = [Growing(m, n_rows) for m in models], [0] * n_points
    at_once = max(1, SUMS // (n_feats * width))
    while True:
        asked = [(i, n) for i, g in enumerate(growing) if not g.done for n in g.waiting]
        if not asked:
            discard(rows)
            return models
        large = [(i, n) for i, n in asked if growing[i].rows[n] > SMALL][:at_once]
        small = [(i, n) for i, n in asked if growing[i].rows[n] <= SMALL]
        if large:
            sums = level(rows, growing, large, rested, width)
            for j, (i, node) in enumerate(large):
                growing[i].split(node, sums[0, j], sums[1, j])
        else:
            # nodes of many levels are grown together, once no larger one waits
            below = grown_below(rows, growing, small, rested, width)
            for j, (i, node) in enumerate(small):
                growing[i].graft(node, below.get(j) or leaf(growing[i].model.params))
        grown = max(len(g.model.trees) - r for g, r in zip(growing, rested))
        if grown >= REST and not all(g.done for g in growing):
            before, rows = rows, keep(with_margins(rows, growing, rested, n_feats))
            discard(before)
            rested = [len(g.model.trees) for g in growing]


def boost_fit(df: DataFrame, feats: list[str], label: str, params: dict, keep, bins: int = 32) -> Boosted:
    return boost_fits(df, feats, label, [params], keep, bins)[0]
