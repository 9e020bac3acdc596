"""Random forests of many parameter points, for tables whose rows a task can hold.

Spark ML fits a forest by a job a level, which carries all nodes so far, and its driver
holds all trees.  Here Spark deals the binned rows to ``GROUPS`` tasks; each grows its share of the
trees of all points, lets them vote on the rows held out and sends the sums of votes
on, so that forests are one job and no tree reaches the driver.  Trees are those of Spark ML's
definition: Poisson bags, the root of the number of features drawn for each node, the
largest gain of weighted Gini impurity, a least number of rows in a leaf; classes weigh
what balances them.
"""

from __future__ import annotations

import json
import math
import sys
from dataclasses import asdict, dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import DEEPEST, Tree, cuts_of, dealt, gathered, packed, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that get all rows; trees, and rows that they vote on, in a row of their results; rows, and cells of their sums, at once; rows of a node that is counted alone.
GROUPS, UNIT, CHUNK, STEP, CELLS, MANY = 48, 10, 1 << 16, 4096, 1 << 17, 256
#: Rows of class 1 count so much in a sum of both classes, which is exact for fewer rows.
ONE = float(1 << 26)


def filled(df: DataFrame, feats: list[str], means: list[float]):
    """The features as doubles, missing ones at their mean."""
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)).alias(f"f{i}") for i, (c, m) in enumerate(zip(feats, means))]


def tree_of(bins, y, count, weights, width: int, p: dict, rng, by_feature=None) -> Tree:
    """A tree of rows by their bins (1 and more; ``by_feature`` are the same), classes and numbers of times in the bag; values are the share of class 1.

    Nodes of many rows are counted feature by feature, those of few together.
    """
    import numpy as np

    n_feats, deepest = bins.shape[1], min(p["max_depth"] or DEEPEST, DEEPEST)
    k, least = (n_feats if p["n_estimators"] == 1 else math.ceil(n_feats**0.5)), p["least"]
    rows = np.flatnonzero(count)
    by_feature, flat, both = np.ascontiguousarray(bins.T) if by_feature is None else by_feature, bins.ravel(), count[rows] * np.where(y[rows] > 0, ONE, 1.0)
    values = by_feature.max(1, initial=0).astype(np.int64) + 1
    split_up = lambda c: (c - np.floor(c / ONE) * ONE, np.floor(c / ONE))
    share = lambda c0, c1: weights[1] * c1 / np.maximum(weights[0] * c0 + weights[1] * c1, 1e-300)
    purity = lambda c0, c1: (weights[1] * c1) ** 2 / np.maximum(weights[0] * c0 + weights[1] * c1, 1e-300)
    feature, cut, left, value = [], [], [], []
    # the nodes of a level stand in a row from ``first``, and so do the rows of those that may be split; begin: their rows' places
    c0, c1 = split_up(np.array([both.sum()]))
    first, size, depth, begin = 0, 1, 0, np.array([0, len(rows)])
    while size:
        split_feature, split_cut = np.full(size, -1), np.zeros(size, np.int64)
        # a node of one class, or of too few rows, is a leaf
        open_ = np.flatnonzero((c0 > 0) & (c1 > 0) & (c0 + c1 >= 2 * least)) if depth < deepest else np.zeros(0, np.int64)
        at = np.repeat(np.arange(size), np.diff(begin))
        kept = np.zeros(size, bool)
        kept[open_] = True
        if not kept.all():
            held = np.flatnonzero(kept[at])
            at, rows, both = at[held], rows[held], both[held]
            begin = np.concatenate([[0], np.cumsum(np.diff(begin) * kept)])
        many = np.diff(begin)[open_] > MANY
        few, number = np.zeros(size, bool), np.zeros(size, np.int64)
        few[open_[~many]] = True
        small = np.flatnonzero(few[at])
        # nodes by rows and cells, so that all of a step is near at hand
        most_nodes = max(1, CELLS // (k * width))
        ends = np.concatenate([[0], np.cumsum(np.diff(begin)[open_[~many]])])
        steps = [(x, None) for x in np.split(open_[many], range(most_nodes, int(many.sum()), most_nodes)) if len(x)]
        low = 0
        while low < len(ends) - 1:
            high = min(max(low + 1, int(np.searchsorted(ends, ends[low] + STEP, "right")) - 1), low + most_nodes)
            steps.append((open_[~many][low:high], small[ends[low] : ends[high]]))
            low = high
        for nodes, here in steps:
            n = len(nodes)
            drawn = np.sort(np.argpartition(rng.random((n, n_feats)), k - 1, axis=1)[:, :k], axis=1)
            # each feature has as many cells as values
            wide = values[drawn].ravel()
            end = np.cumsum(wide)
            start = end - wide
            if here is None:
                parts = [slice(begin[v], begin[v + 1]) for v in nodes]
                cells = np.concatenate([np.bincount(by_feature[f].take(rows[i]), both[i], values[f]) for i, fs in zip(parts, drawn) for f in fs])
            else:
                number[nodes] = np.arange(n)
                place = number[at[here]]
                key = start.reshape(n, k)[place] + flat.take((rows[here] * n_feats)[:, None] + drawn[place])
                cells = np.bincount(key.ravel(), np.repeat(both[here], k), end[-1])
            upto = np.cumsum(cells)
            l0, l1 = split_up(upto - np.repeat(upto[start] - cells[start], wide))
            per_node = wide.reshape(n, k).sum(1)
            node = np.repeat(np.arange(n), per_node)
            t0, t1 = c0[nodes], c1[nodes]
            r0, r1 = t0[node] - l0, t1[node] - l1
            gain = purity(l0, l1) + purity(r0, r1) - purity(t0, t1)[node]
            gain[(l0 + l1 < least) | (r0 + r1 < least)] = -1.0
            most = np.maximum.reduceat(gain, np.cumsum(per_node) - per_node)
            best = np.flatnonzero(gain == most[node])
            best = best[np.diff(node[best], prepend=-1) > 0]
            which = np.searchsorted(start, best, "right") - 1
            good = most > 1e-9
            split_feature[nodes] = np.where(good, drawn.ravel()[which], -1)
            split_cut[nodes] = np.where(good, best - start[which], 0)
        inner = split_feature >= 0
        child = np.where(inner, 2 * (np.cumsum(inner) - 1), -1)  # place of the left child, in the next level
        for x, v in ((feature, split_feature), (cut, split_cut), (left, np.where(inner, child + first + size, -1)), (value, share(c0, c1))):
            x.append(v)
        moves = np.flatnonzero(inner[at])
        old = at[moves]
        new = child[old] + (flat.take(rows[moves] * n_feats + split_feature[old]) > split_cut[old])
        first, size, depth = first + size, 2 * int(inner.sum()), depth + 1
        c0, c1 = split_up(np.bincount(new, both[moves], size))
        moves = moves[np.argsort(new.astype(np.uint16) if size <= 1 << 16 else new, kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(new, minlength=size))])
        rows, both = rows[moves], both[moves]
    feature, cut, left, value = (np.concatenate(x) for x in (feature, cut, left, value))
    return Tree(feature, cut, np.zeros(len(feature), bool), left, np.where(left < 0, -1, left + 1), value)


def shares_of(points: list[dict]) -> list[list[tuple[int, int, int]]]:
    """For each task the (point, first tree, end) that it grows: neighbours, so that few tasks vote for the same point, of about the same work."""
    trees = [(i, t, min(p["max_depth"] or DEEPEST, 16)) for i, p in enumerate(points) for t in range(p["n_estimators"])]
    total, done, out = sum(w for *_, w in trees), 0, [{} for _ in range(max(1, min(GROUPS, len(trees))))]
    for i, t, w in trees:
        out[done * len(out) // total].setdefault(i, []).append(t)
        done += w
    return [[(i, ts[0], ts[-1] + 1) for i, ts in task.items()] for task in out]


@dataclass
class Forests:
    """What forests need beside their trees, and a table of results: point; start, trees (packed) of ``UNIT`` trees at most; or chunk, y, votes of the rows held out."""

    feats: list
    cuts: list
    means: list
    sizes: list
    table: DataFrame

    def confusions(self) -> DataFrame:
        """tn, fp, fn, tp of each point (a forest's place): the mean of the trees' shares of class 1 is over a half."""
        import numpy as np

        sizes = self.sizes

        def add(batches):
            import pyarrow as pa

            held: dict = {}
            for batch in batches:
                for point, chunk, y, votes in zip(*(c.to_pylist() for c in batch.columns)):
                    v = np.frombuffer(votes)
                    held[point, chunk] = (y, held[point, chunk][1] + v if (point, chunk) in held else v)
            for (point, _), (y, votes) in held.items():
                # sums are added in any order, so votes within rounding of a half are a half
                cells = np.bincount(2 * np.frombuffer(y, np.uint8).astype(np.int64) + (votes > sizes[point] / 2 + 1e-9), minlength=4)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((point, pa.int32()), *((int(c), pa.int64()) for c in cells))], ["point", "tn", "fp", "fn", "tp"])

        rows = self.table.where("votes IS NOT NULL").select("point", "chunk", "y", "votes").repartition("point", "chunk")
        return rows.mapInArrow(add, "point int, tn long, fp long, fn long, tp long").groupBy("point").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])

    def save(self, path: str) -> None:
        """The trees as lines of JSON, written by tasks; ``trees_from`` reads one."""
        known = {"feats": self.feats, "cuts": self.cuts, "means": self.means}

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                lines = [json.dumps(known | {"point": i, "start": s, "trees": [asdict(t) for t in unpacked(data, n)]}, default=lambda x: x.tolist()) for i, s, n, data in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

        self.table.where("trees IS NOT NULL").select("point", "start", "n", "trees").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def trees_from(line: str) -> list[Tree]:
    import numpy as np

    return [Tree(**{k: np.array(v) for k, v in t.items()}) for t in json.loads(line)["trees"]]


def forests(df: DataFrame, held: DataFrame, feats: list[str], label: str, points: list[dict], seed: int = 1, bins: int = 32, trees: bool = False) -> Forests:
    """Forests of points (n_estimators, max_depth, least: rows of a leaf, bootstrap), grown from df, with their votes on ``held``; their trees are in the results if asked for."""
    import numpy as np

    df, held = (x.where(F.col(label).isin(0, 1)) for x in (df, held))
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in feats]
    row = df.agg(F.count_if(F.col(label) == 0).alias("zeros"), F.count_if(F.col(label) == 1).alias("ones"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    means, n = [v or 0.0 for v in row[2:]], row["zeros"] + row["ones"]
    weights = [n / (2 * c) if c else 0.0 for c in (row["zeros"], row["ones"])]
    parts = [d.select(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), *filled(d, feats, means)) for k, d in enumerate((df, held))]
    cuts, _ = cuts_of(parts[0], parts[0].columns[3:], bins)
    width, n_feats, shares = max(map(len, cuts)) + 2, len(feats), shares_of(points)

    def grow(batches):
        import pyarrow as pa

        schema = pa.schema([("point", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("trees", pa.binary()), ("chunk", pa.int32()), ("y", pa.binary()), ("votes", pa.binary())])
        rows = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(v, schema)], schema=schema)
        for place, ((_, y, b), (_, held_y, held_b)) in gathered(batches, n_feats):
            by_feature = np.ascontiguousarray(b.T)
            for i, first, end in shares[place]:
                p, votes = points[i], np.zeros(len(held_y))
                for start in range(first, end, UNIT):
                    own = []
                    for nth in range(start, min(start + UNIT, end)):
                        rng = np.random.default_rng([seed, nth])
                        count = rng.poisson(1.0, len(y)) if p["bootstrap"] else np.ones(len(y), np.int64)
                        tree = tree_of(b, y, count, weights, width, p, rng, by_feature)
                        votes += tree.value[tree.node_of(held_b)]
                        if trees:
                            own.append(tree)
                    if trees:
                        yield rows(i, start, len(own), packed(own), None, None, None)
                for chunk in range(0, len(votes), CHUNK):
                    part = slice(chunk, chunk + CHUNK)
                    yield rows(i, None, None, None, chunk, held_y[part].astype(np.uint8).tobytes(), votes[part].tobytes())

    table = dealt(parts[0].unionAll(parts[1]), cuts, len(shares)).mapInArrow(grow, "point int, start int, n int, trees binary, chunk int, y binary, votes binary")
    return Forests(list(feats), cuts, means, [p["n_estimators"] for p in points], table)
