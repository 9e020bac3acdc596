"""Quality rules: an isolation forest on rule statistics.

Rule statistics are taken from every whole text.  The forest's trees are random
splits of a bounded sample of labelled good rows (one text each of
``max_labelled`` labelled documents at most, those with the smallest hash of
doc_id); short mean path lengths mark documents unlike them.  Trees are grown
from one half of the good rows; the threshold is calibrated on the other half
and the bad rows: the score that parts good from bad best, among those that
reject ``max_loss`` of the good rows at most.  The model is a few hundred
kilobytes at any corpus size.

Defined results: a null text has no words; texts without words fail the base
rules; a document labelled both ways is bad; with fewer than four good labelled
rows of 50 words, or no bad one, the method rejects nothing and the base rules
alone decide; repeated rows are judged each; empty tables give empty
tables; input columns are kept and clashing ones replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, arrow_map, table, texts_of

MAX_LABELLED, TREES, SUBSAMPLE, MAX_LOSS = 20_000, 100, 256, 0.004

_WORD, _UPPER = re.compile(WORD), bytes(range(65, 91))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words", "short_line_share"]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base statistics and the forest's features of one text."""
    import numpy as np

    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only: the contract's words
    n, chars = len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")) if words else 0
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = 0, 0
    if n:
        ids = dict.fromkeys(words)
        distinct = len(ids)
        ids = dict(zip(ids, range(distinct)))
        w = np.array([ids[x] for x in words], np.int64)
        if n >= 4:
            # two ids and an id: first by pairs, so that the key never outgrows 64 bits
            pair = np.unique(w[:-1] * distinct + w[1:], return_inverse=True)[1]
            _, at, count = np.unique(pair[:-1] * distinct + w[2:], return_inverse=True, return_counts=True)
            hit = np.flatnonzero(count[at] >= 2)
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[hit + k] = True
            repeat = int(mark.sum())
    symbols, upper, lower, digits = (len(raw) - len(raw.translate(None, x)) for x in (b"#*$%&|<>", _UPPER, _UPPER.lower(), b"0123456789"))
    base = [n, chars, symbols, dup, repeat]
    n1, c1, l1 = max(n, 1), max(chars, 1), max(len(lines), 1)
    short = sum(len(x) < 20 for x in lines)
    return base, [symbols / c1, dup / l1, repeat / n1, chars / n1, upper / max(upper + lower, 1), (text.count("!") + text.count("|") + text.count("?")) / n1, digits / c1, distinct / n1 ** 0.8, min(n / l1, 200.0), short / l1]


def with_statistics(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with the base statistics (long) and ``features`` (array of double)."""
    added = T.StructType()
    for c in BASE:
        added = added.add(c, "long")
    added = added.add("features", T.ArrayType(T.DoubleType()))

    def make():
        def f(batch):
            found = [statistics(t) for t in texts_of(batch, text_col)]
            return {c: [b[i] for b, _ in found] for i, c in enumerate(BASE)} | {"features": [x for _, x in found]}

        return f

    return arrow_map(df, added, make, text_col, () if keep_text else (text_col,))


class Forest:
    """Isolation trees kept as arrays: split feature (-1 at a leaf), cut, left child, path length at a leaf."""

    def __init__(self, x, everything, trees: int = TREES, sub: int = SUBSAMPLE, seed: int = 7):
        """x: the good rows that trees are grown from; everything: rows that show each feature's reach."""
        import numpy as np

        self.pad = 0.25 * (np.percentile(everything, 99.5, axis=0) - np.percentile(everything, 0.5, axis=0))

        rng = np.random.default_rng(seed)
        self.sub = min(sub, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.sub, replace=False)], rng) for _ in range(trees)]
        self.cut = float("inf")

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path length of an unsuccessful search among n keys."""
        import math

        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x, rng):
        import numpy as np

        # a child of -2 - d is an empty leaf at depth d
        nodes: list[list[float]] = []
        todo, limit = [(x, 0, -1, 0)], int(np.ceil(np.log2(max(self.sub, 2)))) + 2
        while todo:
            part, depth, parent, slot = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][slot] = at
            lo, hi = part.min(0), part.max(0)
            wide = np.flatnonzero(hi - lo + self.pad > 0)
            if len(part) < 2 or depth >= limit or not len(wide):
                nodes.append([-1, 0.0, depth + self.mean_path(len(part)), 0])
                continue
            k = int(rng.choice(wide))
            # the range is widened by a part of the feature's reach, so that values outside the sample meet splits too
            cut = rng.uniform(lo[k] - self.pad[k], hi[k] + self.pad[k])
            nodes.append([k, cut, -3 - depth, -3 - depth])
            left = part[:, k] < cut
            todo += [(p, depth + 1, at, i) for i, p in ((3, part[~left]), (2, part[left])) if len(p)]
        return np.array(nodes, float)

    def score(self, x):
        """Anomaly scores between 0 and 1; higher is stranger."""
        import numpy as np

        x = np.asarray(x, float)
        total = np.zeros(len(x))
        for t in self.trees:
            at, depth = np.zeros(len(x), int), np.full(len(x), -1.0)
            live = np.arange(len(x))
            while len(live):
                node = t[at[live]]
                leaf = node[:, 0] < 0
                depth[live[leaf]] = node[leaf, 2]
                live, node = live[~leaf], node[~leaf]
                left = x[live, node[:, 0].astype(int)] < node[:, 1]
                to = np.where(left, node[:, 2], node[:, 3]).astype(int)
                out = to < 0
                depth[live[out]] = -2 - to[out]
                live, to = live[~out], to[~out]
                at[live] = to
            total += depth
        return 2.0 ** (-total / len(self.trees) / max(self.mean_path(self.sub), 1e-9))


def fit_forest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_loss: float = MAX_LOSS) -> Forest | None:
    """A calibrated forest, or None without labelled rows of both kinds."""
    import numpy as np

    # a document labelled both ways counts as bad, and one text stands for an id: the rows are bounded
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("integer")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    found = with_statistics(rows.select("_id", "_label", F.xxhash64("_text").alias("_h"), "_text"), "_text", False).where("n_words >= 50")
    got = found.groupBy("_id").agg(F.max("_label").alias("_label"), F.min_by("features", "_h").alias("features"), F.xxhash64("_id", F.lit(1)).alias("_part")).toPandas()
    good = got["_label"].to_numpy() == 1
    if good.sum() < 4 or (~good).sum() < 1:
        return None
    x, part = np.array(got["features"].tolist()), got["_part"].to_numpy()
    order = np.lexsort((part, *x.T))
    x, good, part = x[order], good[order], part[order]
    # trees are grown from one half of the good rows, the threshold is set by the other half and the bad rows
    grown = good & (np.argsort(np.argsort(np.where(good, part, np.iinfo(np.int64).max), kind="stable"), kind="stable") < good.sum() // 2)
    forest = Forest(x[grown], x)
    x, good = x[~grown], good[~grown]
    s = forest.score(x)
    cuts = np.unique(s[s >= np.quantile(s[good], 1 - max_loss)])
    gain = [(s[~good] > c).mean() - (s[good] > c).mean() for c in cuts]
    best = int(np.argmax(gain))
    # halfway to the next score, so that rows like the last kept one stay
    forest.cut = float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)
    return forest


def judge(df: DataFrame, forest: Forest | None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """df with the base statistics, base_failed, anomaly and kept."""
    added = T.StructType()
    for c in BASE:
        added = added.add(c, "long")
    added = added.add("anomaly", "double")

    def make():
        def f(batch):
            found = [statistics(t) for t in texts_of(batch, text_col)]
            scores = forest.score([x for _, x in found]) if forest and found else [0.0] * len(found)
            return {c: [b[i] for b, _ in found] for i, c in enumerate(BASE)} | {"anomaly": [float(s) for s in scores]}

        return f

    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    drop = ("base_failed", "kept") if keep_text else ("base_failed", "kept", text_col)
    cut = forest.cut if forest else float("inf")
    return arrow_map(df, added, make, text_col, drop).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(cut)))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = fit_forest(docs, table(spark, sf_dir, "labels"))
    return judge(docs, forest, keep_text=False).select("doc_id", *BASE, "base_failed", "kept", "anomaly")
