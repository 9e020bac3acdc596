"""Small relational operators, counts, histograms, sampling and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import half_away
from .ranks import in_first, key_hash

# --- projections and filters


def project_except(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def not_null_in_list(df: DataFrame, cols: list[str], in_col: str, values: list) -> DataFrame:
    """Rows whose cols are all set and whose in_col is one of values."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df.where(F.col(in_col).isin(*values))


def hash_chunk(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Chunk i of n: every row is in exactly one chunk, rows of a key in the same."""
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == i)


def limit_testing(df: DataFrame, order: list[str], n: int, mode: str = "TESTING") -> DataFrame:
    """The first n rows in order, in testing mode only."""
    return df.orderBy(*order).limit(n) if mode == "TESTING" else df


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def ordered_export(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def union_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def split_by_sample_list(df: DataFrame, datasets: dict[str, str]) -> DataFrame:
    """df with dataset, by the sample; the map has a few dozen entries and becomes an expression."""
    pairs = [F.lit(x) for kv in datasets.items() for x in kv]
    return df.withColumn("dataset", F.try_element_at(F.create_map(*pairs), F.col("sample")))


# --- counts


def qa_counts(df: DataFrame, total: str, unique: list[str], label: str) -> DataFrame:
    """One row: rows, a sum, distinct keys, and rows by state of a label."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sum(total).alias("total"),
        F.count_distinct(*unique).alias("n_unique"),
        F.count_if(F.col(label) == 1).alias("n_label_1"),
        F.count_if(F.col(label) == 0).alias("n_label_0"),
        F.count_if(F.col(label).isNull()).alias("n_label_null"),
    )


def label_counts_pct(df: DataFrame, label: str) -> DataFrame:
    """value, n, pct (2 digits) for 0 and 1, also where one is absent."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    rows = n.select(F.explode(F.array(F.struct(F.lit(0).alias("value"), F.col("n0").alias("n")), F.struct(F.lit(1).alias("value"), F.col("n1").alias("n")))).alias("r"), (F.col("n0") + F.col("n1")).alias("t"))
    return rows.select("r.value", "r.n", F.coalesce(half_away(F.try_divide(F.col("r.n") * 100.0, "t"), 2), F.lit(0.0)).alias("pct"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (2 n_c), 2 digits, and n_0 / n_1; null for an absent class."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    total = F.col("n0") + F.col("n1")
    return n.select(half_away(F.try_divide(total, F.col("n0") * 2.0), 2).alias("w0"), half_away(F.try_divide(total, F.col("n1") * 2.0), 2).alias("w1"), F.try_divide("n0", "n1").alias("scale_pos_weight"))


def crosstab_margins(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of row by col with totals; 'Total' names a margin."""
    cube = df.where(F.col(row).isNotNull() & F.col(col).isin(*values)).cube(row, col).count()
    named = cube.select(F.coalesce(F.col(row).cast("string"), F.lit("Total")).alias(row), F.coalesce(F.col(col), F.lit("Total")).alias("_c"), "count")
    return named.groupBy(row).pivot("_c", [*values, "Total"]).agg(F.sum("count")).na.fill(0)


def label_correlation_rank(df: DataFrame, label: str, cols: list[str], k: int) -> DataFrame:
    """The k columns of largest absolute correlation with the label, by one aggregation."""
    one = df.agg(*[F.corr(label, c).alias(c) for c in cols])
    stacked = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.abs(F.col(c)).alias("abs_corr")) for c in cols])).alias("r"))
    return stacked.select("r.*").where("abs_corr IS NOT NULL").orderBy(F.col("abs_corr").desc(), "name").limit(k)


def hist_fixed_bins(df: DataFrame, arr: str, n: int, lo: float, hi: float) -> DataFrame:
    """n bins of equal width from lo to hi, the last closed: bin, lo, hi, centre, n, prob; empty bins too."""
    x = df.select(F.explode(arr).alias("x")).where(F.col("x").between(lo, hi))
    width = (hi - lo) / n
    binned = x.select(F.least(F.floor((F.col("x") - lo) / F.lit(width)), F.lit(n - 1)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("_n"))
    bins = df.sparkSession.range(n).select(F.col("id").alias("bin"))
    rows = bins.join(binned, "bin", "left").withColumn("n", F.coalesce("_n", F.lit(0)))
    total = rows.agg(F.sum("n").alias("_t"))
    edge = lambda k: F.lit(float(lo)) + (F.col("bin") + k) * F.lit(width)
    # one row joins one row a bin
    return rows.join(F.broadcast(total)).select("bin", edge(0).alias("lo"), edge(1).alias("hi"), edge(0.5).alias("centre"), "n", F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("prob"))


def hist_moments(hist: DataFrame) -> DataFrame:
    """mean, var, sd of a histogram from its centres and probabilities."""
    m = hist.agg(F.sum(F.col("centre") * F.col("prob")).alias("mean"), F.sum(F.col("centre") * F.col("centre") * F.col("prob")).alias("m2"))
    return m.select("mean", (F.col("m2") - F.col("mean") * F.col("mean")).alias("var"), F.sqrt(F.greatest(F.col("m2") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("sd"))


def hist_2d(df: DataFrame, x: str, y: str, n: int, x_range: tuple, y_range: tuple, by: str) -> DataFrame:
    """Counts on an n by n grid for each value of by; values outside the ranges are left out."""

    def bin_of(c, r):
        return F.least(F.floor((F.col(c) - r[0]) / F.lit((r[1] - r[0]) / n)), F.lit(n - 1)).cast("long")

    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return df.where(inside).select(by, bin_of(x, x_range).alias("bx"), bin_of(y, y_range).alias("by_bin")).groupBy(by, "bx", "by_bin").agg(F.count("*").alias("n"))


def state_mean_by_label(df: DataFrame, states: str, label: str) -> DataFrame:
    """Mean state of each sequence; mean and population deviation of these by label."""
    mean = F.try_divide(F.aggregate(F.col(states), F.lit(0.0), lambda s, x: s + x), F.size(states))
    return df.withColumn("_m", mean).groupBy(label).agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("sd"))


# --- sampling, by key hashes: the same rows whatever the partitioning


def sample_n_per_group(df: DataFrame, by: str, n: int, key: str, seed: int = 0) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(key_hash(key, seed), key))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def balanced_downsample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each class as the smallest has: the first by hash."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n").alias("n_first"))
    return in_first(df, label, key, counts.select(label).join(F.broadcast(least)), seed).where("_first").drop("_first")


def random_oversample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Rows of smaller classes repeated up to the largest: all the same number of times, the first by hash once more."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("_top"))
    sizes = counts.join(F.broadcast(top)).select(label, F.expr("_top % _n").alias("n_first"), F.expr("_top div _n").alias("_times"))
    rows = in_first(df, label, key, sizes.where("n_first > 0"), seed)
    rows = rows.join(F.broadcast(sizes.select(F.col(label).alias("_l"), "_times")), F.col(label).eqNullSafe(F.col("_l")))
    return rows.withColumn("copy", F.explode(F.expr("sequence(1L, _times + IF(_first, 1L, 0L))"))).drop("_first", "_l", "_times")


def chosen_blocks(n: int, max_block: int, seed: int) -> list[int]:
    """n block numbers, with repeats, from a linear congruential sequence."""
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(x % (max_block + 1))
    return out


def sample_blocks(df: DataFrame, n: int, max_block: int, seed: int = 1) -> DataFrame:
    return df.where(F.col("clustering_index").isin(*sorted(set(chosen_blocks(n, max_block, seed)))))


# --- evaluation


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    is_ = lambda a, b: F.count_if((F.col(label) == a) & (F.col(pred) == b))
    return df.agg(is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(1, 1).alias("tp"))


def classification_report(cm: DataFrame, *by: str) -> DataFrame:
    """For each row of cm (tn, fp, fn, tp; columns ``by`` are kept): class, precision, recall, f1, support (3 digits): classes 0 and 1, accuracy, macro and weighted means, and the sum of f1."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = F.col
    cm = cm.select(
        *by,
        *[c(x).cast("double").alias(x) for x in ("tn", "fp", "fn", "tp")],
    )
    cm = cm.withColumns({"p0": ratio(c("tn"), c("tn") + c("fn")), "r0": ratio(c("tn"), c("tn") + c("fp")), "p1": ratio(c("tp"), c("tp") + c("fp")), "r1": ratio(c("tp"), c("tp") + c("fn")), "s0": c("tn") + c("fp"), "s1": c("tp") + c("fn")})
    cm = cm.withColumns({"f0": ratio(c("p0") * c("r0") * 2, c("p0") + c("r0")), "f1": ratio(c("p1") * c("r1") * 2, c("p1") + c("r1")), "s": c("s0") + c("s1")})
    mean = lambda a, b: (a + b) / 2
    weighted = lambda a, b: ratio(a * c("s0") + b * c("s1"), c("s"))
    accuracy = ratio(c("tn") + c("tp"), c("s"))
    rows = [
        ("0", c("p0"), c("r0"), c("f0"), c("s0")),
        ("1", c("p1"), c("r1"), c("f1"), c("s1")),
        ("accuracy", accuracy, accuracy, accuracy, c("s")),
        ("macro avg", mean(c("p0"), c("p1")), mean(c("r0"), c("r1")), mean(c("f0"), c("f1")), c("s")),
        ("weighted avg", weighted(c("p0"), c("p1")), weighted(c("r0"), c("r1")), weighted(c("f0"), c("f1")), c("s")),
        ("sum f1", F.lit(None).cast("double"), F.lit(None).cast("double"), c("f0") + c("f1"), c("s")),
    ]
    structs = [F.struct(F.lit(n).alias("class"), half_away(p, 3).alias("precision"), half_away(r, 3).alias("recall"), half_away(f, 3).alias("f1"), s.cast("long").alias("support")) for n, p, r, f, s in rows]
    return cm.select(*by, F.explode(F.array(*structs)).alias("r")).select(*by, "r.*")


def locus_comparison_metrics(loci: DataFrame) -> DataFrame:
    """Six counts from locus, evaluated (0/1), label (null if not), predicted (null if none)."""
    has, pred = F.col("label").isNotNull(), F.col("predicted").isNotNull()
    return loci.agg(
        F.count("*").alias("n_loci"),
        F.count_if(has).alias("n_evaluated"),
        F.count_if(F.col("label") == 1).alias("n_evaluated_positive"),
        F.count_if(pred).alias("n_modelled"),
        F.count_if(pred & ~has).alias("n_model_only"),
        F.count_if(pred & ~has & (F.col("predicted") == 1)).alias("n_model_only_positive"),
    )


def baseline_eval(df: DataFrame, labels: list[str], pred: str) -> DataFrame:
    """The report of a prediction for each of several labels, with the label's name, in one pass; rows without a label don't count."""
    is_ = lambda c, a, b: F.count_if((F.col(c) == a) & (F.col(pred) == b))
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = df.agg(*[is_(c, a, b).alias(f"{c}_{x}") for c in labels for x, (a, b) in cells.items()])
    rows = [F.struct(F.lit(c).alias("label"), *[F.col(f"{c}_{x}").alias(x) for x in cells]) for c in labels]
    return classification_report(counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*"), "label")
