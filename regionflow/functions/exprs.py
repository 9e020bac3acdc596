"""Column expressions, and the same as SQL text where both engines need one.

Texts use only what Spark SQL and DuckDB read alike, so that one formula serves
the column and its check.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away_sql(x: str, digits: int) -> str:
    """x rounded half away from zero, computed alike in both engines."""
    k = f"1e{digits}"
    return f"(floor(abs({x}) * {k} + 5e-1) / {k} * sign({x}))"


def half_away(x: Column, digits: int) -> Column:
    k = F.lit(10.0**digits)
    return F.floor(F.abs(x) * k + F.lit(0.5)) / k * F.signum(x)


def half_even(x: Column, digits: int) -> Column:
    """x rounded half to even, as array libraries do."""
    k = F.lit(10.0**digits)
    return F.rint(x * k) / k


def safe_ratio(num: Column, den: Column, digits: int = 5) -> Column:
    """num / den, null where den is 0, rounded."""
    return half_away(F.try_divide(num, den), digits)


def allele_effect(ref_meth: Column, ref_cov: Column, alt_meth: Column, alt_cov: Column, digits: int = 5) -> Column:
    """Methylation of the alternative allele minus that of the reference allele; null without coverage."""
    return half_away(F.try_divide(alt_meth, alt_cov) - F.try_divide(ref_meth, ref_cov), digits)


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f names it, also where Spark merges projections."""
    return F.element_at(F.transform(F.array(value), f), 1)


# West's (2005) rational approximation of the normal tail, highest power first.
TAIL_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
TAIL_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def norm_sf(z: Column) -> Column:
    """Upper tail of the standard normal for z >= 0."""

    def tail(z: Column) -> Column:
        horner = lambda cs: functools.reduce(lambda s, c: s * z + c, cs[1:], F.lit(cs[0]))
        near = F.exp(-z * z / 2) * horner(TAIL_TOP) / horner(TAIL_BOTTOM)
        far = F.exp(-z * z / 2) / functools.reduce(lambda s, k: z + F.lit(k) / s, (4.0, 3.0, 2.0, 1.0), z + 0.65) / 2.506628274631
        return F.when(z < 7.07106781186547, near).when(z < 37, far).otherwise(F.lit(0.0))

    return let(z, tail)


#: Largest n whose logarithm of n! is listed. Beyond it, Stirling's series is exact to a double.
MAX_FACTORIAL = 30


def log_factorial(listed: Column, n: Column) -> Column:
    """Logarithm of n! for a whole n >= 0; listed has those up to MAX_FACTORIAL."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (F.lit(1.0) / 12 - (F.lit(1.0) / 360 - F.lit(1.0) / 1260 / (x * x)) / (x * x)) / x
    return F.coalesce(F.try_element_at(listed, n.cast("int") + 1), series)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided exact p of the 2x2 table [[a, b], [c, d]]; 1 if a margin is zero.

    One fold over the tables of the same margins, each one's logarithm from that of the table before it.
    """
    counts = [x.cast("long").alias(name) for name, x in zip("abcd", (a, b, c, d))]
    table = F.struct(*counts, F.array(*[F.lit(math.lgamma(n + 1)) for n in range(MAX_FACTORIAL + 1)]).alias("lf"))

    def margins(t: Column) -> Column:
        r1, r2, c1 = t["a"] + t["b"], t["c"] + t["d"], t["a"] + t["c"]
        least = F.greatest(F.lit(0).cast("long"), c1 - r2)
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), t["c"].alias("c"), t["d"].alias("d"), t["lf"].alias("lf"), r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), least.alias("least"))

    def ends(t: Column) -> Column:
        lf = functools.partial(log_factorial, t["lf"])
        of = lambda *cells: -functools.reduce(lambda s, n: s + lf(n), cells[1:], lf(cells[0]))
        both = lf(t["r1"]) + lf(t["r2"]) + lf(t["c1"]) + lf(t["r1"] + t["r2"] - t["c1"]) - lf(t["r1"] + t["r2"])
        first = of(t["least"], t["r1"] - t["least"], t["c1"] - t["least"], t["r2"] - t["c1"] + t["least"])
        seen = of(t["a"], t["b"], t["c"], t["d"]) + math.log1p(1e-7)
        return F.struct(t["r1"].alias("r1"), t["r2"].alias("r2"), t["c1"].alias("c1"), t["least"].alias("least"), both.alias("both"), first.alias("first"), seen.alias("seen"))

    def p(t: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            here = F.when(s["log"] <= t["seen"], F.exp(t["both"] + s["log"])).otherwise(F.lit(0.0))
            odds = (t["r1"] - x).cast("double") * (t["c1"] - x) / ((x + 1).cast("double") * (t["r2"] - t["c1"] + x + 1))
            return F.struct((s["p"] + here).alias("p"), (s["log"] + F.coalesce(F.log(odds), F.lit(0.0))).alias("log"))

        tables = F.sequence(t["least"], F.least(t["r1"], t["c1"]))
        total = F.aggregate(tables, F.struct(F.lit(0.0).alias("p"), t["first"].alias("log")), step, lambda s: s["p"])
        empty = (t["r1"] == 0) | (t["r2"] == 0) | (t["c1"] == 0) | (t["c1"] == t["r1"] + t["r2"])
        return F.when(empty, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))

    return let(let(let(table, margins), ends), p)


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def array_mean(arr: Column) -> Column:
    return F.try_divide(array_sum(arr), F.size(arr))


def array_std(arr: Column) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    held = F.struct(arr.alias("v"), array_mean(arr).alias("m"))
    squares = F.element_at(F.transform(F.array(held), lambda t: F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + (x - t["m"]) * (x - t["m"]))), 1)
    return F.when(F.size(arr) > 1, F.sqrt(squares / (F.size(arr) - 1)))


def longest_run(arr: Column, good) -> Column:
    """Length of the longest run of elements that are good."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        now = F.when(good(x), s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(arr, start, step, lambda s: s["best"])


def kernel_grid(start: float, stop: float, step: float) -> list[float]:
    n = round((stop - start) / step) + 1
    return [round(start + i * step, 10) for i in range(n)]


def kernel_density(arr: Column, grid: list[float], h: float, digits: int = 4) -> Column:
    """Gaussian kernel density of an array's values at the grid's points; null for an empty array."""
    held = F.struct(arr.alias("v"), F.size(arr).alias("n"))
    scale = F.lit(h * math.sqrt(2 * math.pi))
    at = lambda t, g: half_even(F.aggregate(t["v"], F.lit(0.0), lambda s, x: s + F.exp(-((g - x) / F.lit(h)) * ((g - x) / F.lit(h)) / 2)) / (t["n"] * scale), digits)
    density = F.element_at(F.transform(F.array(held), lambda t: F.transform(F.array(*[F.lit(float(g)) for g in grid]), lambda g: at(t, g))), 1)
    return F.when(F.size(arr) > 0, density)
