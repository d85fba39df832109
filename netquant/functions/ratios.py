"""Ratio columns with explicit rules for infinite and missing values.

Missing is NaN. Spark's own ``avg`` and ``stddev_samp`` never see an infinity here: every
aggregate is a conditional count or a moment over the finite values, so all of them combine
map-side and one hot key costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")
# Largest finite double; old tables use it, with either sign, as the text form of an infinity.
OLD_INFINITY = 1.7976931348623157e308


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan() -> Column:
    return F.lit(NAN)


def is_inf(c: Column | str) -> Column:
    return F.abs(_col(c)) == F.lit(INF)


def is_finite(c: Column | str) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & ~is_inf(c)


def safe_log2_ratio(num: Column | str, den: Column | str) -> Column:
    """log2(num/den): only the numerator seen is +Inf, only the denominator is -Inf, neither is NaN."""
    num, den = _col(num), _col(den)
    return (
        F.when((num > 0) & (den > 0), F.log2(F.try_divide(num, den)))
        .when(num > 0, F.lit(INF))
        .when(den > 0, F.lit(-INF))
        .otherwise(nan())
    )


def log2_of_ratio(ratio: Column | str) -> Column:
    """log2 of a linear ratio: 0 is -Inf, +Inf stays, negative or missing is NaN."""
    ratio = _col(ratio)
    return (
        F.when(ratio.isNull() | F.isnan(ratio), nan())
        .when(ratio == F.lit(INF), F.lit(INF))
        .when(ratio > 0, F.log2(ratio))
        .when(ratio == 0, F.lit(-INF))
        .otherwise(nan())
    )


def ratio_of_log2(log2_ratio: Column | str) -> Column:
    """2**x with the infinities carried to +Inf and 0."""
    x = _col(log2_ratio)
    return (
        F.when(x.isNull() | F.isnan(x), nan())
        .when(x == F.lit(INF), F.lit(INF))
        .when(x == F.lit(-INF), F.lit(0.0))
        .otherwise(F.pow(F.lit(2.0), x))
    )


# Columns of a partial result that adds up over disjoint sets of values.
STAT_COLUMNS = ("n_values", "n_pos", "n_neg", "n_missing", "n_finite", "n_old_pos", "n_old_neg", "sum_finite")


def ratio_stats(c: Column | str) -> list[Column]:
    """Aggregates named by ``STAT_COLUMNS``: enough to take :func:`inf_mean` of any union of groups."""
    c = _col(c)
    finite = is_finite(c)
    return [
        F.count(c).alias("n_values"),
        F.count_if(c == F.lit(INF)).alias("n_pos"),
        F.count_if(c == F.lit(-INF)).alias("n_neg"),
        F.count_if(F.isnan(c)).alias("n_missing"),
        F.count_if(finite).alias("n_finite"),
        F.count_if(c == F.lit(OLD_INFINITY)).alias("n_old_pos"),
        F.count_if(c == F.lit(-OLD_INFINITY)).alias("n_old_neg"),
        F.coalesce(F.sum(F.when(finite, c)), F.lit(0.0)).alias("sum_finite"),
    ]


class RatioCounts:
    """The aggregates every rule below is built from; equal ones are computed once by Catalyst."""

    def __init__(self, c: Column | str) -> None:
        c = _col(c)
        finite = is_finite(c)
        self.n = F.count(c)
        self.pos = F.count_if(c == F.lit(INF))
        self.neg = F.count_if(c == F.lit(-INF))
        self.missing = F.count_if(F.isnan(c))
        self.finite = F.count_if(finite)
        self.old_pos = F.count_if(c == F.lit(OLD_INFINITY))
        self.old_neg = F.count_if(c == F.lit(-OLD_INFINITY))
        self.mean = F.coalesce(F.avg(F.when(finite, c)), nan())
        self.sd = F.coalesce(F.stddev_samp(F.when(finite, c)), nan())

    NAMES = ("n", "pos", "neg", "missing", "finite", "old_pos", "old_neg", "mean", "sd")

    def columns(self, prefix: str) -> list[Column]:
        """The aggregates as columns of one ``agg``, to be read back by :meth:`read`."""
        return [getattr(self, name).alias(f"{prefix}{name}") for name in self.NAMES]

    @classmethod
    def read(cls, prefix: str) -> RatioCounts:
        """Counts from the columns that :meth:`columns` made."""
        k = cls.__new__(cls)
        for name in cls.NAMES:
            setattr(k, name, F.col(f"{prefix}{name}"))
        return k

    @classmethod
    def merged(cls, prefix: str = "") -> RatioCounts:
        """The same counts from rows that already hold ``STAT_COLUMNS`` (no spread)."""
        total = {name: F.coalesce(F.sum(F.col(prefix + name)), F.lit(0)) for name in STAT_COLUMNS}
        k = cls.__new__(cls)
        k.n, k.pos, k.neg, k.missing, k.finite, k.old_pos, k.old_neg, summed = (total[name] for name in STAT_COLUMNS)
        k.mean = F.coalesce(F.try_divide(summed, k.finite), nan())
        k.sd = nan()
        return k

    def uniform(self, empty: Column) -> list[tuple[Column, Column]]:
        """Branches for a set without values or with one kind of value only."""
        return [
            (self.n == 0, empty),
            (self.pos == self.n, F.lit(INF)),
            (self.neg == self.n, F.lit(-INF)),
            (self.old_pos == self.n, F.lit(OLD_INFINITY)),
            (self.old_neg == self.n, F.lit(-OLD_INFINITY)),
            (self.missing == self.n, nan()),
        ]


def _counts(c: Column | str | RatioCounts) -> RatioCounts:
    return c if isinstance(c, RatioCounts) else RatioCounts(c)


def _cases(branches: list[tuple[Column, Column]], default: Column) -> Column:
    tree = F.when(*branches[0])
    for condition, value in branches[1:]:
        tree = tree.when(condition, value)
    return tree.otherwise(default)


def inf_mean(c: Column | str | RatioCounts, majority: bool = True) -> Column:
    """Mean where infinities take part by majority vote; null for an empty group."""
    k = _counts(c)
    branches = k.uniform(F.lit(None).cast("double"))
    if not majority:
        return _cases(branches, k.mean)
    inf, p, g, f, m = k.pos + k.neg, k.pos, k.neg, k.finite, k.mean
    return _cases(
        branches
        + [
            (inf <= f, m),
            (g == 0, F.lit(INF)),
            (p == 0, F.lit(-INF)),
            ((p > g) & (p > f), F.lit(INF)),
            ((p > g) & ((p < f) | (m > 0)), m),
            (p > g, nan()),
            ((g > p) & (g > f), F.lit(-INF)),
            ((g > p) & ((g < f) | (m < 0)), m),
            (g > p, nan()),
            (f > g, m),
            ((f == g) & (m > 4), F.lit(INF)),
            ((f == g) & (m < -4), F.lit(-INF)),
        ],
        nan(),
    )


def inf_count(c: Column | str | RatioCounts, majority: bool = True) -> Column:
    """Number of values that :func:`inf_mean` rests on; 0 for an empty group."""
    k = _counts(c)
    branches = [(condition, k.n) for condition, _ in k.uniform(nan())]
    if not majority:
        return _cases(branches, k.finite)
    inf, p, g, f, m = k.pos + k.neg, k.pos, k.neg, k.finite, k.mean
    return _cases(
        branches
        + [
            (inf <= f, f),
            ((g == 0) | (p == 0), inf),
            ((p > g) & (p > f), p),
            ((p > g) & ((p < f) | (m > 0)), f),
            (p > g, p + f),
            ((g > p) & (g > f), g),
            ((g > p) & ((g < f) | (m < 0)), f),
            (g > p, g + f),
            (f > g, f),
            ((f == g) & (m > 4), p + f),
            ((f == g) & (m < -4), g + f),
        ],
        inf,
    )


def inf_stddev(c: Column | str | RatioCounts, majority: bool = True) -> Column:
    """Spread matching :func:`inf_mean`; a -Inf majority over mixed signs has none, +Inf has itself."""
    k = _counts(c)
    branches = k.uniform(nan())
    if not majority:
        return _cases(branches, k.sd)
    inf, p, g, f, m = k.pos + k.neg, k.pos, k.neg, k.finite, k.mean
    return _cases(
        branches
        + [
            (inf <= f, k.sd),
            (g == 0, F.lit(INF)),
            (p == 0, F.lit(-INF)),
            ((p > g) & (p > f), F.lit(INF)),
            ((p > g) & ((p < f) | (m > 0)), k.sd),
            (p > g, nan()),
            ((g > p) & (g > f), nan()),
            ((g > p) & ((g < f) | (m < 0)), k.sd),
            (g > p, nan()),
            (f > g, k.sd),
        ],
        nan(),
    )


def finite_mean(c: Column | str) -> Column:
    """Mean of the finite values, NaN when there is none."""
    c = _col(c)
    return F.coalesce(F.avg(F.when(is_finite(c), c)), nan())


def finite_stddev(c: Column | str) -> Column:
    """Sample standard deviation of the finite values, NaN below two."""
    c = _col(c)
    return F.coalesce(F.stddev_samp(F.when(is_finite(c), c)), nan())


# Array predicates over short value lists -------------------------------------------------


def has_finite_and_inf(values: Column | str) -> Column:
    values = _col(values)
    return F.exists(values, is_inf) & F.exists(values, is_finite)


def only_inf(values: Column | str) -> Column:
    return F.filter(_col(values), is_inf)


def only_finite(values: Column | str) -> Column:
    return F.filter(_col(values), is_finite)


def same_infinity(values: Column | str) -> Column:
    """The infinity all the given infinities share, else null."""
    kinds = F.array_distinct(only_inf(values))
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1))


def all_inf(values: Column | str) -> Column:
    values = _col(values)
    return (F.size(values) > 0) & F.forall(values, is_inf)


def swap_ratio(log2_ratio: Column | str) -> Column:
    """Exchange the two conditions: the sign of the log ratio changes."""
    return -_col(log2_ratio)


def replace_inf(c: Column | str, limit: float | None) -> Column:
    """Write +-limit for the infinities; NaN stays; no limit leaves all as is."""
    c = _col(c)
    if limit is None:
        return c
    return F.when(c == F.lit(INF), F.lit(float(limit))).when(c == F.lit(-INF), F.lit(-float(limit))).otherwise(c)
