"""Multiple-testing correction per group with a distributed rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.lineage import cut
from netquant.operators.ranking import running, sliced, with_totals

EULER_GAMMA = 0.5772156649015329
METHODS = ("BY", "BH", "BONFERRONI", "HOLM", "HOCHBERG", "NONE")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: summed up to 200 terms, by its expansion (error below 1e-15) beyond."""
    x = m.cast("double")
    terms = F.sequence(F.lit(1), F.least(F.greatest(m, F.lit(1)), F.lit(200)).cast("int"))
    summed = F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    expanded = F.log(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(m <= 200, summed).otherwise(expanded)


def p_adjust(
    tests: DataFrame, by: Sequence[str] = (), method: str = "BY", p: str = "p", use: str | None = None, out: str = "q"
) -> DataFrame:
    """Adjusted p within each group; rows not used (flag off, NaN or null p, null key) keep their raw p.

    BY and BH are the step-up rules of Benjamini-Yekutieli and Benjamini-Hochberg, Hochberg the
    step-up and Holm the step-down rule on family-wise error.
    """
    by, method = list(by), method.upper()
    if method not in METHODS:
        raise ValueError(f"unknown correction {method}")
    if method == "NONE":
        return tests.withColumn(out, F.col(p))
    # Levels are joined back on p itself, so both sides must read the very same doubles: a plan
    # computed twice may add in another order. It also runs the tests once. Rows not used stay out
    # of that join, where all of them would meet on one key.
    tests = cut(tests.drop(out), "tests")
    usable = F.col(p).isNotNull() & ~F.isnan(p)
    if use is not None:
        usable = usable & F.coalesce(F.col(use), F.lit(False))
    for c in by:
        usable = usable & F.col(c).isNotNull()
    used, unused = tests.filter(usable), tests.filter(~usable)
    levels = used.groupBy(*by, p).agg(F.count("*").alias("_ties"))
    sizes = levels.groupBy(*by).agg(F.sum("_ties").alias("_m"))
    if method == "BONFERRONI":
        table = with_totals(levels, sizes, by)
        adjusted = table.withColumn("_q", F.least(F.lit(1.0), F.col("_m") * F.col(p)))
    else:
        ranked = running(sliced(levels, by, p), by, p, F.col("_ties"), "sum", "_rank")
        table = with_totals(ranked, sizes, by)
        m, k = F.col("_m"), F.col("_rank")
        if method in ("BY", "BH"):
            scale = harmonic(m) if method == "BY" else F.lit(1.0)
            value, kind = scale * m * F.col(p) / k, "min"
        elif method == "HOCHBERG":
            value, kind = (m - k + 1) * F.col(p), "min"
        else:
            value, kind = (m - (k - F.col("_ties"))) * F.col(p), "max"
        table = cut(table, "ranked")
        adjusted = running(table, by, p, F.least(F.lit(1.0), value), kind, "_q")
    joined = used.join(adjusted.select(*by, p, F.col("_q").alias(out)), [*by, p])
    return joined.unionByName(unused.withColumn(out, F.col(p)))
