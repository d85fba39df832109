"""Isobaric channels: ratios of all channel pairs, centring and Gaussian tail probabilities."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.distributions import normal_cdf
from netquant.functions.ratios import finite_mean, is_finite, is_inf, nan, safe_log2_ratio
from netquant.operators.correction import p_adjust

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR = ("channel_i", "channel_j")


def channel_pairs(
    amounts: DataFrame, channels: Sequence[str], key: str = "psm_id", ignore_not_found: bool = False
) -> DataFrame:
    """Every PSM in every channel pair i < j: log2 ratio and the PSM's greatest intensity as weight.

    NaN where a channel is missing; with ``ignore_not_found`` also where one of the two is 0. A PSM
    holds one value per channel, so its pairs are made within its row after one aggregate.
    """
    channels = list(channels)
    columns = [F.max(F.when(F.col("channel") == c, F.col("intensity"))).alias(f"_c{i}") for i, c in enumerate(channels)]
    wide = amounts.groupBy(key).agg(F.max("intensity").alias("weight"), *columns)
    rows = []
    for i, first in enumerate(channels):
        for j in range(i + 1, len(channels)):
            a, b = F.col(f"_c{i}"), F.col(f"_c{j}")
            lacking = a.isNull() | b.isNull()
            if ignore_not_found:
                lacking = lacking | (a == 0) | (b == 0)
            ratio = F.when(lacking, nan()).otherwise(safe_log2_ratio(a, b))
            rows.append(
                F.struct(F.lit(first).alias("channel_i"), F.lit(channels[j]).alias("channel_j"), ratio.alias("log2_ratio"))
            )
    return wide.select(key, "weight", F.inline(F.array(*rows)))


def centre(ratios: DataFrame, by: Sequence[str] = PAIR, c: str = "log2_ratio") -> DataFrame:
    """Subtract the mean of each group's finite values; infinities and NaN stay.

    The means are a map-side combined aggregate, not a window over a whole pair.
    """
    means = ratios.groupBy(*by).agg(finite_mean(c).alias("_mean"))
    shifted = F.when(is_finite(c) & ~F.isnan("_mean"), F.col(c) - F.col("_mean")).otherwise(F.col(c))
    return ratios.join(means, list(by)).withColumn(c, shifted).drop("_mean")


def histogram(ratios: DataFrame, by: Sequence[str] = PAIR, bins: int | None = None, c: str = "log2_ratio") -> DataFrame:
    """``(by, bin, mid, count, width)`` of the finite values over equal bins between least and greatest.

    Without ``bins`` the number follows Sturges' rule, so it grows with the logarithm of the values.
    """
    finite = ratios.filter(is_finite(c)).select(*by, F.col(c).alias("_x"))
    spans = finite.groupBy(*by).agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.count("*").alias("_n"))
    n_bins = F.lit(bins) if bins else F.ceil(F.log2(F.col("_n").cast("double")) + 1).cast("int")
    spans = spans.withColumn("_bins", n_bins).withColumn("width", (F.col("_max") - F.col("_min")) / F.col("_bins"))
    place = F.floor(F.try_divide(F.col("_x") - F.col("_min"), F.col("width")))
    binned = (
        finite.join(spans, list(by))
        .withColumn("bin", F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.col("_bins") - 1).cast("int"))
        .groupBy(*by, "bin", "_min", "width", "_bins")
        .agg(F.count("*").alias("count"))
    )
    return binned.select(
        *by, "bin", (F.col("_min") + (F.col("bin") + 0.5) * F.col("width")).alias("mid"), "count", "width",
        F.col("_bins").alias("n_bins"), F.col("_min").alias("least"),
    )


def fit_curve(mid: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """Least-squares Gaussian ``height, mean, sigma`` over bin mid-points (damped Gauss-Newton)."""
    total = count.sum()
    mean = float((mid * count).sum() / total)
    sigma = float(np.sqrt(max((count * (mid - mean) ** 2).sum() / total, 1e-12)))
    params = np.array([float(count.max()), mean, sigma])
    damping = 1e-3

    def residuals(p: np.ndarray) -> np.ndarray:
        return p[0] * np.exp(-0.5 * ((mid - p[1]) / p[2]) ** 2) - count

    current = residuals(params)
    for _ in range(rounds):
        z = (mid - params[1]) / params[2]
        shape = np.exp(-0.5 * z * z)
        slopes = np.stack([shape, params[0] * shape * z / params[2], params[0] * shape * z * z / params[2]], axis=1)
        square = slopes.T @ slopes
        step = np.linalg.lstsq(square + damping * np.diag(np.diag(square) + 1e-12), slopes.T @ current, rcond=None)[0]
        trial = params - step
        trial[2] = max(abs(trial[2]), 1e-9)
        after = residuals(trial)
        if (after**2).sum() < (current**2).sum():
            moved = np.abs(step).max() < 1e-12 * (1 + np.abs(params).max())
            params, current, damping = trial, after, max(damping / 10, 1e-12)
            if moved:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return float(params[0]), float(params[1]), float(params[2])


def fit_gaussians(bins: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """``(by, mu, sigma)``: only the bins of a group, a few dozen rows, reach a Python worker.

    Empty bins between the filled ones are put back with count 0 before the fit.
    """
    by = list(by)
    types = {f.name: f.dataType.simpleString() for f in bins.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "mu double", "sigma double"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        n, width, least = int(first["n_bins"]), float(first["width"]), float(first["least"])
        counts = np.zeros(n)
        counts[group["bin"].to_numpy()] = group["count"].to_numpy()
        mid = least + (np.arange(n) + 0.5) * width
        filled = int((counts > 0).sum())
        _, mu, sigma = fit_curve(mid, counts) if filled >= 3 else (0.0, float("nan"), float("nan"))
        return pd.DataFrame([[*[first[c] for c in by], mu, sigma]], columns=[*by, "mu", "sigma"])

    return bins.groupBy(*by).applyInPandas(fit, schema)


def tail_p(ratio: Column, mu: Column, sigma: Column) -> Column:
    """One-sided tail: below mu the lower one, above it the upper one."""
    z = F.try_divide(ratio - mu, sigma)
    return F.when(ratio > mu, F.lit(1.0) - normal_cdf(z)).otherwise(normal_cdf(z))


def gaussian_pvalues(
    ratios: DataFrame, by: Sequence[str] = PAIR, method: str = "BY", bins: int | None = None, fits: DataFrame | None = None
) -> DataFrame:
    """Centred ratios with p under their pair's Gaussian and q; an infinity has q = 0, NaN none."""
    by = list(by)
    centred = centre(ratios, by)
    fits = fit_gaussians(histogram(centred, by, bins), by) if fits is None else fits
    scored = centred.join(fits, by, "left").withColumn(
        "p", F.when(is_finite("log2_ratio"), tail_p(F.col("log2_ratio"), F.col("mu"), F.col("sigma"))).otherwise(nan())
    )
    adjusted = p_adjust(scored, by, method)
    return adjusted.withColumn("q", F.when(is_inf("log2_ratio"), F.lit(0.0)).otherwise(F.col("q")))


def n_samples_of_pairs(n_pairs: Column | int) -> Column:
    """Number of channels whose pairs are this many."""
    n = F.lit(n_pairs) if isinstance(n_pairs, int) else n_pairs
    return ((F.sqrt(8 * n.cast("double") + 1) + 1) / 2).cast("int")


def pair_index(i: Column, j: Column, n: Column) -> Column:
    """Place of the pair i < j (from 0) when pairs run row by row."""
    return (i * (2 * n - i - 1) / 2).cast("int") + j - i - 1
