"""Match probabilities from four similarities: densities, Bayes and SUN posteriors, fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDICATORS = ("vector", "difflib", "leven", "jaro")
FLOOR = 1e-6
# Cells of the four indicators (vector, difflib, leven, jaro) that mean a match or a mismatch.
SAME_CELLS = ((1, 1, 1, 1), (0, 1, 1, 1))
NOT_CELLS = ((0, 0, 0, 0), (1, 0, 0, 0))
PRIOR = 0.1


def beta_pdf(x: Column, alpha: float, beta: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    constant = math.lgamma(alpha + beta) - math.lgamma(alpha) - math.lgamma(beta) - math.log(scale)
    z = (x - loc) / scale
    inside = (z > 0) & (z < 1)
    return F.greatest(F.lit(FLOOR), F.when(inside, F.exp(constant + (alpha - 1) * F.log(z) + (beta - 1) * F.log(1 - z))).otherwise(0.0))


def gamma_pdf(x: Column, alpha: float, beta: float, loc: float = 0.0) -> Column:
    """With rate beta."""
    constant = alpha * math.log(beta) - math.lgamma(alpha)
    z = x - loc
    return F.greatest(F.lit(FLOOR), F.when(z > 0, F.exp(constant + (alpha - 1) * F.log(z) - beta * z)).otherwise(0.0))


def mixture_pdf(x: Column, parts: list[tuple[float, float, float]]) -> Column:
    """parts: mean, variance, weight; floored like the others, so that posteriors have no 0 / 0."""
    total = F.lit(0.0)
    for mean, var, weight in parts:
        total += F.exp(-(x - mean) * (x - mean) / (2 * var)) * (weight / math.sqrt(2 * math.pi * var))
    return F.greatest(F.lit(FLOOR), total)


def density(x: Column, family: dict) -> Column:
    kind = family["type"]
    if kind == "beta":
        return beta_pdf(x, family["alpha"], family["beta"], family.get("loc", 0.0), family.get("scale", 1.0))
    if kind == "gamma":
        return gamma_pdf(x, family["alpha"], family["beta"], family.get("loc", 0.0))
    if kind == "mixture":
        return mixture_pdf(x, family["parts"])
    raise ValueError(f"no family {kind}")


def product(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out * c
    return out


def bayes(same: list[Column], no: list[Column]) -> tuple[Column, Column]:
    """P(same), and what the densities leave unknown."""
    s, n = product(same), product(no)
    joint = s * PRIOR
    return joint / F.greatest(joint + n * (1 - PRIOR), F.lit(1e-4)), 1 - (s + n) / product([a + b for a, b in zip(same, no, strict=True)])


def sun(same: list[Column], no: list[Column], same_cells=SAME_CELLS, not_cells=NOT_CELLS) -> tuple[Column, Column, Column]:
    """P(same), P(not) and the rest, by the cells of indicators that are alike or not."""
    p = [s / (s + n) for s, n in zip(same, no, strict=True)]
    cell = lambda bits: product([p[i] if b else 1 - p[i] for i, b in enumerate(bits)])
    total = lambda cells: sum((cell(c) for c in cells[1:]), cell(cells[0])) if cells else F.lit(0.0)
    yes, not_ = total(same_cells), total(not_cells)
    return yes, not_, 1 - yes - not_


def majority_cell(same: list[Column], no: list[Column]) -> Column:
    """The cell of probability over a half, as an array of bits; -1s where there is none."""
    p = [s / (s + n) for s, n in zip(same, no, strict=True)]
    best = product([F.greatest(x, 1 - x) for x in p])
    return F.when(best > 0.5, F.array(*(F.when(x > 0.5, 1).otherwise(0) for x in p))).otherwise(F.array(*(F.lit(-1) for _ in p)))


def sun_class(same: Column, no: Column, tau_same: float, tau_not: float) -> Column:
    return F.when(1 - same < tau_same, "SAME").when(1 - no < tau_not, "NOT_SAME").otherwise("UNKNOWN")


def fit(scores: DataFrame, families: dict[str, str]) -> DataFrame:
    """indicator, label, type, alpha, beta, loc, scale, mean, cov, weight from indicator, label, x.

    Moments are sums that Spark aggregates; only mixtures see values, as histograms of 1000 bins.
    """
    moments = scores.groupBy("indicator", "label").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    kind = F.create_map(*(F.lit(y) for k, v in families.items() for y in (k, v)))[F.col("indicator")]
    common = F.greatest(F.col("m") * (1 - F.col("m")) / F.greatest("v", F.lit(1e-9)) - 1, F.lit(1e-3))
    simple = moments.withColumn("type", kind).where("type in ('beta', 'gamma')").select(
        "indicator", "label", "type",
        F.when(F.col("type") == "beta", F.col("m") * common).otherwise(F.col("m") * F.col("m") / F.greatest("v", F.lit(1e-9))).alias("alpha"),
        F.when(F.col("type") == "beta", (1 - F.col("m")) * common).otherwise(F.col("m") / F.greatest("v", F.lit(1e-9))).alias("beta"),
        F.lit(0.0).alias("loc"), F.lit(1.0).alias("scale"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("cov"), F.lit(1.0).alias("weight"),
    )
    mixed = [k for k, v in families.items() if v == "mixture"]
    if not mixed:
        return simple
    bins = scores.where(F.col("indicator").isin(mixed)).groupBy("indicator", "label", F.round("x", 3).alias("x")).agg(F.count("*").alias("n"))

    def em(frame: pd.DataFrame) -> pd.DataFrame:
        x, n = frame["x"].to_numpy(float), frame["n"].to_numpy(float)
        k = min(10, len(x))
        mean, var, weight = np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, max(x.var(), 1e-4)), np.full(k, 1 / k)
        for _ in range(60):
            p = weight * np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
            r = p / p.sum(1, keepdims=True) * n[:, None]
            s = r.sum(0) + 1e-12
            mean, weight = (r * x[:, None]).sum(0) / s, s / s.sum()
            var = np.maximum((r * (x[:, None] - mean) ** 2).sum(0) / s, 1e-6)
        keep = weight > 1e-4
        out = pd.DataFrame({"mean": mean[keep], "cov": var[keep], "weight": weight[keep]})
        return out.assign(indicator=frame["indicator"].iloc[0], label=frame["label"].iloc[0], type="mixture", alpha=None, beta=None, loc=None, scale=None)[["indicator", "label", "type", "alpha", "beta", "loc", "scale", "mean", "cov", "weight"]]

    schema = "indicator string, label string, type string, alpha double, beta double, loc double, scale double, mean double, cov double, weight double"
    return simple.unionByName(bins.groupBy("indicator", "label").applyInPandas(em, schema))


def regenerate(params: DataFrame, per_side: int = 5000, seed: int = 42) -> DataFrame:
    """indicator, label, x: values drawn from stored beta and gamma parameters, to fit again."""
    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        rng, r = np.random.default_rng(seed), frame.iloc[0]
        x = rng.beta(r.alpha, r.beta, per_side) * r.scale + r["loc"] if r.type == "beta" else rng.gamma(r.alpha, 1 / r.beta, per_side) + r["loc"]
        return pd.DataFrame({"indicator": r.indicator, "label": r.label, "x": x})

    return params.where("type in ('beta', 'gamma')").groupBy("indicator", "label").applyInPandas(draw, "indicator string, label string, x double")


def learned_regions(cells: DataFrame, share: float = 0.4) -> DataFrame:
    """cell, region: a cell is SAME if its share of mismatches is under `share`, NOT if its share of matches is."""
    per = cells.groupBy("cell").agg(F.avg(F.col("match").cast("double")).alias("m"))
    return per.select("cell", F.when(1 - F.col("m") < share, "SAME").when(F.col("m") < share, "NOT").otherwise("UNKNOWN").alias("region"))


def cluster_distance(wanted: DataFrame, members: DataFrame, known: DataFrame, most: int = 5, otherwise: float = 10.0) -> DataFrame:
    """ca, cb, dist: the mean of up to `most` known member distances of two clusters, by hash order; else a constant.

    wanted: ca, cb. members: id, label. known: a, b, dist.
    """
    at = lambda x: members.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    own = known.join(at("a"), "a").join(at("b"), "b").select(F.least("la", "lb").alias("ca"), F.greatest("la", "lb").alias("cb"), "dist", F.md5(F.concat_ws(":", F.lit("42"), "a", "b")).alias("h"))
    few = own.withColumn("r", F.row_number().over(Window.partitionBy("ca", "cb").orderBy("h"))).where(F.col("r") <= most)
    return wanted.join(few.groupBy("ca", "cb").agg(F.avg("dist").alias("dist")), ["ca", "cb"], "left").select("ca", "cb", F.coalesce("dist", F.lit(otherwise)).alias("dist"))


def soft_label(match: Column, ratio: Column) -> Column:
    return F.when(match, 1 - ratio).otherwise((1 - ratio) * 9 + 1)


def contrastive_loss(distance: Column, match: Column, margin: float = 1.0) -> Column:
    return F.when(match, distance * distance).otherwise(F.pow(F.greatest(F.lit(0.0), margin - distance), 2))
