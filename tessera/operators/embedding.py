"""Vectors of texts without an outside service, and a small learned projection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.similarity import l2_normalised

DIMENSIONS = 64


@F.pandas_udf(ArrayType(DoubleType()))
def pseudo_embedding(text: pd.Series) -> pd.Series:
    """A unit vector that the sum of a text's code points fixes; a stand-in for an embedding service."""

    def one(t: str | None) -> list[float] | None:
        if t is None:
            return None
        x = np.random.default_rng(sum(map(ord, t))).standard_normal(DIMENSIONS)
        return (x / np.linalg.norm(x)).tolist()

    return text.map(one)


LONGEST = 8000


def cached_vectors(records: DataFrame, text: str, cache: DataFrame, dimensions: int = 256) -> DataFrame:
    """records (id, text) with key (md5 of the first LONGEST characters), vector, and cached: taken from cache (key, value) or computed, once a text."""
    keyed = records.withColumn("key", F.md5(F.substring(text, 1, LONGEST)))
    wanted = keyed.select("key", text).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    made = hashed_vectors(wanted, text, dimensions).select("key", F.col("vector").alias("made"))
    out = keyed.join(cache.select("key", "value"), "key", "left").join(made, "key", "left")
    return out.select("id", "key", F.coalesce("value", "made").alias("vector"), F.col("value").isNotNull().alias("cached"))


def hashed_vectors(records: DataFrame, text: str, dimensions: int = 256) -> DataFrame:
    """records (id, text) with vector: token counts by hash, of length 1."""
    from pyspark.ml.functions import vector_to_array

    tokens = records.withColumn("_t", F.split(F.lower(F.substring(text, 1, LONGEST)), r"\s+"))
    raw = HashingTF(inputCol="_t", outputCol="_v", numFeatures=dimensions).transform(tokens).withColumn("vector", vector_to_array("_v"))
    return raw.withColumn("vector", l2_normalised(F.col("vector"))).drop("_t", "_v")


def fit_projection(pairs: DataFrame, out: int = 16, rounds: int = 30, rate: float = 0.05, sample: int = 20_000, seed: int = 7) -> np.ndarray:
    """A linear map that draws matches together and mismatches apart by a margin of 1 (contrastive loss).

    pairs: u, v (arrays), match. It is fitted on a bounded sample (`sample` pairs by hash) in the driver.
    """
    rows = pairs.orderBy(F.xxhash64("u", "v")).limit(sample).select("u", "v", F.col("match").cast("double").alias("m")).toPandas()
    gap, m = np.stack(rows["u"]) - np.stack(rows["v"]), rows["m"].to_numpy()
    w = np.random.default_rng(seed).standard_normal((gap.shape[1], out)) / np.sqrt(gap.shape[1])
    for _ in range(rounds):
        z = gap @ w
        d = np.sqrt((z * z).sum(1)) + 1e-9
        pull = np.where(m > 0, 2.0, np.where(d < 1, -2 * (1 - d) / d, 0.0))
        w -= rate * gap.T @ (z * pull[:, None]) / len(m)
    return w


def project(vectors: DataFrame, weights: np.ndarray) -> DataFrame:
    """vectors with vector mapped through fitted weights."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_list()) @ weights)) if len(x) else pd.Series([], dtype=object)

    return vectors.withColumn("vector", apply("vector"))
