"""What is known of the discrete Gaussian, and how a sample compares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _reach(sigma2: float) -> int:
    return max(10, math.ceil(12 * math.sqrt(sigma2)))


def normalizing_constant(spark: SparkSession, sigma2: float) -> DataFrame:
    """Sum of exp(-x^2 / 2 sigma2) over the integers: directly, or from sigma2 = 1 on as its quickly convergent dual."""
    if sigma2 < 1:
        return spark.range(-_reach(sigma2), _reach(sigma2) + 1).agg(F.sum(F.exp(-F.pow("id", F.lit(2)) / (2 * sigma2))).alias("norm_const"))
    dual = F.exp(F.lit(-2 * math.pi**2 * sigma2) * F.pow("id", F.lit(2)))
    return spark.range(-10, 11).agg((F.sum(dual) * math.sqrt(2 * math.pi * sigma2)).alias("norm_const"))


def variance(spark: SparkSession, sigma2: float) -> DataFrame:
    """The variance of the discrete Gaussian; for larger sigma2 from the derivative of the dual series."""
    square = F.pow("id", F.lit(2))
    if sigma2 < 1:
        weight = F.exp(-square / (2 * sigma2))
        return spark.range(-_reach(sigma2), _reach(sigma2) + 1).agg((F.sum(square * weight) / F.sum(weight)).alias("variance"))
    dual = F.exp(F.lit(-2 * math.pi**2 * sigma2) * square)
    return spark.range(-10, 11).agg((F.lit(sigma2) * (1 - F.lit(4 * math.pi**2 * sigma2) * F.sum(square * dual) / F.sum(dual))).alias("variance"))


def value_counts(samples: DataFrame, value: str = "noise") -> DataFrame:
    return samples.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))


def sample_statistics(counts: DataFrame, sigma2: float, norm_const: float) -> DataFrame:
    """n, mean, second raw moment and Kullback-Leibler divergence to the discrete Gaussian, from (value, n)."""
    total = counts.agg(F.sum("n").alias("t"))
    p: Column = F.col("n") / F.col("t")
    return counts.crossJoin(F.broadcast(total)).agg(
        F.sum("n").alias("n_samples"),
        F.sum(F.col("value") * p).alias("mean"),
        F.sum(F.pow("value", F.lit(2)) * p).alias("second_moment"),
        F.sum(p * (F.log(p * norm_const) + F.pow("value", F.lit(2)) / (2 * sigma2))).alias("kl"),
    )
