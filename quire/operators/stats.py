"""Statistical tests as aggregates; tail probabilities by the normal or chi-square distribution."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.relational import average_ranks


def chi_square(cells: DataFrame, yates: bool = False) -> DataFrame:
    """One row (statistic, df, n, cramers_v) of a table in long form (r, c, n); cells that aren't
    there count 0. ``yates`` takes up to a half from each deviation."""
    rows, cols = cells.groupBy("r").agg(F.sum("n").alias("rn")), cells.groupBy("c").agg(F.sum("n").alias("cn"))
    total = cells.agg(F.sum("n").alias("t"))
    x = rows.crossJoin(cols).crossJoin(total).join(cells, ["r", "c"], "left")  # categories are few
    e = F.col("rn") * F.col("cn") / F.col("t")
    dev = F.abs(F.coalesce("n", F.lit(0)) - e)
    dev = F.greatest(F.lit(0.0), dev - 0.5) if yates else dev
    s = x.agg(F.sum(dev * dev / e).alias("statistic"), F.countDistinct("r").alias("k"), F.countDistinct("c").alias("m"), F.max("t").alias("n"))
    return s.select("statistic", ((F.col("k") - 1) * (F.col("m") - 1)).alias("df"), "n", F.sqrt(F.col("statistic") / (F.col("n") * (F.least("k", "m") - 1))).alias("cramers_v"))


def residuals(cells: DataFrame) -> DataFrame:
    """(r, c, n, expected, residual): (n - expected) / root of expected."""
    t = Window.partitionBy()
    x = cells.select("*", F.sum("n").over(Window.partitionBy("r")).alias("rn"), F.sum("n").over(Window.partitionBy("c")).alias("cn"), F.sum("n").over(t).alias("t"))  # categories are few
    e = F.col("rn") * F.col("cn") / F.col("t")
    return x.select("r", "c", "n", e.alias("expected"), ((F.col("n") - e) / F.sqrt(e)).alias("residual"))


def mann_whitney(df: DataFrame, value: str, first: str) -> DataFrame:
    """One row (n1, n2, u, z): U of the rows where the boolean ``first`` holds, with mean ranks for
    ties, and its normal score with the tie correction."""
    x = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(F.col(value).alias("v"), F.col(first).alias("f"))
    r = average_ranks(x, "v")
    ties = x.groupBy("v").agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    s = r.agg(F.count_if("f").alias("n1"), F.count_if(~F.col("f")).alias("n2"), F.sum(F.when(F.col("f"), F.col("rank"))).alias("r1")).crossJoin(ties)  # one row each
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("n1", "n2", u.alias("u"), F.try_divide(u - n1 * n2 / 2, sd).alias("z"))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, pearson, spearman) of the rows that have both values."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    r = average_ranks(average_ranks(d, "x", name="rx"), "y", name="ry")
    return r.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def wilcoxon(df: DataFrame, x: str, y: str, least: int = 10) -> DataFrame:
    """One row (n, w_plus, z) of signed ranks of x - y, zero differences left out; null with fewer
    than ``least`` of them."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").withColumn("a", F.round(F.abs("d"), 12))
    r = average_ranks(d, "a")
    s = r.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w"))
    n, ok = F.col("n"), F.col("n") >= least
    z = (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return s.select("n", F.when(ok, F.col("w")).alias("w_plus"), F.when(ok, z).alias("z"))


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, mean, t, cohens_d) of x - y; null where the differences don't vary."""
    d = df.select((F.col(x) - F.col(y)).cast("double").alias("d")).where("d is not null")
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    return s.select("n", "mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")).alias("t"), F.try_divide(F.col("mean"), F.col("sd")).alias("cohens_d"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, agreement, kappa) of two raters' labels of the rows that both labelled."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    n = x.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"))
    pa, pb = x.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("na")), x.groupBy(F.col("b").alias("k")).agg(F.count(F.lit(1)).alias("nb"))
    e = pa.join(pb, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("s"))
    p = F.col("s") / (F.col("n") * F.col("n"))
    return n.crossJoin(e).select("n", "agreement", F.try_divide(F.col("agreement") - p, 1 - p).alias("kappa"))  # one row each


def empirical(observed: float, null: list[float]) -> dict[str, float]:
    """z score and +1-corrected one-sided shares of a null distribution at or beyond ``observed``."""
    x = np.asarray(null, float)
    sd = x.std(ddof=1) if len(x) > 1 else float("nan")
    return {"z": (observed - x.mean()) / sd if sd > 0 else float("nan"), "p_low": (1 + (x <= observed).sum()) / (len(x) + 1), "p_high": (1 + (x >= observed).sum()) / (len(x) + 1)}


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def bootstrap_mean(df: DataFrame, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """One row (mean, low, high): 2.5 and 97.5 per cent points of resampled means. Every row weighs a
    Poisson(1) number per draw, so each task gives only sums, and no row moves."""

    def sums(batches):
        for k, pdf in enumerate(batches):
            x = pdf["v"].to_numpy(float)
            rng = np.random.default_rng([seed, len(x), int(abs(x.sum() * 1e6)) % (2**31), k])
            w = rng.poisson(1.0, (draws, len(x)))
            yield pd.DataFrame({"draw": range(draws), "s": w @ x, "w": w.sum(1).astype(float)})

    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    means = d.mapInPandas(sums, "draw int, s double, w double").groupBy("draw").agg((F.sum("s") / F.sum("w")).alias("m"))
    return d.agg(F.avg("v").alias("mean")).crossJoin(means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")))  # one row each
