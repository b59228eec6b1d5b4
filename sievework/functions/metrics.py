"""Metrics as grouped aggregations: AUC, correlations, losses, spreads and differences. Null results where undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.ranks import rank_table, running_total, with_rank


def auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Exact tie-aware AUC per keys: auc, n_pos, n_neg. y is 1 for positive; null y and null scores are left out.

    2 * P * N * AUC = sum over distinct scores of pos * (2 * negatives below + negatives tied), in integers.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    counts = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    sums = running_total(counts, keys, "_s", ["neg"]).groupBy(*keys).agg(
        F.sum(F.col("pos") * (2 * F.col("neg_before") + F.col("neg"))).alias("twice"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    area = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("twice") / F.nullif(2 * F.col("n_pos") * F.col("n_neg"), F.lit(0)))
    return sums.select(*keys, area.alias("auc"), "n_pos", "n_neg")


def macro(table: DataFrame, keys: list[str], value: str = "auc", name: str = "macro_auc") -> DataFrame:
    """Mean over the labels for which the metric is defined."""
    return table.groupBy(*keys).agg(F.avg(value).alias(name), F.count(value).alias("n_labels"))


def hanley_mcneil(a: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of an AUC."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    var = a * (1 - a) + (n_pos - 1) * (q1 - a * a) + (n_neg - 1) * (q2 - a * a)
    return F.sqrt(F.greatest(var, F.lit(0.0)) / F.nullif(n_pos * n_neg, F.lit(0)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; null if a side is constant (corr() fails there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-12, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho", least: int = 0) -> DataFrame:
    """Spearman's rho per keys over rows where both are known; null if a side is constant or `least` rows aren't exceeded."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = with_rank(with_rank(rows, keys, "_x", "_rx", "average"), keys, "_y", "_ry", "average")
    return ranked.groupBy(*keys).agg(F.when(F.count("*") > least, pearson(F.col("_rx"), F.col("_ry"))).alias(name), F.count("*").alias("n"))


def agreement(x: Column, y: Column, cut: float = 0.5) -> Column:
    """Share of rows on which two scores decide alike at a cut."""
    return F.avg(((x >= cut) == (y >= cut)).cast("int"))


def weighted_log_loss(df: DataFrame, unit: list[str], y: str, p: str, w: str, eps: float = 1e-7, pos_weight: Column | None = None) -> DataFrame:
    """Mean over units of sum(w * loss) / sum(w)."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    loss = -(F.col(y) * F.log(q) * (F.lit(1.0) if pos_weight is None else pos_weight) + (1 - F.col(y)) * F.log(1 - q))
    per = df.groupBy(*unit).agg((F.sum(F.col(w) * loss) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"))
    return per.agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


def balance_weight(prevalence: Column, most: float = 10.0) -> Column:
    """Weight of positives: (1 - p) / p within 1 and `most`."""
    return F.greatest(F.lit(1.0), F.least(F.lit(most), (1 - prevalence) / F.nullif(prevalence, F.lit(0.0))))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population deviation and whether a column is constant."""
    return df.groupBy(*keys).agg(F.stddev_pop(value).alias("spread"), (F.max(value) == F.min(value)).alias("constant"), F.count(value).alias("n"))


def differences(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], value: str) -> DataFrame:
    """Largest and mean absolute difference per keys, and the rows of one side only."""
    both = a.select(*on, F.col(value).alias("_a"), F.lit(1).alias("_in_a")).join(b.select(*on, F.col(value).alias("_b"), F.lit(1).alias("_in_b")), on, "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy(*keys).agg(F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"), F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"))


def verdict(max_diff: Column, mean_diff: Column, strict: float = 1e-3, loose: float = 0.03, mean: float = 0.003) -> Column:
    return F.when(max_diff <= strict, "equal").when((max_diff <= loose) & (mean_diff <= mean), "portable").otherwise("different")


__all__ = ["agreement", "auc", "balance_weight", "differences", "hanley_mcneil", "macro", "pearson", "rank_table", "spearman", "spread", "verdict", "weighted_log_loss"]
