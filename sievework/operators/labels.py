"""Label sources and targets in long form (uid, label, value, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.ranks import quantile_match, with_rank
from sievework.functions.scalars import clip01, confidence


def to_long(wide: DataFrame, labels: list[str], ids: list[str], name: str = "value") -> DataFrame:
    """One row per uid and label; NaN becomes null."""
    cols = [F.col(f"`{c}`").cast("double").alias(c) for c in labels]
    long = wide.select(*ids, *cols).unpivot(ids, [f"`{c}`" for c in labels], "label", name)
    return long.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def to_wide(long: DataFrame, labels: list[str], ids: list[str], value: str = "value") -> DataFrame:
    """One row per uid with the labels' columns in the given order."""
    return long.groupBy(*ids).pivot("label", labels).agg(F.first(value, ignorenulls=True)).select(*ids, *(F.col(f"`{c}`") for c in labels))


def probability_blend(sources: DataFrame) -> DataFrame:
    """Mean and population deviation over the sources that have a value, and the cell's weight."""
    cells = sources.groupBy("uid", "label").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_sources"))
    return cells.withColumn("w", confidence(F.col("mean"), F.col("std")))


def rank_blend(sources: DataFrame) -> DataFrame:
    """Mean over sources of each source's percentile rank within its label."""
    ranked = with_rank(sources, ["source", "label"], "value", "r")
    return ranked.groupBy("uid", "label").agg(F.avg("r").alias("rank_mean"))


def blend_views(views: DataFrame, weights: DataFrame, n_views: int, n_labels: int) -> DataFrame:
    """Weighted mean over views of clipped probabilities, weights normalised; uids with any view or label missing go."""
    joined = views.join(weights, "view")
    p = clip01(F.col("p"))
    cells = joined.groupBy("uid", "label").agg((F.sum(F.col("w") * p) / F.sum("w")).alias("p"), F.count("p").alias("known"))
    whole = cells.groupBy("uid").agg(F.sum("known").alias("total")).where(F.col("total") == n_views * n_labels).select("uid")
    return cells.join(whole, "uid", "left_semi").drop("known")


def weights_consistent(files: DataFrame, key: list[str], value: str) -> DataFrame:
    """Side data that differ between files, as a violations table."""
    return files.groupBy(*key).agg(F.count_distinct(value).alias("kinds")).where("kinds > 1")


def first_known(df: DataFrame, keys: list[str], value: str, order: str, name: str | None = None) -> DataFrame:
    """The first value that isn't null by `order`, per keys; null if there is none."""
    known = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(F.min_by(value, F.when(known, F.col(order))).alias(name or value))


def masked_targets(df: DataFrame, supervised: dict[str, Column], labels: list[str]) -> DataFrame:
    """uid with y and w for all labels: supervised ones have their value and weight 1 (0.5 and 0 if null), others 0.5 and 0;
    rows without any supervised cell go."""
    y = {f"y__{c}": F.coalesce(supervised.get(c, F.lit(None)).cast("double"), F.lit(0.5)) for c in labels}
    w = {f"w__{c}": F.when(supervised[c].isNotNull(), 1).otherwise(0) if c in supervised else F.lit(0) for c in labels}
    total = sum((F.col(f"`w__{c}`") for c in labels), F.lit(0))
    return df.withColumns(y | w).where(total > 0)


def mix_teacher(soft: DataFrame, teacher: DataFrame, gold: DataFrame, m: float, silent: DataFrame | None = None, silent_m: float | None = None) -> DataFrame:
    """soft (uid, label, value) moved towards teacher tables (source, uid, label, value), which are first brought to the
    scale of the soft values by quantiles fitted on rows that aren't gold.

    Cells of gold rows and cells that no teacher covers stay. silent: (uid, label) cells that use silent_m instead of m.
    """
    free = teacher.join(gold.select("uid"), "uid", "left_anti")
    ref = soft.join(gold.select("uid"), "uid", "left_anti").select("label", F.col("value").alias("ref"))
    sources = teacher.select("source").distinct()
    refs = ref.join(F.broadcast(sources))
    matched = quantile_match(free, refs, ["source", "label"], "value", "ref", "matched")
    mean = matched.groupBy("uid", "label").agg(F.avg("matched").alias("taught"))
    out = soft.join(mean, ["uid", "label"], "left")
    share = F.lit(m)
    if silent is not None and silent_m is not None:
        out = out.join(silent.select("uid", "label", F.lit(True).alias("_silent")), ["uid", "label"], "left")
        share = F.when(F.col("_silent"), silent_m).otherwise(m)
    value = F.when(F.col("taught").isNull(), F.col("value")).otherwise((1 - share) * F.col("value") + share * F.col("taught"))
    return out.withColumn("value", value).drop("taught", "_silent")


def override_gold(cells: DataFrame, gold: DataFrame, gold_weight: float = 8.0, floor: float = 0.15) -> DataFrame:
    """Gold cells (uid, label, y) replace values at a high weight; missing values get their label's mean at the floor."""
    out = cells.join(gold.select("uid", "label", F.col("y").cast("double").alias("_y")), ["uid", "label"], "left")
    means = cells.groupBy("label").agg(F.avg("value").alias("_mean"))
    out = out.join(means, "label")
    return out.select(
        "uid",
        "label",
        F.coalesce("_y", "value", "_mean", F.lit(0.5)).alias("y"),
        F.when(F.col("_y").isNotNull(), gold_weight).when(F.col("value").isNull(), floor).otherwise(F.col("w")).alias("w"),
        F.col("_y").isNotNull().alias("is_gold"),
    )


def backfill(cells: DataFrame, target: str, donor: str, verdict: str = "UNK") -> DataFrame:
    """Cells of `target` with the given verdict take the donor label's value, and a weight from it."""
    other = cells.where(F.col("label") == donor).select("uid", F.col("value").alias("_donor"))
    out = cells.join(other, "uid", "left")
    hit = (F.col("label") == target) & (F.col("verdict") == verdict) & F.col("_donor").isNotNull()
    value = F.when(hit, F.col("_donor")).otherwise(F.col("value"))
    w = F.when(hit, confidence(F.col("_donor"), F.lit(0.0))).otherwise(F.col("w"))
    return out.withColumns({"value": value, "w": w}).drop("_donor")
