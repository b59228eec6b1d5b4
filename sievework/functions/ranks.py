"""Ranks with average ties, at any size.

A window over a whole label would put the label into one task. So rows are first counted by distinct value (one hash
aggregation), and running totals over the distinct values are taken in two levels: values are dealt to ordered buckets at
approximate quantiles of their label, buckets are totalled, and windows run within a bucket. Where the quantiles fall has no
effect on results: they are computed once. Labels of few distinct values need none of this. The counts are computed once (a checkpoint), so nested ranks read their input once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.sources.shared import once

BUCKETS = 64
#: Rows up to which a key is one window (most keys, such as series, have a few), and keys beyond that whose bounds are broadcast.
LIGHT, BROADCAST_KEYS = 10_000, 1_000
#: Reference rows per bucket in `quantile_match`, about, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 10_000, 4096


def null_if_nan(c: Column) -> Column:
    """NaN is a missing value: in Spark it would count and sort as the largest number."""
    return F.when(~F.isnan(c), c)


def running_total(df: DataFrame, keys: list[str], order: str, values: list[str], buckets: int = BUCKETS, light: int | None = None) -> DataFrame:
    """Adds <value>_before: the sum over rows of the same keys with a smaller `order`. One row per keys and order. Keys of more
    than `light` rows are dealt to buckets."""
    if buckets <= 1:  # for keys of few rows each: one window
        w = W.partitionBy(*keys)
        before = w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({f"{v}_total": F.sum(v).over(w) for v in values} | {f"{v}_before": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values})
    for k in keys:  # a row without a key is in no group
        df = df.where(F.col(k).isNotNull())
    df = once(df)
    heavy = once(df.groupBy(*keys).agg(F.count("*").alias("_rows"), *(F.sum(v).alias(f"_{v}_all") for v in values)).where(F.col("_rows") > (LIGHT if light is None else light)).drop("_rows"))
    n_heavy = heavy.count()
    if not n_heavy:
        return running_total(df, keys, order, values, 1)
    small = F.broadcast if n_heavy <= BROADCAST_KEYS else lambda t: t
    grid = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    # Sketches depend on the order in which they are merged: computed twice, a value could be in two buckets.
    bounds = once(df.join(small(heavy.select(*keys)), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(order, grid, 1000).alias("_bounds")).join(heavy, keys))
    dealt = df.join(small(bounds), keys, "left").withColumn("_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(order))), F.lit(0)))
    sums = dealt.where(F.col("_bounds").isNotNull()).groupBy(*keys, "_bucket").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = sums.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}_first") for v in values))
    whole = W.partitionBy(*keys, "_bucket")
    inside = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.drop("_bounds").join(small(first), [*keys, "_bucket"], "left")
    out = out.withColumns({f"{v}_total": F.coalesce(F.col(f"_{v}_all"), F.sum(v).over(whole)) for v in values} | {f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.coalesce(F.col(f"_{v}_first"), F.lit(0)) for v in values})
    return out.drop("_bucket", *(f"_{v}_{x}" for v in values for x in ("all", "first")))


def rank_table(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per keys and distinct value that isn't null: ties, before and n, from which all ranks follow."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    return running_total(counts, keys, value, ["ties"]).withColumnsRenamed({"ties_before": "before", "ties_total": "n"})


def average_rank() -> Column:
    """1-based rank, ties at their mean, on a rank_table."""
    return F.col("before") + (F.col("ties") + 1) / 2


def with_rank(df: DataFrame, keys: list[str], value: str, name: str, kind: str = "pct", on: Column | None = None) -> DataFrame:
    """Adds the rank of `value` within keys; null stays null.

    kind: pct (average rank / n), end01 ((average rank - 1) / (n - 1), 0.5 for one row), average, or exact: a struct of the integers
    `twice` (the average rank, doubled) and `n`.
    on: rank among the rows for which it holds only; the others get null.
    """
    source = df if on is None else df.withColumn(value + "_on", F.when(on, F.col(value)))
    column = value if on is None else value + "_on"
    table = rank_table(source, keys, column)
    rank = {"exact": F.struct((2 * F.col("before") + F.col("ties") + 1).alias("twice"), F.col("n").alias("n")), "average": average_rank(), "pct": average_rank() / F.col("n"), "end01": F.when(F.col("n") == 1, 0.5).otherwise((average_rank() - 1) / F.nullif(F.col("n") - 1, F.lit(0)))}[kind]
    out = source.join(table.select(*keys, column, rank.alias(name)), [*keys, column], "left")
    return out if on is None else out.drop(column)


def with_row_rank(df: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """The variant without ties: 0-1 rank by (value, tie), null first. Only rows of one value are ordered in a window."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    known = running_total(counts.where(F.col(value).isNotNull()), keys, value, ["ties"]).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.col(value).alias("_v"), "ties_before", "ties_total")
    null = counts.where(F.col(value).isNull()).select(*(F.col(c).alias(f"_n{i}") for i, c in enumerate(keys)), F.col("ties").alias("_null"))
    on = lambda p: [F.col(c).eqNullSafe(F.col(f"{p}{i}")) for i, c in enumerate(keys)]
    tie_at = F.row_number().over(W.partitionBy(*keys, value).orderBy(tie)) - 1
    placed = df.withColumn("_tie", tie_at).join(known, [*on("_k"), F.col(value) == F.col("_v")], "left").join(null, on("_n") or F.lit(True), "left")
    nulls = F.coalesce("_null", F.lit(0))
    at = F.when(F.col(value).isNull(), F.col("_tie")).otherwise(nulls + F.col("ties_before") + F.col("_tie"))
    totals = counts.groupBy(*(F.col(c).alias(f"_m{i}") for i, c in enumerate(keys))).agg(F.sum("ties").alias("_total"))
    placed = placed.withColumn("_at", at).join(totals, on("_m") or F.lit(True))
    out = placed.withColumn(name, F.when(F.col("_total") == 1, 0.5).otherwise(F.col("_at") / F.nullif(F.col("_total") - 1, F.lit(0))))
    return out.select(*df.columns, name)


def _last_before(known: DataFrame, asked: DataFrame, keys: list[str], size: str) -> DataFrame:
    """(keys, _at) of `asked` with `_v` of the last row of `known` (keys, _from, _v) that starts at or before it. Positions lie
    evenly in 0 .. size - 1, so they are dealt to buckets of equal width; a bucket starts with what the one before ended with."""
    count = F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col(size) / BUCKET_ROWS)))
    bucket = lambda at: F.floor(at * count / F.col(size))
    rows = known.select(*keys, bucket(F.col("_from")).alias("_b"), F.col("_from").alias("_at"), F.lit(0).alias("_ask"), "_v")
    rows = rows.unionByName(asked.select(*keys, bucket(F.col("_at")).alias("_b"), "_at", F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("_v")).distinct())
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_ask") == 0, F.col("_at"))).alias("_end"))
    start = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_start"))
    inside = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_b").orderBy("_at", "_ask").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_v", inside).where("_ask = 1").join(start, [*keys, "_b"]).select(*keys, "_at", F.coalesce("_v", "_start").alias("_v"))


def quantile_match(pred: DataFrame, ref: DataFrame, keys: list[str], value: str, ref_value: str, name: str) -> DataFrame:
    """Adds the value of `ref` at the quantile (average rank - 0.5) / n of pred's value, linear between neighbours.

    Null stays null; a constant prediction gets the median; keys without reference give null.
    """
    table = once(rank_table(ref, keys, ref_value).select(*keys, F.col(ref_value).cast("double").alias("_v"), F.col("before").alias("_from"), F.col("n").alias("_m")))
    ranks = rank_table(pred, keys, value)
    sizes = table.groupBy(*keys).agg(F.max("_m").alias("_m"))
    pos = (average_rank() - 0.5) / F.col("n") * (F.col("_m") - 1)
    # One spot per distinct predicted value; a reference value stands at positions _from .. _from + ties - 1.
    spots = once(ranks.join(sizes, keys).select(*keys, value, pos.alias("_pos"), "_m").withColumns({"_lo": F.floor("_pos"), "_hi": F.ceil("_pos")}))
    asked = spots.select(*keys, "_m", F.explode(F.array("_lo", "_hi")).alias("_at"))
    found = once(_last_before(table, asked, keys, "_m"))
    low, high = found.withColumnsRenamed({"_at": "_lo", "_v": "_low"}), found.withColumnsRenamed({"_at": "_hi", "_v": "_high"})
    at = spots.join(low, [*keys, "_lo"]).join(high, [*keys, "_hi"])
    at = at.select(*keys, value, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - F.col("_lo"))).alias(name))
    return pred.join(at, [*keys, value], "left")
