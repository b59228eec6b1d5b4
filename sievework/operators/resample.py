"""Bootstraps, grids and split-half choices. Draws come from hashes, so they are the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.metrics import auc, macro, pearson
from sievework.sources.shared import once


def poisson1(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, by its cumulative probabilities."""
    cum, p, out = 0.36787944117144233, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):
        out = out + F.when(u >= cum, 1).otherwise(0)
        p /= k
        cum += p
    return out


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: equal in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Replicates whose weights ride on one row, each a column; more make further copies of a row.
TOGETHER = 16
#: Rows of a class that one leaf of the tree of draws holds.
LEAF = 4096


def _blocks_of(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // TOGETHER))))


def _weight(k: int) -> str:
    return f"_w{k}"


def with_weights(rows: DataFrame, n: int, uid: str = "uid") -> DataFrame:
    """Rows with the Poisson(1) weights of n replicates, TOGETHER of them as columns of one row (_block, _w0, ...): a bootstrap
    whose size varies as little as rows are many. Weights follow the uid, so all labels and members of one are drawn together.
    Unused columns of the last block are 0."""
    out, each = _blocks_of(rows, n), {}
    for k in range(min(n, TOGETHER)):
        number = F.col("_block") * TOGETHER + k
        each[_weight(k)] = F.when(number < n, poisson1(uniform(number.cast("string"), F.col(uid).cast("string")))).otherwise(0)
    return out.withColumns(each)


def replicate_auc(rows: DataFrame, keys: list[str], y: str, score: str, n: int) -> DataFrame:
    """Rows with weights (`with_weights`, `with_draws`) to the AUC per keys and replicate. Each key's scores are ordered once: counts
    and running totals of all replicates are columns of one row per distinct score."""
    from sievework.functions.ranks import running_total

    many, keyed = range(min(n, TOGETHER)), [*keys, "_block"]
    known = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    hit = F.col(y) == 1
    counts = known.groupBy(*keyed, F.col(score).alias("_s")).agg(
        *(F.sum(F.when(hit, F.col(_weight(k))).otherwise(0)).alias(f"_pos{k}") for k in many), *(F.sum(F.when(hit, 0).otherwise(F.col(_weight(k)))).alias(f"_neg{k}") for k in many)
    )
    totals = running_total(counts, keyed, "_s", [f"_neg{k}" for k in many])
    sums = totals.groupBy(*keyed).agg(
        *(F.sum(F.col(f"_pos{k}") * (2 * F.col(f"_neg{k}_before") + F.col(f"_neg{k}"))).alias(f"_twice{k}") for k in many), *(F.sum(f"_{c}{k}").alias(f"_{c}{k}") for c in ("pos", "neg") for k in many)
    )
    area = lambda k: F.when((F.col(f"_pos{k}") > 0) & (F.col(f"_neg{k}") > 0), F.col(f"_twice{k}") / F.nullif(2 * F.col(f"_pos{k}") * F.col(f"_neg{k}"), F.lit(0)))
    each = F.explode(F.array(*(F.struct((F.col("_block") * TOGETHER + k).alias("replicate"), area(k).alias("auc")) for k in many)))
    return sums.select(*keys, each.alias("r")).select(*keys, "r.replicate", "r.auc").where(F.col("replicate") < n)


def _number(*parts: Column, digits: int = 12) -> Column:
    """The first hex digits of the md5 of the parts as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, digits), 16, 10).cast("long")


def _pick(n: Column, *parts: Column) -> Column:
    """One of 0 to n - 1."""
    return F.floor(_number(*parts).cast("double") / float(1 << 48) * n).cast("long")


def class_places(rows: DataFrame, uid: str = "uid", y: str = "y") -> DataFrame:
    """(uid, label, y, ...) with _place, a row's number within its label and class in the order of a hash of uid, and _size, the rows
    of that class. Numbers are counted within 1024 parts of the hash's range, so no class meets in one task."""
    from pyspark.sql import Window as W

    hashed = once(rows.where(F.col(y).isNotNull()).withColumn("_h", _number(F.col(uid).cast("string"))))
    parted = hashed.withColumn("_part", F.shiftright("_h", 38))
    counts = parted.groupBy("label", y, "_part").agg(F.count("*").alias("_rows"))
    of_class = W.partitionBy("label", y)
    first = counts.select("label", y, "_part", F.coalesce(F.sum("_rows").over(of_class.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_rows").over(of_class).alias("_size"))
    inside = F.row_number().over(W.partitionBy("label", y, "_part").orderBy("_h", uid)) - 1
    return parted.withColumn("_in", inside).join(first, ["label", y, "_part"]).withColumn("_place", F.col("_first") + F.col("_in")).drop("_h", "_part", "_in", "_first")


def with_draws(rows: DataFrame, n: int, uid: str = "uid", y: str = "y", leaf: int = LEAF) -> DataFrame:
    """Rows with the weights of n class-stratified replicates: in each replicate and label, every class is drawn with replacement
    exactly as often as it has rows, so class totals hold.

    A multinomial split in two levels. A class of N rows, numbered by hash, makes N draws; a draw first falls into a leaf of
    `leaf` consecutive numbers (in proportion to the leaf's rows, as it picks a number of 0 to N - 1), of which only the totals
    per leaf and replicate are kept: a partial sum, some numbers per task. Within a leaf its draws fall on its rows alike. Draws
    are md5 numbers, equal in every engine and independent of partitioning; they are made where they are counted and never
    shuffled one by one.
    """
    placed = once(class_places(rows, uid, y))
    own = [F.col("label").cast("string"), F.col(y).cast("string")]
    draws = placed.select("label", y, "_place", "_size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    draws = draws.withColumn("_leaf", F.floor(_pick(F.col("_size"), F.col("replicate").cast("string"), *own, F.col("_place").cast("string")) / leaf).cast("long"))
    per_leaf = draws.groupBy("label", y, "_size", "_leaf", "replicate").agg(F.count("*").alias("_m")).repartition("label", y, "_leaf")
    one = per_leaf.withColumn("_i", F.explode(F.expr("sequence(1L, _m)")))
    rows_of = F.least(F.lit(leaf), F.col("_size") - F.col("_leaf") * leaf)
    place = F.col("_leaf") * leaf + _pick(rows_of, F.lit("leaf"), F.col("replicate").cast("string"), *own, F.col("_leaf").cast("string"), F.col("_i").cast("string"))
    block, at = F.floor(F.col("replicate") / TOGETHER).cast("int"), F.col("replicate") % TOGETHER
    # The leaf stays among the keys: counting needs no further exchange.
    drawn = one.select("label", y, "_leaf", place.alias("_place"), block.alias("_block"), at.alias("_at")).groupBy("label", y, "_leaf", "_place", "_block").agg(*(F.count_if(F.col("_at") == k).alias(_weight(k)) for k in range(min(n, TOGETHER))))
    joined = _blocks_of(placed, n).join(drawn.drop("_leaf"), ["label", y, "_place", "_block"], "left")
    return joined.withColumns({_weight(k): F.coalesce(_weight(k), F.lit(0)) for k in range(min(n, TOGETHER))})


def _drawn(rows: DataFrame, n: int, stratified: bool) -> DataFrame:
    return with_draws(rows, n) if stratified else with_weights(rows, n)


def bootstrap_macro(rows: DataFrame, n: int = 200, stratified: bool = False) -> DataFrame:
    """(uid, label, y, p) to the mean, 2.5th and 97.5th percentile of the macro AUC over replicates: Poisson weights per uid, or
    stratified by class within each label."""
    per = macro(replicate_auc(_drawn(rows, n, stratified), ["label"], "y", "p", n), ["replicate"])
    return per.agg(F.avg("macro_auc").alias("mean"), F.expr("percentile(macro_auc, array(0.025, 0.975))").alias("q"), F.count("*").alias("n")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n")


def bootstrap_delta(rows: DataFrame, n: int = 200, stratified: bool = False) -> DataFrame:
    """(uid, label, y, a, b): per label the paired gain of b over a: mean, 10th and 90th percentile, share of wins."""
    drawn = _drawn(rows, n, stratified)
    a = replicate_auc(drawn, ["label"], "y", "a", n).withColumnRenamed("auc", "auc_a")
    b = replicate_auc(drawn, ["label"], "y", "b", n).withColumnRenamed("auc", "auc_b")
    gain = a.join(b, ["replicate", "label"]).withColumn("gain", F.col("auc_b") - F.col("auc_a"))
    return gain.groupBy("label").agg(F.avg("gain").alias("mean"), F.expr("percentile(gain, array(0.1, 0.9))").alias("q"), F.avg((F.col("gain") > 0).cast("int")).alias("win")).select("label", "mean", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90"), "win")


def fit_weights(rows: DataFrame, grid: list[float], default: float) -> DataFrame:
    """(uid, label, y, ra, rb): per label the weight of b with the best AUC, nearest to the default of equals, then the smaller."""
    tried = rows.withColumn("weight", F.explode(F.array(*(F.lit(g) for g in grid)))).withColumn("m", F.round((1 - F.col("weight")) * F.col("ra") + F.col("weight") * F.col("rb"), 9))
    scored = auc(tried, ["label", "weight"], "y", "m")
    order = F.struct((-F.round("auc", 12)).alias("a"), F.round(F.abs(F.col("weight") - default), 9).alias("d"), F.col("weight").alias("w"))
    return scored.where("auc is not null").groupBy("label").agg(F.min_by("weight", order).alias("weight"), F.max("auc").alias("auc"))


def bootstrap_weights(rows: DataFrame, grid: list[float], default: float, n: int = 50) -> DataFrame:
    """Per label over replicates: median and mode of the best weight, and the share of replicates above the default. The grid
    multiplies the rows, replicates don't: their weights are columns."""
    tried = with_weights(rows, n).withColumn("weight", F.explode(F.array(*(F.lit(g) for g in grid)))).withColumn("m", F.round((1 - F.col("weight")) * F.col("ra") + F.col("weight") * F.col("rb"), 9))
    scored = replicate_auc(tried, ["label", "weight"], "y", "m", n).where("auc is not null")
    order = F.struct((-F.round("auc", 12)).alias("a"), F.round(F.abs(F.col("weight") - default), 9).alias("d"), F.col("weight").alias("w"))
    best = scored.groupBy("replicate", "label").agg(F.min_by("weight", order).alias("weight"))
    modes = best.groupBy("label", "weight").agg(F.count("*").alias("n")).groupBy("label").agg(F.min_by("weight", F.struct((-F.col("n")).alias("n"), F.col("weight").alias("w"))).alias("mode"))
    return best.groupBy("label").agg(F.median("weight").alias("median"), F.avg((F.col("weight") > default).cast("int")).alias("above")).join(modes, "label")


def profiles(fitted: DataFrame, default: float) -> DataFrame:
    """Five weight profiles per label from `fitted` (label, weight): default, fitted, half way, bounded step, opposite half way."""
    d, w = F.lit(default), F.col("weight")
    step = F.greatest(F.lit(-0.1), F.least(F.lit(0.1), w - d))
    each = F.create_map(F.lit("default"), d, F.lit("fitted"), w, F.lit("half"), (w + d) / 2, F.lit("step"), d + step, F.lit("against"), d - (w - d) / 2)
    return fitted.select("label", F.explode(each).alias("profile", "w"))


def compare_profiles(rows: DataFrame, weights: DataFrame, base: str = "default") -> DataFrame:
    """Macro AUC of each profile (label, profile, w) on (uid, label, y, ra, rb), and the gain over the base profile."""
    mixed = rows.join(F.broadcast(weights), "label").withColumn("m", F.round((1 - F.col("w")) * F.col("ra") + F.col("w") * F.col("rb"), 9))
    table = macro(auc(mixed, ["profile", "label"], "y", "m"), ["profile"])
    own = table.where(F.col("profile") == base).select(F.col("macro_auc").alias("_b"))
    return table.join(F.broadcast(own)).select("profile", "macro_auc", (F.col("macro_auc") - F.col("_b")).alias("gain"))


def split_half(oof: DataFrame, n: int = 50) -> DataFrame:
    """(uid, epoch, label, y, p): n random halves; the epoch chosen on one half is scored on the other, next to the last
    epoch and the best one there. Means over the splits."""
    halves = oof.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("half", F.when(uniform(F.lit("half"), F.col("split").cast("string"), F.col("uid").cast("string")) < 0.5, "a").otherwise("b"))
    table = macro(auc(halves, ["split", "half", "epoch", "label"], "y", "p"), ["split", "half", "epoch"])
    best = lambda half: table.where(F.col("half") == half)
    chosen = best("a").groupBy("split").agg(F.min_by("epoch", F.struct((-F.round("macro_auc", 12)).alias("m"), "epoch")).alias("epoch"))
    b = best("b").select("split", "epoch", "macro_auc")
    last = b.groupBy("split").agg(F.max_by("macro_auc", "epoch").alias("last"), F.max("macro_auc").alias("oracle"))
    found = chosen.join(b, ["split", "epoch"]).join(last, "split")
    return found.agg(F.avg("macro_auc").alias("chosen"), F.avg("last").alias("last"), F.avg("oracle").alias("oracle"), F.count("*").alias("splits"))


def pair_gain(pairs: DataFrame) -> DataFrame:
    """(kind, rho, gain) to count, means and sample deviation per kind of pair."""
    return pairs.groupBy("kind").agg(F.count("*").alias("n"), F.avg("rho").alias("rho"), F.avg("gain").alias("gain"), F.stddev_samp("gain").alias("sd"))


def ols(rows: DataFrame, y: str, x: list[str]) -> DataFrame:
    """Coefficients of y on the columns x with a constant, and R squared, from one pass of sums (few columns)."""
    import numpy as np

    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    n = len(cols)
    known = rows.where(F.col(y).isNotNull())
    for c in x:
        known = known.where(F.col(c).isNotNull())
    sums = known.agg(*(F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(n)), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    if not sums["n"]:
        return rows.sparkSession.createDataFrame([], "term string, coef double, r2 double")
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    b = np.array([sums[f"b{i}"] for i in range(n)])
    coef = np.linalg.lstsq(a, b, rcond=None)[0]
    total = sums["yy"] - b[0] ** 2 / sums["n"]
    rest = sums["yy"] - 2 * coef @ b + coef @ a @ coef
    r2 = float(1 - rest / total) if total > 0 else None
    return rows.sparkSession.createDataFrame([(t, float(c), r2) for t, c in zip(["1", *x], coef)], "term string, coef double, r2 double")


__all__ = ["bootstrap_delta", "bootstrap_macro", "bootstrap_weights", "compare_profiles", "fit_weights", "ols", "pair_gain", "pearson", "profiles", "replicate_auc", "split_half", "with_draws", "with_weights"]
