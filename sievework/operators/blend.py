"""Rank ensembles of member predictions in long form (member, uid, label, p)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.metrics import pearson
from sievework.functions.ranks import with_rank
from sievework.functions.scalars import clip01


def rank_mean(members: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(uid, label, p) to the mean of percentile ranks: over the members of a version, over the versions of a vote group,
    over the groups. versions: (member, version, vote); without it each member votes alone."""
    ranked = with_rank(members, ["member", "label"], "p", "r")
    if versions is None:
        return ranked.groupBy("uid", "label").agg(F.avg("r").alias("p"))
    named = ranked.join(F.broadcast(versions), "member")
    by_version = named.groupBy("uid", "label", "vote", "version").agg(F.avg("r").alias("r"))
    by_vote = by_version.groupBy("uid", "label", "vote").agg(F.avg("r").alias("r"))
    return by_vote.groupBy("uid", "label").agg(F.avg("r").alias("p"))


def voiceless(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that no member votes on: must be empty."""
    return labels.join(members.where("p is not null").select("label").distinct(), "label", "left_anti")


def weighted(members: DataFrame, weights: DataFrame, kind: str = "pct") -> DataFrame:
    """Weighted mean of ranks by (member, label, w); members may cover different uids: weights are normalised over those that score."""
    ranked = with_rank(members, ["member", "label"], "p", "r", kind).where("r is not null")
    joined = ranked.join(F.broadcast(weights), ["member", "label"])
    return joined.groupBy("uid", "label").agg((F.sum(F.col("w") * F.col("r")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("p"))


def by_folds(members: DataFrame, folds: int = 5) -> DataFrame:
    """Raw mean inside each fold, its rank, equal mean over the folds; only where all folds are present."""
    inside = members.groupBy("fold", "uid", "label").agg(F.avg("p").alias("p"))
    ranked = with_rank(inside, ["fold", "label"], "p", "r", "end01")
    return ranked.groupBy("uid", "label").agg(F.avg("r").alias("p"), F.count_distinct("fold").alias("n")).where(F.col("n") == folds).drop("n")


def mix_ranked(a: DataFrame, b: DataFrame, betas: list[float]) -> DataFrame:
    """(beta, uid, label, p): rank of (1 - beta) * rank(a) + beta * rank(b) for each beta.

    Mixes are compared as integers, the mix times both numbers of rows and the power of ten that makes beta whole: as fractions,
    equal mixes may differ in their last bit, and rounded ones lie on either side of a half."""
    ra = with_rank(a, ["label"], "p", "ra", "exact").select("uid", "label", "ra")
    rb = with_rank(b, ["label"], "p", "rb", "exact").select("uid", "label", "rb")
    share = [Decimal(repr(float(x))) for x in betas]
    places = max((-x.as_tuple().exponent for x in share), default=0)
    whole = lambda x: F.lit(int(x.scaleb(places))).cast("decimal(38,0)")
    grid = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("beta"), whole(1 - x).alias("of_a"), whole(x).alias("of_b")) for x in share))).alias("g")
    part = lambda x, n: F.col(f"{x}.twice") * F.col(f"{n}.n").cast("decimal(20,0)")
    both = ra.join(rb, ["uid", "label"]).select("*", grid).withColumn("m", (F.col("g.of_a") * part("ra", "rb") + F.col("g.of_b") * part("rb", "ra")).cast("decimal(38,0)"))
    return with_rank(both.select(F.col("g.beta").alias("beta"), "uid", "label", "m"), ["beta", "label"], "m", "p").select("beta", "uid", "label", "p")


def two_with_failures(a: DataFrame, b: DataFrame, weight_a: float | Column = 0.5, weights: DataFrame | None = None) -> DataFrame:
    """Ranks among the scored rows of each model; where one failed the other's rank, where both did 0.5.

    a, b: (uid, label, p, ok). weights: (label, w) for a's share by label.
    """
    ra = with_rank(a, ["label"], "p", "ra", on=F.col("ok")).select("uid", "label", "ra")
    rb = with_rank(b, ["label"], "p", "rb", on=F.col("ok")).select("uid", "label", "rb")
    both = ra.join(rb, ["uid", "label"], "full")
    if weights is not None:
        both = both.join(F.broadcast(weights), "label")
    share = F.col("w") if weights is not None else weight_a if isinstance(weight_a, Column) else F.lit(weight_a)
    mixed = share * F.col("ra") + (1 - share) * F.col("rb")
    return both.select("uid", "label", F.coalesce(mixed, "ra", "rb", F.lit(0.5)).alias("p"))


def renormalised(members: DataFrame, weights: DataFrame) -> DataFrame:
    """sum(w r) / sum(w) over the members that scored a row (ok), ranked among scored rows; null if none did."""
    ranked = with_rank(members, ["member", "label"], "p", "r", on=F.col("ok")).join(F.broadcast(weights), "member")
    w = F.when(F.col("r").isNotNull(), F.col("w"))
    return ranked.groupBy("uid", "label").agg((F.sum(w * F.col("r")) / F.nullif(F.sum(w), F.lit(0.0))).alias("p"))


def repeated_rows(members: DataFrame) -> DataFrame:
    """(member, uid) whose whole label vector equals another row's of the member: copies count as failed."""
    vector = members.groupBy("member", "uid").agg(F.array_sort(F.collect_list(F.struct("label", "p"))).alias("v"))
    keyed = vector.select("member", "uid", F.sha2(F.to_json("v").cast("binary"), 256).alias("h"))
    twice = keyed.groupBy("member", "h").agg(F.count("*").alias("n")).where("n > 1").select("member", "h")
    return keyed.join(twice, ["member", "h"], "left_semi").select("member", "uid")


def third_component(base: DataFrame, third: DataFrame, gamma: float) -> DataFrame:
    """Rank of (1 - gamma) * rank(base) + gamma * rank(third) where the third scored, rank(base) elsewhere."""
    r1 = with_rank(base, ["label"], "p", "r1").select("uid", "label", "r1")
    r3 = with_rank(third, ["label"], "p", "r3", on=F.col("ok")).select("uid", "label", "r3")
    both = r1.join(r3, ["uid", "label"], "left").withColumn("m", F.round(F.coalesce((1 - gamma) * F.col("r1") + gamma * F.col("r3"), "r1"), 12))
    return with_rank(both, ["label"], "m", "p").select("uid", "label", "p")


def neutral_fill(members: DataFrame) -> DataFrame:
    """Missing values take their member's and label's mean, else 0.5; `filled` marks them."""
    mean = members.groupBy("member", "label").agg(F.avg("p").alias("_m"))
    return members.join(mean, ["member", "label"]).withColumn("filled", F.col("p").isNull()).withColumn("p", F.coalesce("p", "_m", F.lit(0.5))).drop("_m")


def probability_mix(views: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of clipped probabilities, then the 0-1 rank."""
    mixed = views.join(F.broadcast(weights), "view").groupBy("uid", "label").agg((F.sum(F.col("w") * clip01(F.col("p"))) / F.sum("w")).alias("m"))
    return with_rank(mixed.withColumn("m", F.round("m", 12)), ["label"], "m", "p", "end01").select("uid", "label", "p")


def applicable(parent: DataFrame, folds: DataFrame) -> DataFrame:
    """Fold ranks averaged over eligible rows; rows that aren't eligible keep the parent's rank.

    parent: (uid, label, p); folds: (fold, uid, label, p, eligible). Eligible rows without a value are an error: see `unscored`.
    """
    base = with_rank(parent, ["label"], "p", "r0", "end01").select("uid", "label", "r0")
    ranked = with_rank(folds, ["fold", "label"], "p", "r", "end01", on=F.col("eligible")).groupBy("uid", "label").agg(F.avg("r").alias("r"))
    return base.join(ranked, ["uid", "label"], "left").select("uid", "label", F.coalesce("r", "r0").alias("p"))


def unscored(folds: DataFrame) -> DataFrame:
    return folds.where("eligible and p is null").select("fold", "uid", "label")


def residual(anchor: DataFrame, old: DataFrame, new: DataFrame, beta: float, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Rank of anchor + beta * novelty * (rank(new) - rank(old)); novelty = (1 - rho) over its median, within low and high."""
    ranks = [with_rank(t, ["label"], "p", n).select("uid", "label", n) for t, n in ((anchor, "ra"), (old, "ro"), (new, "rn"))]
    both = ranks[0].join(ranks[1], ["uid", "label"]).join(ranks[2], ["uid", "label"])
    rho = both.groupBy("label").agg(F.greatest(1 - F.coalesce(pearson(F.col("ro"), F.col("rn")), F.lit(1.0)), F.lit(1e-4)).alias("novelty"))
    median = rho.agg(F.median("novelty").alias("m"))
    scale = rho.join(F.broadcast(median)).select("label", F.greatest(F.lit(low), F.least(F.lit(high), F.col("novelty") / F.greatest("m", F.lit(1e-4)))).alias("scale"))
    moved = both.join(F.broadcast(scale), "label").withColumn("v", F.round(F.col("ra") + beta * F.col("scale") * (F.col("rn") - F.col("ro")), 9))
    return with_rank(moved, ["label"], "v", "p").select("uid", "label", "p")


def neighbour_residual(base: DataFrame, edges: DataFrame) -> DataFrame:
    """Label rank + alpha * mean rank of its neighbour labels, all from the same base, ranked again.

    edges: (label, neighbour, alpha); labels without edges keep their rank.
    """
    r = with_rank(base, ["label"], "p", "r").select("uid", "label", "r")
    near = r.withColumnsRenamed({"label": "neighbour", "r": "rn"}).join(F.broadcast(edges), "neighbour")
    mean = near.groupBy("uid", "label").agg((F.avg("rn") * F.first("alpha")).alias("shift"))
    moved = r.join(mean, ["uid", "label"], "left").withColumn("v", F.round(F.col("r") + F.coalesce("shift", F.lit(0.0)), 9))
    return with_rank(moved, ["label"], "v", "p").select("uid", "label", "p")


def guarded_weight(w: Column, rho: Column, base: Column, high: float = 0.992, low: float = 0.60, shrink: float = 0.5) -> Column:
    """A member's weight, cut where it says the same as the rest, shrunk to the base where it says too different a thing."""
    return F.when(rho.isNull(), base).when(rho > high, w * shrink).when(rho < low, base + (w - base) * shrink).otherwise(w)


def inject_specialist(base: DataFrame, specialist: DataFrame, labels: list[str], w: float) -> DataFrame:
    """Specialist ranks mixed into the chosen labels, others unchanged."""
    rb = with_rank(base, ["label"], "p", "rb").select("uid", "label", "rb")
    rs = with_rank(specialist, ["label"], "p", "rs").select("uid", "label", "rs")
    both = rb.join(rs, ["uid", "label"], "left")
    mixed = F.when(F.col("label").isin(*labels) & F.col("rs").isNotNull(), (1 - w) * F.col("rb") + w * F.col("rs")).otherwise(F.col("rb"))
    return with_rank(both.withColumn("m", F.round(mixed, 12)), ["label"], "m", "p").select("uid", "label", "p")


def gold_gate(delta: Column, win: Column, rho: Column, least: float = 0.002, wins: float = 0.65, most_rho: float = 0.985) -> Column:
    """Whether a specialist may be injected."""
    return F.coalesce((delta >= least) & (win >= wins) & (rho <= most_rho), F.lit(False))


def stack(features: DataFrame, scaling: DataFrame, coefs: DataFrame, base: DataFrame, gated: DataFrame) -> DataFrame:
    """Linear stacking: features (uid, feature, x) standardised by (feature, mean, scale), times (label, feature, coef) plus
    the coefficient of feature '' as a bias, ranked; mixed with weight w into the labels of gated (label, w)."""
    z = features.join(F.broadcast(scaling), "feature").select("uid", "feature", ((F.col("x") - F.col("mean")) / F.col("scale")).alias("z"))
    score = z.join(F.broadcast(coefs.where("feature <> ''")), "feature").groupBy("uid", "label").agg(F.sum(F.col("coef") * F.col("z")).alias("s"))
    score = score.join(F.broadcast(coefs.where("feature = ''").select("label", F.col("coef").alias("bias"))), "label", "left").withColumn("s", F.round(F.col("s") + F.coalesce("bias", F.lit(0.0)), 9))
    rs = with_rank(score, ["label"], "s", "rs").select("uid", "label", "rs")
    rb = with_rank(base, ["label"], "p", "rb").select("uid", "label", "rb")
    both = rb.join(rs, ["uid", "label"], "left").join(F.broadcast(gated), "label", "left")
    return both.select("uid", "label", F.when(F.col("w").isNotNull() & F.col("rs").isNotNull(), (1 - F.col("w")) * F.col("rb") + F.col("w") * F.col("rs")).otherwise(F.col("rb")).alias("p"))


def layout_drift(features: DataFrame, scaling: DataFrame) -> DataFrame:
    """Features that one side lacks: must be empty."""
    have = features.select("feature").distinct().withColumn("_a", F.lit(1))
    return have.join(scaling.select("feature", F.lit(1).alias("_b")), "feature", "full").where("_a is null or _b is null").select("feature")


def distill(sets: DataFrame, per_fold: bool = True) -> DataFrame:
    """(set, fold, uid, label, p) to targets in (0, 1]: rank inside fold, rank over the set, mean over the sets."""
    rows = with_rank(sets, ["set", "fold", "label"], "p", "r0") if per_fold else sets.withColumn("r0", F.col("p"))
    ranked = with_rank(rows, ["set", "label"], "r0", "r")
    return ranked.groupBy("uid", "label").agg(F.avg("r").alias("p"), F.count("r").alias("n_sets"))


def composite(index: DataFrame, a: DataFrame, b: DataFrame, w: float) -> DataFrame:
    """w * rank(a) + (1 - w) * rank(b) over the index's uids, rounded half to even at six places."""
    ra = with_rank(a.join(index, "uid", "left_semi"), ["label"], "p", "ra").select("uid", "label", "ra")
    rb = with_rank(b.join(index, "uid", "left_semi"), ["label"], "p", "rb").select("uid", "label", "rb")
    return ra.join(rb, ["uid", "label"]).select("uid", "label", F.bround(w * F.col("ra") + (1 - w) * F.col("rb"), 6).alias("p"))


def snapshots(oof: DataFrame, last: int = 3) -> DataFrame:
    """Rank mean of the last epochs of each arm."""
    recent = oof.withColumn("_e", F.dense_rank().over(W.partitionBy("arm", "uid", "label").orderBy(F.desc("epoch")))).where(F.col("_e") <= last)
    return with_rank(recent, ["arm", "epoch", "label"], "p", "r").groupBy("arm", "uid", "label").agg(F.avg("r").alias("p"))
