"""Public operators made of several others."""

from __future__ import annotations

import hashlib
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import ranks
from sievework.functions.metrics import auc, macro, pearson, spearman
from sievework.functions.ranks import with_rank
from sievework.operators import blend, labels, quality, resample, splits
from sievework.sources.shared import once


def score_sources(sources: DataFrame, gold: DataFrame) -> DataFrame:
    """AUC per source and label on gold, before gold replaces anything."""
    both = sources.join(gold, ["uid", "label"])
    return auc(both, ["source", "label"], "y", "value")


def build_targets(studies: DataFrame, sources: DataFrame, gold: DataFrame, teacher: DataFrame | None = None, m: float = 0.5, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Weighted targets and the blend's score on gold.

    studies: (uid, group, is_gold); sources: (uid, source, label, value); gold: (uid, label, y). Blend, weights, teacher
    mix, score against gold, gold override, fill, folds of whole groups. Targets: uid, label, y, w, is_gold, fold, group.
    """
    cells = labels.probability_blend(sources).select("uid", "label", F.col("mean").alias("value"), "w")
    if teacher is not None:
        cells = labels.mix_teacher(cells, teacher, gold.select("uid").distinct(), m)
    score = auc(cells.join(gold, ["uid", "label"]), ["label"], "y", "value")
    done = labels.override_gold(cells, gold)
    placed = splits.assign_folds(splits.group_sizes(studies), folds, seed).select("group", "fold")
    meta = studies.select("uid", "group").join(placed, "group")
    return done.join(meta, "uid"), score


def blend_check(members: DataFrame, own: str, tolerance: float = 0.02, most_rho: float = 0.80, least_gain: float = 0.008) -> DataFrame:
    """Whether a member is worth adding to the others: its own macro AUC, its rank correlation with the base blend and the gain.

    members: (member, uid, label, p, y), all on the same uids (see joins.in_all).
    """
    target = members.groupBy("uid", "label").agg(F.max("y").alias("y"))
    singles = macro(auc(members, ["member", "label"], "y", "p"), ["member"])
    base = blend.rank_mean(members.where(F.col("member") != own)).withColumn("p", F.round("p", 9))
    both = blend.rank_mean(members).withColumn("p", F.round("p", 9))
    score = lambda t, n: macro(auc(t.join(target, ["uid", "label"]), ["label"], "y", "p"), []).select(F.col("macro_auc").alias(n))
    mine = members.where(F.col("member") == own).select("uid", "label", F.col("p").alias("mine"))
    rho = spearman(base.join(mine, ["uid", "label"]), ["label"], "p", "mine").agg(F.avg("rho").alias("rho"))
    best = singles.agg(F.max(F.when(F.col("member") != own, F.col("macro_auc"))).alias("best"), F.max(F.when(F.col("member") == own, F.col("macro_auc"))).alias("own"))
    out = best.join(score(base, "base")).join(score(both, "blend")).join(rho)
    accepted = (F.col("own") >= F.col("best") - tolerance) & (F.col("rho") < most_rho) & (F.col("blend") - F.col("base") > least_gain)
    return out.select("own", "best", "base", "blend", "rho", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def marginal_value(members: DataFrame) -> DataFrame:
    """Per member: macro AUC of the blend of all, and of all but it."""
    target = members.groupBy("uid", "label").agg(F.max("y").alias("y"))
    names = [r.member for r in members.select("member").distinct().orderBy("member").collect()]  # an ensemble's members
    left_out = members.join(F.broadcast(members.sparkSession.createDataFrame([(a, b) for a in names for b in names if a != b], "without string, member string")), "member")
    ranked = with_rank(left_out, ["without", "member", "label"], "p", "r").groupBy("without", "uid", "label").agg(F.round(F.avg("r"), 9).alias("p"))
    rest = macro(auc(ranked.join(target, ["uid", "label"]), ["without", "label"], "y", "p"), ["without"])
    whole = macro(auc(blend.rank_mean(members).withColumn("p", F.round("p", 9)).join(target, ["uid", "label"]), ["label"], "y", "p"), []).select(F.col("macro_auc").alias("all"))
    return rest.join(F.broadcast(whole)).select(F.col("without").alias("member"), "all", F.col("macro_auc").alias("rest"), (F.col("all") - F.col("macro_auc")).alias("value"))


def pair_study(members: DataFrame, kind=None) -> DataFrame:
    """Each pair of members: mean rho over labels, macro AUC of their rank mean against the better one (gain)."""
    ranked = with_rank(members, ["member", "label"], "p", "r")
    a = ranked.select("uid", "label", "y", F.col("member").alias("a"), F.col("r").alias("x"))
    b = ranked.select("uid", "label", F.col("member").alias("b"), F.col("r").alias("z"))
    both = a.join(b, ["uid", "label"]).where("a < b").withColumn("m", F.round((F.col("x") + F.col("z")) / 2, 9))
    rho = spearman(both, ["a", "b", "label"], "x", "z").groupBy("a", "b").agg(F.avg("rho").alias("rho"))
    mean = macro(auc(both, ["a", "b", "label"], "y", "m"), ["a", "b"]).select("a", "b", F.col("macro_auc").alias("both"))
    one = macro(auc(members, ["member", "label"], "y", "p"), ["member"]).select("member", "macro_auc")
    out = rho.join(mean, ["a", "b"]).join(one.withColumnsRenamed({"member": "a", "macro_auc": "auc_a"}), "a").join(one.withColumnsRenamed({"member": "b", "macro_auc": "auc_b"}), "b")
    named = F.lit("pair") if kind is None else kind
    return out.select("a", "b", named.alias("kind"), "rho", "both", (F.col("both") - F.greatest("auc_a", "auc_b")).alias("gain"))


def _digits(text: str, n: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)


def unranked(rank: int, k: int) -> int:
    """The rank-th set of k bits in ascending order of its number, by the combinatorial number system."""
    mask = 0
    for left in range(k, 0, -1):
        bit = left - 1
        while comb(bit + 1, left) <= rank:
            bit += 1
        mask |= 1 << bit
        rank -= comb(bit, left)
    return mask


def random_subsets(n: int, count: int, least: int = 2, most: int = 7) -> dict[int, int]:
    """`count` draws of subsets of n members, as bits, and how often each was drawn: a size of `least` to `most` and a rank among
    the subsets of that size, both from md5 of the draw's number."""
    out: dict[int, int] = {}
    for t in range(count):
        k = least + _digits(f"size:{t}", 8) % (min(most, n) - least + 1)
        mask = unranked(_digits(f"rank:{t}", 12) % comb(n, k), k)
        out[mask] = out.get(mask, 0) + 1
    return out


def subset_study(members: DataFrame, count: int = 1500, least: int = 2, most: int = 7) -> DataFrame:
    """Random subsets of the members (member, uid, label, y, p): (mask, members, size, draws, rho, macro_auc, solo, gain).

    rho: the mean over the subset's pairs and the labels of their ranks' correlation; solo: the members' mean macro AUC; gain: that
    of the subset's rank mean above it. Bit i of the mask is the i-th member by name; 62 at most. A uid's ranks are one array, so
    each subset's mean is read off it and all correlations are sums of one pass; nothing is joined by uid.
    """
    names = [r.member for r in members.select("member").distinct().orderBy("member").collect()]
    drawn = random_subsets(len(names), count, least, most)
    ranked = with_rank(members, ["member", "label"], "p", "r")
    wide = once(ranked.groupBy("uid", "label").agg(F.max("y").alias("y"), F.array(*(F.max(F.when(F.col("member") == m, F.col("r"))) for m in names)).alias("r")))
    own = F.expr("filter(transform(r, (x, i) -> if(getbit(mask, i) = 1, x, null)), x -> x is not null)")
    mean = F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(own), F.lit(0)), 9)
    scored = wide.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in drawn)))).withColumn("m", mean)
    both = once(macro(auc(scored, ["mask", "label"], "y", "m"), ["mask"]).select("mask", "macro_auc"))

    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    per = wide.groupBy("label").agg(*(pearson(F.col("r")[i], F.col("r")[j]).alias(f"{i}_{j}") for i, j in pairs)).agg(*(F.avg(f"{i}_{j}").alias(f"{i}_{j}") for i, j in pairs)).first()
    solo = {r.member: r.macro_auc for r in macro(auc(members, ["member", "label"], "y", "p"), ["member"]).collect()}  # a row per member
    rows = []
    for mask, draws in drawn.items():
        inside = [i for i in range(len(names)) if mask >> i & 1]
        rho = [per[f"{i}_{j}"] for j in inside for i in inside if i < j and per[f"{i}_{j}"] is not None]
        alone = [solo[names[i]] for i in inside if solo[names[i]] is not None]
        rows.append((mask, ",".join(names[i] for i in inside), len(inside), draws, sum(rho) / len(rho) if rho else None, sum(alone) / len(alone) if alone else None))
    table = members.sparkSession.createDataFrame(rows, "mask long, members string, size int, draws int, rho double, solo double")
    return table.join(both, "mask").select("mask", "members", "size", "draws", "rho", "macro_auc", "solo", (F.col("macro_auc") - F.col("solo")).alias("gain"))


def subset_margins(study: DataFrame) -> DataFrame:
    """Per member: the mean macro AUC of the drawn subsets with it and without it, and the difference."""
    names = study.select(F.explode(F.split("members", ",")).alias("member")).distinct()
    met = study.withColumn("all", F.array_sort(F.lit(names.agg(F.collect_set("member")).first()[0])))
    each = met.select("macro_auc", "draws", F.split("members", ",").alias("own"), F.explode("all").alias("member")).withColumn("within", F.array_contains("own", F.col("member")))
    mean = lambda c: F.sum(F.when(c, F.col("macro_auc") * F.col("draws"))) / F.nullif(F.sum(F.when(c, F.col("draws"))), F.lit(0))
    out = each.groupBy("member").agg(mean(F.col("within")).alias("with"), mean(~F.col("within")).alias("without"))
    return out.withColumn("value", F.col("with") - F.col("without"))


def subset_model(study: DataFrame) -> DataFrame:
    """gain ~ 1, 1 - rho, ln(size) over the draws: coefficients and R squared."""
    rows = study.select("gain", (1 - F.col("rho")).alias("apart"), F.log("size").alias("ln_size"), F.explode(F.array_repeat(F.lit(0), F.col("draws").cast("int"))))
    return resample.ols(rows, "gain", ["apart", "ln_size"])


def submission(template: DataFrame, pred: DataFrame, least: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(uid, label) of the template with predictions or 0.5, and violations: low coverage, values out of range, constant labels."""
    filled = template.join(pred, ["uid", "label"], "left").withColumn("filled", F.col("p").isNull()).withColumn("p", F.coalesce("p", F.lit(0.5)))
    low = quality.low_coverage(pred.select("uid"), template.select("uid"), "uid", least).select(F.lit("coverage").alias("rule"), F.col("coverage").cast("string").alias("what"))
    bad = quality.out_of_range(filled, "p").select(F.lit("range").alias("rule"), F.concat_ws("/", "uid", "label").alias("what"))
    constant = filled.groupBy("label").agg((F.min("p") == F.max("p")).alias("c")).where("c").select(F.lit("constant").alias("rule"), F.col("label").alias("what"))
    return filled, low.unionByName(bad).unionByName(constant)


def board(private: DataFrame, public: DataFrame) -> DataFrame:
    """Private and public boards by team: ranks, rank within ties, gap."""
    from pyspark.sql import Window as W

    def placed(scores: DataFrame, name: str, row: bool) -> DataFrame:
        falling = scores.select("team", F.col("score").alias(name), F.lit(0).alias("_all"), (-F.col("score")).alias("_s"))
        at = ranks.rank_table(falling, ["_all"], "_s").select("_s", "before")
        out = falling.join(at, "_s").withColumn(f"{name}_rank", (F.col("before") + 1).cast("int"))
        if row:  # teams of one score in order
            out = out.withColumn(f"{name}_row", (F.col("before") + F.row_number().over(W.partitionBy("_s").orderBy("team"))).cast("int"))
        return out.drop("_all", "_s", "before")

    return placed(private, "private", True).join(placed(public, "public", False), "team", "left").withColumn("gap", F.col("private") - F.col("public"))


__all__ = ["blend_check", "board", "build_targets", "marginal_value", "pair_study", "random_subsets", "resample", "score_sources", "submission", "subset_margins", "subset_model", "subset_study"]
