"""Writes that are checked: metrics are observed in the write's own job, and only what passes becomes visible.

A rule is an aggregate over the rows as they are written. No rule needs a job of its own; a failed one removes what was written,
names the rule and leaves the table at the path as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.operators.quality import DataError


@dataclass(frozen=True)
class Rule:
    name: str
    metric: Column
    holds: Callable[[Any], bool]


def none(name: str, where: Column) -> Rule:
    """No row may meet the condition."""
    return Rule(name, F.count_if(where), lambda n: n == 0)


def exactly(name: str, metric: Column, wanted: Any) -> Rule:
    return Rule(name, metric, lambda n: n == wanted)


def at_least(name: str, metric: Column, least: float) -> Rule:
    return Rule(name, metric, lambda x: x is not None and x >= least)


def times(df: DataFrame, keys: list[str], name: str = "_times") -> DataFrame:
    """Adds how often the row's keys occur: for `none(..., F.col("_times") > 1)`."""
    return df.withColumn(name, F.count("*").over(W.partitionBy(*keys)))


def write(df: DataFrame, path: str, rules: list[Rule], drop: list[str] | None = None, keep: Column | None = None) -> dict[str, Any]:
    """Writes df as Parquet to path, replacing what is there, if all rules hold; their metrics. Else DataError.

    keep: rows that are written; the rules see the others too. drop: columns that only the rules need.
    """
    spark, seen, aside = df.sparkSession, Observation(), f"{path}.unchecked-{uuid.uuid4().hex}"
    out = df.observe(seen, *(r.metric.alias(r.name) for r in rules)) if rules else df
    out = out if keep is None else out.where(keep)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    written, target = fs_path(aside), fs_path(path)
    fs = written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out.drop(*(drop or [])).write.parquet(aside)
        found = dict(seen.get) if rules else {}
        failed = [f"{r.name} = {found[r.name]}" for r in rules if not r.holds(found[r.name])]
        if failed:
            raise DataError(f"{path}: {'; '.join(failed)}")
        fs.delete(target, True)
        if not fs.rename(written, target):
            raise OSError(f"could not rename to {path}")
        return found
    finally:
        fs.delete(written, True)


def merge_runs(prior: DataFrame, new: DataFrame, path: str, complete: Column, uid: str = "uid") -> dict[str, Any]:
    """The complete rows of an earlier run and of this one as one table; a uid that is in both, or twice in one, is an error."""
    rows = prior.where(complete).unionByName(new.where(complete))
    return write(times(rows, [uid]), path, [none("repeated", F.col("_times") > 1), Rule("rows", F.count("*"), lambda n: True)], ["_times"])


def append_cohort(base: DataFrame, extra: DataFrame, imaged: DataFrame, path: str, uid: str = "uid", least: float = 0.95, weights: list[str] | None = None) -> dict[str, Any]:
    """The base and the rows of another cohort that are imaged, fold -1 and not gold, as one table.

    Errors: columns of one side only (but for fold and is_gold), a share of the cohort below `least` that is imaged, a uid twice,
    and, with `weights`, a row of the cohort without any positive weight.
    """
    own = {"fold", "is_gold"}
    if odd := (set(base.columns) ^ set(extra.columns)) - own:
        raise DataError(f"columns of one side only: {sorted(odd)}")
    flag = imaged.select(F.col(uid).alias("_uid")).distinct().withColumn("_imaged", F.lit(True))
    rows = extra.drop(*own).join(flag, F.col(uid) == F.col("_uid"), "left").drop("_uid").withColumns({"fold": F.lit(-1), "is_gold": F.lit(False), "_cohort": F.lit(True), "_imaged": F.coalesce("_imaged", F.lit(False))})
    both = base.withColumns({"_cohort": F.lit(False), "_imaged": F.lit(True)}).unionByName(rows, allowMissingColumns=True)
    used = F.col("_cohort") & F.col("_imaged")
    rules = [at_least("imaged_share", F.avg(F.when(F.col("_cohort"), F.col("_imaged").cast("double"))), least), none("repeated", F.col("_imaged") & (F.col("_times") > 1)), Rule("appended", F.count_if(used), lambda n: n > 0)]
    if weights:
        total = sum((F.coalesce(F.col(f"`{w}`"), F.lit(0.0)) for w in weights), F.lit(0.0))
        rules.append(none("without_weight", used & (total <= 0)))
    # Cohort rows that aren't imaged don't count as repeats.
    return write(times(both, [uid, "_imaged"]), path, rules, ["_cohort", "_imaged", "_times"], keep=F.col("_imaged"))


def _is(name: str, fold: int) -> Callable[[Column], Column]:
    return lambda x: (x["set"] == name) & (x["fold"] == fold)


def distillation(sets: dict[str, DataFrame], path: str, folds: int | None = None, uids: int | None = None, per_fold_rank: bool = False) -> dict[str, Any]:
    """Out-of-fold sets (fold, uid, label, p) to the table (uid, label, p): per set percentile ranks within each label, within each fold
    first if `per_fold_rank`, and their mean over the sets.

    Errors: a uid in more than one fold of a set, sets that cover different uids or labels, a null prediction, folds other than
    0 to folds - 1 or one of these missing in a set, and a number of uids other than `uids`.
    """
    from sievework.functions.ranks import with_rank

    rows = None
    for name, df in sets.items():
        one = df.select(F.lit(name).alias("set"), F.col("fold").cast("int").alias("fold"), "uid", "label", "p")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise DataError("no sets")
    ranked = with_rank(rows, ["set", "fold", "label"], "p", "_p") if per_fold_rank else rows.withColumn("_p", F.col("p"))
    ranked = with_rank(ranked, ["set", "label"], "_p", "_r")
    per = ranked.groupBy("uid", "label").agg(F.avg("_r").alias("p"), F.count("*").alias("_cells"), F.count("_r").alias("_known"), F.collect_set("set").alias("_sets"), F.collect_set(F.struct("set", "fold")).alias("_folds"))
    per = per.withColumn("_first", F.col("label") == F.min("label").over(W.partitionBy("uid")))  # one row a uid
    rules = [none("repeated", F.col("_cells") > F.size("_sets")), none("uncovered", F.size("_sets") < len(sets)), none("unknown", F.col("_known") < F.col("_cells"))]
    if uids is not None:
        rules.append(exactly("uids", F.count_if("_first"), uids))
    if folds is not None:
        rules.append(none("other_folds", F.exists("_folds", lambda x: x["fold"].isNull() | (x["fold"] < 0) | (x["fold"] >= folds))))
        for k, name in enumerate(sets):
            rules += [at_least(f"set{k}_fold{i}", F.count_if(F.exists("_folds", _is(name, i))), 1) for i in range(folds)]
    return write(per, path, rules, ["_sets", "_folds", "_known", "_cells", "_first"])
