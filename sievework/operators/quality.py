"""Data checks as violation tables: an empty table is a pass; `require` raises otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    pass


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    """Raises if there is a violation; names a few."""
    some = violations.limit(show).collect()
    if some:
        raise DataError(f"{what}: {[r.asDict() for r in some]}")


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def same_order(df: DataFrame, wanted: list[str]) -> bool:
    return [c for c in df.columns if c in set(wanted)] == wanted


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows whose value isn't a finite number of the range; null is left to other checks."""
    v = F.col(value)
    return df.where(v.isNotNull() & (F.isnan(v) | (v < low) | (v > high)))


def weight_rules(df: DataFrame, supervised: Column) -> DataFrame:
    """Violations of long (uid, label, w): weights other than 0 and 1, weight on labels without supervision, uids without any."""
    bad = df.where(~F.col("w").isin(0, 1)).select("uid", "label", F.lit("weight not 0 or 1").alias("rule"))
    stray = df.where(~supervised & (F.col("w") > 0)).select("uid", "label", F.lit("weight without supervision").alias("rule"))
    empty = df.groupBy("uid").agg(F.sum("w").alias("t")).where("t = 0").select("uid", F.lit(None).cast("string").alias("label"), F.lit("no supervised cell").alias("rule"))
    return bad.unionByName(stray).unionByName(empty)


def counts(df: DataFrame, uid: str, rows: int | None = None, uids: int | None = None) -> DataFrame:
    """Expected against found numbers, only where they differ."""
    got = df.agg(F.count("*").alias("rows"), F.count_distinct(uid).alias("uids")).unpivot([], ["rows", "uids"], "what", "found")
    expected = F.when(F.col("what") == "rows", F.lit(rows)).otherwise(F.lit(uids))
    return got.withColumn("expected", expected).where("expected is not null and expected <> found")


def low_coverage(found: DataFrame, wanted: DataFrame, on: str, least: float) -> DataFrame:
    """One row if a smaller share than `least` of the wanted keys is found."""
    have = wanted.select(on).distinct().join(found.select(on).distinct().withColumn("_f", F.lit(1)), on, "left")
    return have.agg(F.avg(F.coalesce("_f", F.lit(0))).alias("coverage")).where(F.col("coverage") < least)


def gold_in_training(train: DataFrame, gold: DataFrame, on: str = "uid") -> DataFrame:
    return train.join(gold.select(on), on, "left_semi").select(on)


def rank_floor(rho: DataFrame, mean_floor: float, min_floor: float) -> DataFrame:
    """One row if correlations per label are too low on average or in one label, or unknown."""
    s = rho.agg(F.avg("rho").alias("mean"), F.min("rho").alias("least"), F.count_if(F.col("rho").isNull()).alias("unknown"))
    return s.where((F.col("unknown") > 0) | F.col("mean").isNull() | (F.col("mean") < mean_floor) | (F.col("least") < min_floor))


def sets_differ(rows: DataFrame, part: str, uid: str) -> DataFrame:
    """uids that some part lacks: each part must hold the same set."""
    n = rows.agg(F.count_distinct(part).alias("parts"))
    return rows.groupBy(uid).agg(F.count_distinct(part).alias("has")).join(F.broadcast(n)).where("has <> parts")


def unlike_log(found: DataFrame, logged: DataFrame, on: list[str], value: str, tolerance: float = 5e-4) -> DataFrame:
    """Metrics that differ from the logged ones, or that one side lacks."""
    both = found.select(*on, F.col(value).alias("found")).join(logged.select(*on, F.col(value).alias("logged")), on, "full")
    return both.where(F.col("found").isNull() | F.col("logged").isNull() | (F.abs(F.col("found") - F.col("logged")) > tolerance))


def mostly_constant(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row if more than half of the columns (values of `key`) are constant."""
    per = df.groupBy(key).agg((F.min(value) == F.max(value)).alias("constant"))
    return per.agg(F.count_if("constant").alias("constant"), F.count("*").alias("columns")).where("constant * 2 > columns")


def too_many_failed(df: DataFrame, failed: Column, least: int, share: float, small: int = 0) -> DataFrame:
    """One row if more rows failed than max(least, ceil(share * n)); tables of at most `small` rows may have none."""
    s = df.agg(F.count_if(failed).alias("failed"), F.count("*").alias("n"))
    allowed = F.when(F.col("n") <= small, 0).otherwise(F.greatest(F.lit(least), F.ceil(F.col("n") * share)))
    return s.withColumn("allowed", allowed).where("failed > allowed")
