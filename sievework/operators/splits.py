"""Leak-safe folds, shards and blocks."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.ranks import running_total


def group_sizes(rows: DataFrame) -> DataFrame:
    """(group, n, gold) of rows with `group` and `is_gold`."""
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("is_gold").cast("int")).alias("gold"))


def shared_groups(groups: DataFrame) -> DataFrame:
    """How many groups hold several rows, how many rows those are, and the largest."""
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("covered"), F.max("n").alias("largest"))


def _walk(classes: list[tuple[int, int, int]], folds: int) -> list[tuple[int, ...]]:
    """(gold, n, fold, count, gold and rows of the fold before): how many groups of each class go to each fold.

    All groups of a class add the same to a fold, so placing them one by one in the fold that is least full means: the k-th
    group goes to the k-th smallest of (fullness + j * addition, fold) over folds and j. The number per fold is found by
    bisection on that key; nothing is done per group.
    """
    size, golds, out = [0] * folds, [0] * folds, []
    for gold, n, count in classes:
        start = [(golds[f], size[f]) if gold else (0, size[f]) for f in range(folds)]
        key = lambda f, j: (start[f][0] + j * gold, start[f][1] + j * n, f)

        def up_to(limit: tuple, f: int) -> int:
            return bisect.bisect_right(range(count), limit, key=lambda j: key(f, j))

        # The smallest key of some fold below which `count` placements lie.
        best = None
        for f in range(folds):
            j = bisect.bisect_left(range(count), count, key=lambda j, f=f: sum(up_to(key(f, j), g) for g in range(folds)))
            if j < count and (best is None or key(f, j) < best):
                best = key(f, j)
        counts = [up_to(best, f) for f in range(folds)]
        for f in range(folds):
            out.append((gold, n, f, counts[f], start[f][0], start[f][1]))
            size[f] += counts[f] * n
            golds[f] += counts[f] * gold
    return out


def assign_folds(groups: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, n, gold) to (group, fold): groups with most gold first, then larger ones; gold groups go to the fold with
    least gold, then least rows, others to the fold with least rows; the lowest fold of equals.

    Only the table of classes (gold, n, count) reaches the driver: it has as many rows as there are different pairs.
    Which group of a class comes first is decided by a hash with the seed.
    """
    spark = groups.sparkSession
    classes = [tuple(r) for r in groups.groupBy("gold", "n").agg(F.count("*").alias("count")).orderBy(F.desc("gold"), F.desc("n")).collect()]
    placed = [x for x in _walk(classes, folds) if x[3]]
    # Which groups of a class go to which fold is free: consecutive numbers per fold.
    ranges, upto = [], {}
    for gold, n, fold, count, *_ in placed:
        first = upto.get((gold, n), 0)
        ranges.append((gold, n, fold, first, first + count))
        upto[gold, n] = first + count
    plan = spark.createDataFrame(ranges, "gold long, n long, fold int, first long, stop long")
    named = groups.select("group", "gold", "n", F.concat(F.md5(F.concat(F.lit(f"{seed}"), F.col("group").cast("string")).cast("binary")), F.col("group").cast("string")).alias("h"))
    ranked = _numbered(named, ["gold", "n"], "h")
    return ranked.join(F.broadcast(plan), ["gold", "n"]).where("k >= first and k < stop").select("group", "fold", "n", "gold")


def _numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds k, the number of a row within keys from 0; order is a hexadecimal string, dealt to buckets by its first digits."""
    bucketed = df.withColumn("_b", F.conv(F.substring(order, 1, 2), 16, 10).cast("int"))
    sums = bucketed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    first = sums.select(*keys, "_b", F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1
    return bucketed.join(first, [*keys, "_b"]).withColumn("k", (inside + F.col("_first")).cast("long")).drop("_b", "_first", order)


def folds_span(rows: DataFrame) -> DataFrame:
    """Groups that lie in more than one fold: must be empty."""
    return rows.groupBy("group").agg(F.count_distinct("fold").alias("folds")).where("folds > 1")


def split(rows: DataFrame, mode: str, fold: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows: 'fold' (one fold held out), 'train_all' (nothing held out), 'train_gold' (gold held out)."""
    if mode == "fold":
        return rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
    if mode == "train_all":
        return rows, rows.limit(0)
    if mode == "train_gold":
        return rows.where(~F.col("is_gold")), rows.where("is_gold")
    raise ValueError(f"unknown split {mode!r}")


def person_overlap(rows: DataFrame) -> DataFrame:
    """People (person, split, uid): how many there are, with several uids, uids of those, the most, and people in both splits."""
    per = rows.where(F.col("person").isNotNull() & (F.col("person") != "")).groupBy("person").agg(F.count_distinct("uid").alias("n"), F.count_distinct("split").alias("splits"))
    return per.agg(
        F.count("*").alias("people"), F.count_if(F.col("n") > 1).alias("several"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_several"), F.max("n").alias("most"), F.count_if(F.col("splits") > 1).alias("in_both")
    )


def blocks(rows: DataFrame, shard: str, uid: str, size: int = 64) -> DataFrame:
    """Adds (blob, row): uids in order within their shard, `size` to a block."""
    at = F.row_number().over(W.partitionBy(shard).orderBy(uid)) - 1
    return rows.withColumn("_at", at).withColumns({"blob": F.floor(F.col("_at") / size).cast("int"), "row": (F.col("_at") % size).cast("int")}).drop("_at")


def block_state(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(shard, blob) with expected and present rows, and whether the block is complete."""
    e = expected.groupBy("shard", "blob").agg(F.count("*").alias("expected"))
    p = present.groupBy("shard", "blob").agg(F.count("*").alias("present"))
    both = e.join(p, ["shard", "blob"], "full").withColumns({"expected": F.coalesce("expected", F.lit(0)), "present": F.coalesce("present", F.lit(0))})
    return both.withColumn("complete", (F.col("expected") == F.col("present")) & (F.col("expected") > 0))


def strided(rows: DataFrame, uid: str, n: int) -> DataFrame:
    """Adds shard = position modulo n, by the order of uid (unique)."""
    counted = running_total(rows.select(uid, F.lit(1).alias("one"), F.lit(0).alias("all")), ["all"], uid, ["one"])
    return rows.join(counted.select(uid, (F.col("one_before") % n).cast("int").alias("shard")), uid)


def chunks(rows: DataFrame, uid: str, size: int, least: int = 4) -> DataFrame:
    """Adds `chunk`: consecutive near-equal parts of at most `size` rows, at least `least` parts, bounds at rint(i * n / k)."""
    counted = running_total(rows.select(uid, F.lit(1).alias("one"), F.lit(0).alias("all")), ["all"], uid, ["one"])
    n, at = F.col("one_total"), F.col("one_before")
    k = F.least(n, F.greatest(F.lit(least), F.ceil(n / size)))
    guess = F.floor(at * k / n)
    chunk = F.when(at >= F.rint((guess + 1) * n / k), guess + 1).when(at < F.rint(guess * n / k), guess - 1).otherwise(guess)
    return rows.join(counted.select(uid, chunk.cast("int").alias("chunk")), uid)


def balanced(rows: DataFrame, uid: str, cost: str, n: int) -> DataFrame:
    """Adds (worker, turn): by falling cost dealt round robin to n workers, each taking its even places before the odd ones."""
    costs = rows.groupBy(F.lit(0).alias("all"), (-F.col(cost)).alias("_c")).agg(F.count("*").alias("one"))
    before = running_total(costs, ["all"], "_c", ["one"]).select("_c", "one_before")
    tie = F.row_number().over(W.partitionBy("_c").orderBy(uid)) - 1
    place = rows.select(uid, (-F.col(cost)).alias("_c")).withColumn("_t", tie).join(before, "_c").select(uid, (F.col("one_before") + F.col("_t")).alias("p"))
    # A worker's c places own = 0 .. c - 1: the even ones are its first ceil(c / 2) turns, in order.
    own, worker = F.floor(F.col("p") / n), F.col("p") % n
    has = F.ceil((F.lit(rows.count()) - worker) / n)
    turn = F.when(own % 2 == 0, own / 2).otherwise(F.ceil(has / 2) + (own - 1) / 2)
    dealt = place.withColumns({"worker": worker.cast("int"), "turn": turn.cast("int")})
    return rows.join(dealt.select(uid, "worker", "turn"), uid)
