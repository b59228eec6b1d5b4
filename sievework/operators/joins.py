"""Joins and set operations with the reports and guards that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.operators import quality
from sievework.sources.shared import once


def reindex(index: DataFrame, table: DataFrame, on: str = "uid") -> DataFrame:
    """The table's rows for each key of the index, null where there is none."""
    return index.join(table, on, "left")


def coverage(a: DataFrame, b: DataFrame, on: str = "uid") -> DataFrame:
    """Keys in both and on one side only."""
    keys = a.select(on).distinct().withColumn("_a", F.lit(1)).join(b.select(on).distinct().withColumn("_b", F.lit(1)), on, "full")
    return keys.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def fill_template(template: DataFrame, pred: DataFrame, on: list[str], value: str, neutral: float = 0.5) -> DataFrame:
    """The template's rows with predictions, missing ones neutral and marked `filled`."""
    return template.join(pred, on, "left").withColumn("filled", F.col(value).isNull()).withColumn(value, F.coalesce(value, F.lit(neutral)))


def in_all(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Keys that every member has."""
    n = rows.agg(F.count_distinct(member).alias("_n"))
    return rows.groupBy(key).agg(F.count_distinct(member).alias("_has")).join(F.broadcast(n)).where("_has = _n").select(key)


def union_complete(parts: DataFrame, uid: str, priority: str, file: str, complete: str) -> DataFrame:
    """One row per uid of rows that are complete: lowest priority number, then first file."""
    w = W.partitionBy(uid).orderBy(priority, file)
    return parts.where(complete).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_cohort(base: DataFrame, extra: DataFrame, imaged: DataFrame, on: str = "uid", least: float = 0.0, same_columns: bool = False, use: bool = True) -> DataFrame:
    """Rows of another cohort, only where imaged: fold -1 and not gold, with null in columns that it lacks.

    least: the share of the cohort's rows that must be imaged, else an error; same_columns: a column that only one side has
    (but for fold and is_gold) is an error; use: False gives the base alone.
    """
    if not use:
        return base
    own = {"fold", "is_gold"}
    if same_columns and (odd := (set(base.columns) ^ set(extra.columns)) - own):
        raise quality.DataError(f"columns of one side only: {sorted(odd)}")
    rows = extra.join(imaged.select(on), on, "left_semi").withColumns({"fold": F.lit(-1), "is_gold": F.lit(False)})
    if least > 0:
        have, all_ = rows.count(), extra.count()
        if have < least * all_:
            raise quality.DataError(f"only {have} of {all_} rows of the cohort are imaged")
    return base.unionByName(rows, allowMissingColumns=True)


def pairs(members: DataFrame, value: str, unit: list[str], member: str = "member") -> DataFrame:
    """Each pair of members, named in order, on the same unit."""
    a = members.select(*unit, F.col(member).alias("a"), F.col(value).alias("x"))
    b = members.select(*unit, F.col(member).alias("b"), F.col(value).alias("y"))
    return a.join(b, unit).where("a < b")


def combinations_missing(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of the values of two columns, how often each occurs, 0 included; the columns must have few values."""
    left, right = rows.select(a).distinct(), rows.select(b).distinct()
    have = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return left.crossJoin(F.broadcast(right)).join(have, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def place_in_slots(positions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Slot of each position by cumulative budgets (slot, ord, size; few rows), and the place inside the slot, 0 to 1."""
    end = F.sum("size").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    bounds = budgets.withColumn("stop", end).withColumn("start", F.col("stop") - F.col("size"))
    found = positions.join(F.broadcast(bounds), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop")))
    inside = F.when(F.col("size") > 1, (F.col("pos") - F.col("start")) / F.nullif(F.col("size") - 1, F.lit(0))).otherwise(0.0)
    return found.withColumn("inside", inside)


def merge_evidence(lines: DataFrame, schema: str, uid: str) -> DataFrame:
    """One record per id of JSON lines (file, at, line): clean ones before those with an error, then the last file and line."""
    parsed = lines.withColumn("r", F.from_json("line", schema)).where(F.col(f"r.{uid}").isNotNull())
    clean = F.col("r.error").isNull().cast("int")
    return parsed.groupBy(F.col(f"r.{uid}").alias(uid)).agg(F.max_by("r", F.struct(clean.alias("clean"), "file", "at")).alias("r"))


def unreadable(lines: DataFrame, schema: str, uid: str) -> DataFrame:
    return lines.agg(F.count_if(F.from_json("line", schema)[uid].isNull()).alias("unreadable"))


def search_merge(hits: DataFrame, forum: str) -> DataFrame:
    """First hit per topic of one forum, by votes."""
    w = W.partitionBy("topic").orderBy("page", "at")
    return hits.where(F.col("forum") == forum).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("votes"), "topic")


def reply_tree(comments: DataFrame) -> DataFrame:
    """(id, parent, topic) to depth and a path that sorts depth first. Comments whose chain of parents doesn't end at a root are
    left out, as are those of a parent that isn't there.

    Each round every comment takes over what its furthest known ancestor knows, so a thread of depth n takes log2(n) rounds.
    Each round ends some chain while there is one that ends; when none does, what is left goes round in circles.
    """
    padded = F.lpad(F.col("id").cast("string"), 20, "0")
    now = once(comments.select("id", "parent", "topic", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), padded.alias("path")))
    before = -1
    while True:
        open_ = now.where("up is not null")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.concat("path", F.lit("/")).alias("_path"))
        left = open_.count()
        if left in (0, before):
            break
        before = left
        moved = open_.join(above, "up").select("id", "parent", "topic", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", "path").alias("path"))
        now = once(now.where("up is null").unionByName(moved))
    return now.where("up is null").select("id", "parent", "topic", "depth", "path")


def with_dimension(rows: DataFrame, dimension: DataFrame, on: str, columns: list[str], limit: int = 1_000_000) -> DataFrame:
    """Adds columns of a dimension with one row per key, null where the key isn't known. It is broadcast only up to `limit` rows."""
    quality.require(quality.duplicates(dimension, [on]), f"keys of the dimension repeat: {on}")
    small = dimension.select(on, *columns)
    return rows.join(F.broadcast(small) if small.limit(limit + 1).count() <= limit else small, on, "left")
