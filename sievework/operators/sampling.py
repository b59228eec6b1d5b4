"""Windows, quotas, trimming and pooling within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def centres(slots: DataFrame, count: str = "n") -> DataFrame:
    """The middle places 1 .. n - 2 of each slot with at least three slices."""
    return slots.where(F.col(count) >= 3).withColumn("centre", F.explode(F.sequence(F.lit(1), F.col(count) - 2)))


def equidistant(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """n rows per keys at equal distances (all if there are fewer)."""
    w = W.partitionBy(*keys)
    total, at = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(k * (F.col("_n") - 1) / max(n - 1, 1)))
    return rows.withColumns({"_n": total, "_at": at}).where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_at").cast("double"))).drop("_n", "_at")


def stratified(rows: DataFrame, keys: list[str], slot: str, uid: str, n: int, least: int = 2, seed: str = "s") -> DataFrame:
    """n rows per keys in hash order: first up to `least` per slot, then from all."""
    h = F.md5(F.concat(F.lit(seed), F.col(uid).cast("string")).cast("binary"))
    hashed = rows.withColumn("_h", h)
    first = F.row_number().over(W.partitionBy(*keys, slot).orderBy("_h")) <= least
    ranked = hashed.withColumn("_first", first.cast("int")).withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_first"), "_h")))
    return ranked.where(F.col("_k") <= n).drop("_h", "_first", "_k")


def trim_ends(windows: DataFrame, keys: list[str], centre: str, count: str, k: int, long: int = 20) -> DataFrame:
    """In groups of at least `long` slices, only windows (centre and both neighbours) that keep k from both ends; a group
    that would lose all keeps its middle one."""
    w = W.partitionBy(*keys)
    ok = (F.col(count) < long) | ((F.col(centre) - 1 >= k) & (F.col(centre) + 1 <= F.col(count) - 1 - k))
    rows = windows.withColumn("_ok", ok).withColumns({"_any": F.max("_ok").over(w), "_at": F.row_number().over(w.orderBy(centre)) - 1, "_n": F.count("*").over(w)})
    return rows.where(F.col("_ok") | (~F.col("_any") & (F.col("_at") == F.floor(F.col("_n") / 2)))).drop("_ok", "_any", "_at", "_n")


def drop_blank(windows: DataFrame, keys: list[str], centre: str, brightness: str, share: float, least: int = 2) -> DataFrame:
    """Windows not below share x the group's median brightness; where fewer than `least` are left, the brightest ones too."""
    w = W.partitionBy(*keys)
    median = windows.groupBy(*keys).agg(F.median(brightness).alias("_m"))
    rows = windows.join(median, keys).withColumn("_ok", F.col(brightness) >= share * F.col("_m"))
    rows = rows.withColumns({"_left": F.sum(F.col("_ok").cast("int")).over(w), "_r": F.row_number().over(w.orderBy(F.desc(brightness), centre))})
    return rows.where(F.col("_ok") | ((F.col("_left") < least) & (F.col("_r") <= least))).drop("_m", "_ok", "_left", "_r")


def allocate(slots: DataFrame, uid: str, slot: str, capacity: str, share: str, target: int) -> DataFrame:
    """(uid, slot, quota): largest remainders of target x share, cut to the capacities; what is cut goes round robin by share to
    those with room, each turn to the slot that is owed most (the first in order of equals).

    A uid's few slots are one array, over which the turns are folded. Null capacities and shares are 0; where all shares are 0
    they are equal.
    """
    own = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.coalesce(F.col(capacity).cast("int"), F.lit(0)).alias("cap"), F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    count = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    t = slots.groupBy(uid).agg(own.alias("v")).withColumn("s", F.transform("v", lambda x: x["share"]))
    t = t.withColumn("s", F.when(total(F.col("s")) > 0, F.col("s")).otherwise(F.transform("s", lambda x: F.lit(1.0)))).withColumn("_sum", total(F.col("s")))
    t = t.withColumn("ideal", F.transform("s", lambda x: target * x / F.col("_sum"))).withColumn("base", F.transform("ideal", lambda x: F.floor(x).cast("int")))
    t = t.withColumn("rest", F.zip_with("ideal", "base", lambda x, y: x - y))
    # A remainder's place among all: the larger ones, and the equal ones before it.
    ahead = lambda x, i: F.size(F.filter(F.transform("rest", lambda y, j: (y > x) | ((y == x) & (j < i))), lambda z: z))
    t = t.withColumn("more", F.transform("rest", lambda x, i: (ahead(x, i) < target - count(F.col("base"))).cast("int")))
    t = t.withColumn("caps", F.transform("v", lambda x: x["cap"]))
    first = F.zip_with(F.zip_with("base", "more", lambda x, y: x + y), "caps", lambda q, c: F.least(q, c))
    t = t.withColumn("out", first).withColumn("left", F.least(F.lit(target), count(F.col("caps"))) - count(F.col("out")))

    def turn(acc: Column, _: Column) -> Column:
        room = F.zip_with(acc["out"], F.col("caps"), lambda q, c: q < c)
        weight = total(F.zip_with(room, F.col("s"), lambda r, x: F.when(r, x).otherwise(0.0)))
        due = F.zip_with(acc["owed"], F.zip_with(room, F.col("s"), lambda r, x: F.when(r, F.coalesce(x / F.nullif(weight, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)), lambda o, x: o + x)
        # The open slot that is owed most.
        best = F.array_max(F.filter(F.transform(due, lambda o, i: F.struct(o.alias("o"), (-i).alias("i"), room[i].alias("r"))), lambda x: x["r"]))["i"]
        return F.struct(F.transform(acc["out"], lambda q, i: q + F.when(i == -best, 1).otherwise(0)).alias("out"), F.transform(due, lambda o, i: o - F.when(i == -best, 1.0).otherwise(0.0)).alias("owed"))

    start = F.struct(F.col("out"), F.transform("out", lambda q: F.lit(0.0)).alias("owed"))
    turns = F.when(F.col("left") > 0, F.sequence(F.lit(1), F.greatest(F.col("left"), F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    done = t.withColumn("out", F.aggregate(turns, start, turn)["out"])
    return done.select(uid, F.explode(F.arrays_zip("v", "out")).alias("z")).select(uid, F.col("z.v.slot").alias(slot), F.col("z.out").alias("quota"))


def pool_views(views: DataFrame, keys: list[str], p: str, beta: float = 8.0) -> DataFrame:
    """Per keys: mean, max, mean of the best two and three, mean in logits, softmax-weighted mean."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    top = F.slice(F.sort_array(F.collect_list(p), asc=False), 1, 3)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    out = views.where(F.col(p).isNotNull()).groupBy(*keys).agg(
        F.avg(p).alias("mean"), F.max(p).alias("max"), top.alias("_top"), F.avg(F.log(q / (1 - q))).alias("_logit"), (F.sum(F.exp(beta * F.col(p)) * F.col(p)) / F.sum(F.exp(beta * F.col(p)))).alias("softmax")
    )
    return out.withColumns({"top2": mean(F.slice("_top", 1, 2)), "top3": mean(F.col("_top")), "logit": 1 / (1 + F.exp(-F.col("_logit")))}).drop("_top", "_logit")


def robust_scale(rows: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99, least: float = 1e-6) -> DataFrame:
    """Adds `scaled`: clipped to the group's percentiles and brought to [0, 1]."""
    q = rows.groupBy(*keys).agg(F.expr(f"percentile({value}, array({low}, {high}))").alias("_q"))
    joined = rows.join(q, keys)
    clipped = F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(value)))
    return joined.withColumn("scaled", (clipped - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(least))).drop("_q")


def smoke(rows: DataFrame, uid: str, n: int) -> DataFrame:
    """All rows of the first n uids: for trial runs, whose outputs must bear another name."""
    first = rows.select(uid).distinct().orderBy(uid).limit(n)
    return rows.join(first, uid, "left_semi")


def best_candidate(tables: DataFrame, valid: str, score: list[str], name: str) -> DataFrame:
    """The valid candidate with the largest tuple of scores, the smallest name of equals."""
    order = F.struct(*(F.col(s).alias(f"s{i}") for i, s in enumerate(score)))
    top = tables.where(valid).withColumn("_s", order).groupBy("_s").agg(F.min(name).alias(name))
    return top.orderBy(F.desc("_s")).limit(1).select(name, "_s.*")
