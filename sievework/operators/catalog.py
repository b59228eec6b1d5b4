"""Catalogue of entities with bags of child records: header facts, slot selection, sides and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions.text import md5_shard


def header_scan(headers: DataFrame, series: str = "series", file: str = "file", parsable: str = "ok", first: int = 5) -> DataFrame:
    """The first parsable of the first few files by name of each series, and the number of its files."""
    w = W.partitionBy(series)
    numbered = headers.withColumns({"_n": F.row_number().over(w.orderBy(file)), "n_slices": F.count("*").over(w)})
    near = numbered.where((F.col("_n") <= first) & F.col(parsable))
    return near.withColumn("_k", F.row_number().over(w.orderBy("_n"))).where("_k = 1").drop("_n", "_k")


def mode_of(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """The most frequent value that isn't null, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name or value), F.max("_n").alias("votes"))


def side(series: DataFrame, uid: str = "uid", tag: str = "tag", centre: str = "centre_x", dead_zone: float = 20.0) -> DataFrame:
    """(uid, side, tag, geo, conflict): majority of the tags L and R, else the median centre beyond a dead zone; '' where
    both are known and differ."""
    counts = series.groupBy(uid).agg(F.count_if(F.col(tag) == "L").alias("l"), F.count_if(F.col(tag) == "R").alias("r"), F.expr(f"percentile({centre}, 0.5)").alias("median"))
    tagged = F.when(F.greatest("l", "r") == 0, "").when(F.col("l") >= F.col("r"), "L").otherwise("R")
    geo = F.when(F.col("median") > dead_zone, "L").when(F.col("median") < -dead_zone, "R").otherwise("")
    out = counts.select(uid, tagged.alias("tag"), geo.alias("geo"))
    clash = (F.col("tag") != "") & (F.col("geo") != "") & (F.col("tag") != F.col("geo"))
    return out.select(uid, F.when(clash, "").when(F.col("tag") != "", F.col("tag")).otherwise(F.col("geo")).alias("side"), "tag", "geo", clash.cast("int").alias("conflict"))


def profile(series: DataFrame, uid: str, medians: dict[str, Column], flags: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """Per uid: medians, any-flags, and sorted distinct values joined by ';'."""
    aggs = [F.median(c).alias(n) for n, c in medians.items()]
    aggs += [F.max(c.cast("int")).alias(n) for n, c in flags.items()]
    aggs += [F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ";").alias(n) for n, c in lists.items()]
    return series.groupBy(uid).agg(*aggs)


#: A slot: its name, plane, and the strict and the relaxed condition as SQL over a series `r` (plane, fluid, fat_sat,
#: weighting). The six below are fixed values.
Slot = tuple[str, str, str, str]
SLOTS: tuple[Slot, ...] = (
    ("SAG_FLUID_FS", "Sagittal", "r.fluid and r.fat_sat", "r.fluid"),
    ("COR_FLUID_FS", "Coronal", "r.fluid and r.fat_sat", "r.fluid"),
    ("AX_FLUID_FS", "Axial", "r.fluid and r.fat_sat", "r.fluid"),
    ("SAG_FLUID_NOFS", "Sagittal", "r.fluid and not r.fat_sat", "r.fluid"),
    ("COR_T1", "Coronal", "r.weighting = 'T1'", "not r.fluid"),
    ("SAG_T1", "Sagittal", "r.weighting = 'T1'", "not r.fluid"),
)


def select_slots(series: DataFrame, uid: str = "uid", slots: tuple[Slot, ...] = SLOTS, wanted: int = 32, reuse: bool = False) -> DataFrame:
    """(uid, slots map<slot, series>): for the strict conditions, then for the relaxed ones, each slot in order that is still
    empty takes the unused series of its plane and condition whose n_slices is nearest to `wanted`, the first of equals.

    series: uid, ord (input order), series, plane, fluid, fat_sat, weighting, n_slices. One pass: the series of a uid are a
    sorted array, and the choices are a fold over the 2 x slots steps that carries what is taken.
    """
    bag = series.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("ord", "series", "plane", "fluid", "fat_sat", "weighting", "n_slices"))).alias("bag"))
    # The fold's state: the chosen (slot, series) pairs so far.
    picks = "cast(array() as array<struct<slot:string,series:string>>)"
    for strict in (True, False):
        for name, plane, tight, loose in slots:
            free = "true" if reuse else "not exists(s, x -> x.series = r.series)"
            near = f"transform(filter(bag, r -> r.plane = '{plane}' and coalesce({tight if strict else loose}, false) and {free}), r -> named_struct('d', abs(r.n_slices - {wanted}), 'ord', r.ord, 'series', r.series))"
            step = f"if(exists(s, x -> x.slot = '{name}'), s, concat(s, transform(slice(array_sort({near}), 1, 1), x -> named_struct('slot', '{name}', 'series', x.series))))"
            picks = f"element_at(transform(array({picks}), s -> {step}), 1)"
            bag = bag.withColumn("picks", F.expr(picks))
            picks = "picks"
    bag = bag.withColumn("slots", F.map_from_entries("picks"))
    return bag.select(uid, "slots")


def preferred(series: DataFrame, uid: str, plane: str, flag: str) -> DataFrame:
    """Per uid the first flagged series of a plane, else its first."""
    return series.where(F.col("plane") == plane).groupBy(uid).agg(F.min_by("series", F.struct((~F.coalesce(F.col(flag), F.lit(False))).cast("int"), "ord")).alias("series"))


def longest(series: DataFrame, keys: list[str]) -> DataFrame:
    """The series with most slices per keys, the first of equals."""
    return series.groupBy(*keys).agg(F.min_by("series", F.struct(-F.col("n_slices"), F.col("ord"))).alias("series"))


def slice_order(slices: DataFrame, series: str = "series", position: str = "position", instance: str = "instance", file: str = "file") -> DataFrame:
    """Adds `place` from 0: by position if all slices have one, else by instance number if all do, else by file name."""
    w = W.partitionBy(series)
    by_pos, by_inst = F.min(F.col(position).isNotNull()).over(w), F.min(F.col(instance).isNotNull()).over(w)
    key = F.when(by_pos, F.col(position)).when(by_inst, F.col(instance).cast("double"))
    return slices.withColumn("_key", key).withColumn("place", F.row_number().over(w.orderBy(F.asc_nulls_first("_key"), file)) - 1).drop("_key")


def natural_key(file: Column) -> Column:
    """A key that sorts img2 before img10: a number is its count of digits, then its digits."""
    parts = F.regexp_extract_all(file, F.lit(r"(\d+|\D+)"))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lpad(F.length(F.ltrim(p, F.lit("0"))).cast("string"), 4, "0"), F.ltrim(p, F.lit("0")))).otherwise(p)), "")


def band_sample(series: DataFrame, n: int, low: float, high: float, count: str = "n_slices", reverse: Column | None = None) -> DataFrame:
    """n equidistant places of a central band of each series, rounded half to even, repeats allowed; reversed where told.

    One row per series and k (0 .. n - 1) with `place`.
    """
    last = F.col(count) - 1
    lo, hi = F.rint(F.lit(low) * last), F.rint(F.lit(high) * last)
    lo, hi = F.when(hi <= lo, 0.0).otherwise(lo), F.when(hi <= lo, last.cast("double")).otherwise(hi)
    out = series.withColumns({"_lo": lo, "_hi": hi}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = F.col("k") if reverse is None else F.when(reverse, n - 1 - F.col("k")).otherwise(F.col("k"))
    return out.withColumn("place", F.rint(F.col("_lo") + k * (F.col("_hi") - F.col("_lo")) / max(n - 1, 1)).cast("int")).drop("_lo", "_hi")


def nearest_good(rows: DataFrame, keys: list[str], place: str, good: str) -> DataFrame:
    """Adds `source`: the nearest good place (the smaller of equals) for each place, itself where good; null if none is."""
    w = W.partitionBy(*keys).orderBy(place)
    ok = F.when(F.col(good), F.col(place))
    left = F.last(ok, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    right = F.first(ok, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumns({"_l": left, "_r": right}).withColumn("source", F.when(F.col("_r").isNull() | (F.col(place) - F.col("_l") <= F.col("_r") - F.col(place)), F.col("_l")).otherwise(F.col("_r"))).drop("_l", "_r")


def neighbours(rows: DataFrame, keys: list[str], place: str, gap: int = 1) -> DataFrame:
    """Adds the places `gap` before and after, clamped to the group's ends."""
    w = W.partitionBy(*keys)
    first, last = F.min(place).over(w), F.max(place).over(w)
    return rows.withColumns({"before": F.greatest(first, F.col(place) - gap), "after": F.least(last, F.col(place) + gap)})


def build_manifest(series: DataFrame, n_shards: int, slots: tuple[Slot, ...] = SLOTS) -> DataFrame:
    """One row per uid: slots, number of slots, presence mask, side, shard. series as for select_slots, with tag and centre_x."""
    chosen = select_slots(series, slots=slots)
    sides = side(series)
    presence = F.concat(*(F.when(F.map_contains_key("slots", n), "1").otherwise("0") for n, *_ in slots))
    out = chosen.join(sides, "uid")
    return out.select("uid", *(F.col("slots")[n].alias(n) for n, *_ in slots), F.size("slots").alias("n_slots"), presence.alias("mask"), "side", "conflict", md5_shard(F.col("uid").cast("string"), n_shards).alias("shard"))


def choose_external(files: DataFrame, prefix: str, wanted: int = 3) -> DataFrame:
    """Series of a cohort from (knee, series, url): last file by name, URL below a prefix as an alias, knees with all series."""
    from sievework.functions.text import url_tail

    last = files.groupBy("knee", "series").agg(F.max("url").alias("url")).withColumn("alias", url_tail(F.col("url"), prefix))
    whole = last.groupBy("knee").agg(F.count("alias").alias("n")).where(F.col("n") == wanted).select("knee")
    return last.join(whole, "knee", "left_semi")


def ordered_series(series: DataFrame, uid: str, most: int = 8, least_slices: int = 5, planes: tuple[str, ...] = ("Sagittal", "Coronal", "Axial")) -> DataFrame:
    """The first series of each uid by plane, fat saturation, fluid and name; unknown planes and short series go."""
    at = F.array_position(F.array(*(F.lit(p) for p in planes)), F.col("plane"))
    rows = series.where((at > 0) & (F.col("n_slices") >= least_slices)).withColumn("_at", at)
    w = W.partitionBy(uid).orderBy("_at", F.col("fat_sat").cast("int").desc(), F.col("fluid").cast("int").desc(), "series")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("_at")


def majority_only(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the group's majority value only, with the number of rows removed from the group."""
    best = mode_of(rows, keys, value, "_best").drop("votes")
    joined = rows.join(best, keys).withColumn("removed", F.sum((F.col(value) != F.col("_best")).cast("int")).over(W.partitionBy(*keys)))
    return joined.where(F.col(value) == F.col("_best")).drop("_best")


def protocol_features(series: DataFrame, uid: str, planes: tuple[str, ...], flags: tuple[str, ...]) -> DataFrame:
    """Counts per uid: all series, per plane, per flag, per plane and flag."""
    aggs = [F.count("*").alias("n_series"), *(F.count_if(F.col("plane") == p).alias(f"n_{p}") for p in planes), *(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"n_{f}") for f in flags)]
    aggs += [F.count_if((F.col("plane") == p) & F.coalesce(F.col(f), F.lit(False))).alias(f"n_{p}_{f}") for p in planes for f in flags]
    return series.groupBy(uid).agg(*aggs)
