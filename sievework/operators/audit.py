"""Audits of label sources, languages and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.metrics import agreement, auc, hanley_mcneil, macro, pearson, spearman


def quantile_profile(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    q = F.expr(f"percentile({value}, array(0.05, 0.25, 0.5, 0.75, 0.95))")
    out = values.groupBy(*keys).agg(q.alias("q"), F.avg((F.col(value) < 0.1).cast("int")).alias("below"), F.avg((F.col(value) > 0.9).cast("int")).alias("above"))
    return out.select(*keys, *(F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))), "below", "above")


def silence(cells: DataFrame, keys: list[str], floor: float = 0.15) -> DataFrame:
    """Shares of verdicts, values and weights with and without a verdict; cells without any verdict count as addressed."""
    unk = F.coalesce(F.col("verdict") == "UNK", F.lit(False))
    return cells.groupBy(*keys).agg(
        F.avg(unk.cast("int")).alias("unk"),
        F.avg(F.coalesce(F.col("verdict") == "YES", F.lit(False)).cast("int")).alias("yes"),
        F.avg(F.when(unk, F.col("value"))).alias("value_unk"),
        F.avg(F.when(unk, F.col("w"))).alias("w_unk"),
        F.avg(F.when(~unk, F.col("w"))).alias("w_addressed"),
        F.avg((F.col("value") >= 0.5).cast("int")).alias("positive"),
        F.avg((F.col("w") <= floor).cast("int")).alias("at_floor"),
    )


def coverage_by(cells: DataFrame, lang: str, label: str, top: int = 8) -> DataFrame:
    """Share of UNK per language and label over the most frequent languages."""
    often = cells.groupBy(lang).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), lang).limit(top).select(lang)
    unk = F.coalesce(F.col("verdict") == "UNK", F.lit(False)).cast("int")
    return cells.join(F.broadcast(often), lang, "left_semi").groupBy(lang, label).agg(F.avg(unk).alias("unk"), F.count("*").alias("n"))


def coverage_rollup(cells: DataFrame, lang: str, label: str) -> DataFrame:
    """The same with totals per language and over all."""
    unk = F.coalesce(F.col("verdict") == "UNK", F.lit(False)).cast("int")
    return cells.rollup(lang, label).agg(F.avg(unk).alias("unk"), F.count("*").alias("n"))


def language_counts(docs: DataFrame, lang: str, gold: Column, top: int = 15) -> DataFrame:
    n = docs.agg(F.count("*").alias("_all"))
    per = docs.groupBy(lang).agg(F.count("*").alias("n"), F.count_if(gold).alias("gold"))
    return per.join(F.broadcast(n)).select(lang, "n", (F.col("n") / F.col("_all")).alias("share"), "gold").orderBy(F.desc("n"), lang).limit(top)


def phi_between(cells: DataFrame, unit: list[str], source: str, hard: str) -> DataFrame:
    """Phi and agreement of each pair of sources per label on 0/1 columns."""
    a = cells.select(*unit, F.col(source).alias("a"), F.col(hard).alias("x"))
    b = cells.select(*unit, F.col(source).alias("b"), F.col(hard).alias("y"))
    both = a.join(b, unit).where("a < b")
    return both.groupBy("a", "b", "label").agg(pearson(F.col("x"), F.col("y")).alias("phi"), agreement(F.col("x"), F.col("y")).alias("agree"), F.count("*").alias("n"))


def label_pairs(cells: DataFrame, uid: str, label: str, values: list[str]) -> DataFrame:
    """One row per uid and pair of its labels a < b, with x_<value> and y_<value>: a uid's labels are one array, of which the upper
    triangle is read; nothing is joined."""
    vector = cells.groupBy(uid).agg(F.collect_list(F.struct(F.col(label).alias("label"), *(F.col(v).alias(v) for v in values))).alias("_v"))

    def beside(x: Column) -> Column:
        later = F.filter("_v", lambda y: y["label"] > x["label"])
        return F.transform(later, lambda y: F.struct(x["label"].alias("a"), y["label"].alias("b"), *(x[v].alias(f"x_{v}") for v in values), *(y[v].alias(f"y_{v}") for v in values)))

    return vector.select(uid, F.explode(F.flatten(F.transform("_v", beside))).alias("p")).select(uid, "p.*")


def cooccurrence(cells: DataFrame, uid: str, label: str, value: str) -> DataFrame:
    """Pearson correlation and joint count of each pair of labels."""
    x, y = F.col(f"x_{value}"), F.col(f"y_{value}")
    return label_pairs(cells, uid, label, [value]).groupBy("a", "b").agg(pearson(x, y).alias("r"), F.count_if((x >= 0.5) & (y >= 0.5)).alias("both"))


def two_triangles(cells: DataFrame, uid: str, label: str, gold: str, weak: str) -> DataFrame:
    """The label matrix (row, col, triangle, r, n): correlations of gold values above the diagonal (row < col), of weak ones below,
    each over the uids that have both."""
    pairs = label_pairs(cells, uid, label, [gold, weak])
    r = {v: pearson(F.col(f"x_{v}"), F.col(f"y_{v}")) for v in (gold, weak)}
    n = {v: F.count_if(F.col(f"x_{v}").isNotNull() & F.col(f"y_{v}").isNotNull()) for v in (gold, weak)}
    both = pairs.groupBy("a", "b").agg(*(r[v].alias(f"r{k}") for k, v in enumerate((gold, weak))), *(n[v].alias(f"n{k}") for k, v in enumerate((gold, weak))))
    upper = F.struct(F.col("a").alias("row"), F.col("b").alias("col"), F.lit("gold").alias("triangle"), F.col("r0").alias("r"), F.col("n0").alias("n"))
    lower = F.struct(F.col("b").alias("row"), F.col("a").alias("col"), F.lit("weak").alias("triangle"), F.col("r1").alias("r"), F.col("n1").alias("n"))
    return both.select(F.explode(F.array(upper, lower)).alias("c")).select("c.*")


def top_pairs(matrix: DataFrame, triangle: str = "weak", n: int = 5) -> DataFrame:
    """The n pairs of a triangle with the largest correlation, by amount."""
    known = matrix.where((F.col("triangle") == triangle) & F.col("r").isNotNull())
    return known.orderBy(F.desc(F.round(F.abs("r"), 12)), "row", "col").limit(n)


def _phi(n: Column, a: Column, b: Column, both: Column) -> Column:
    """Phi of two 0/1 columns from counts; null if one is constant."""
    spread = a.cast("double") * (n - a) * b * (n - b)
    return F.when(spread > 0, (n * both - a * b) / F.sqrt(F.nullif(spread, F.lit(0.0))))


def label_audit(cells: DataFrame, gold: DataFrame, sources: list[str], judge: str, backfill: tuple[str, str] | None = None, floor: float = 0.15, replicates: int = 200) -> DataFrame:
    """Six sections on label sources in one long table: (section, lang, label, a, b, measure, value).

    cells: (uid, lang, source, label, value, verdict), of which the verdicts of the source `judge` tell silence (UNK); gold:
    (uid, label, y). A uid is gold if all its labels are.

    1 languages: studies, share, gold. 2 per label: gold rate, verdicts, each source's and the blend's share at 0.5 and mean on
    silent cells, weights. 3 errors against gold per source, their phi per pair of sources, agreement at 0.5 over all cells.
    4 silence per language and label, and the mean Spearman of the first two sources per language. 5 backfill (target, donor): a
    silent target takes the donor's blend; AUC on gold before and after with error and bootstrap bounds, weights. 6 the label
    matrix: gold above the diagonal, the blend at 0.5 below.

    The cells are read once, into one row per uid. Sections 1 to 4 are one aggregation over grouping sets, whose id names the
    section. Nulls: a cell without verdict counts as addressed, one without value in no mean; a null lang is a language.
    """
    from sievework.functions.scalars import confidence
    from sievework.operators.resample import replicate_auc, with_weights
    from sievework.sources.shared import once

    of = {s: F.max(F.when(F.col("source") == s, F.col("value"))).alias(f"v_{k}") for k, s in enumerate(sources)}
    cell = cells.groupBy("uid", "lang", "label").agg(
        *of.values(), F.max(F.when(F.col("source") == judge, F.col("verdict"))).alias("verdict"), F.avg("value").alias("blend"), confidence(F.avg("value"), F.stddev_pop("value")).alias("w")
    )
    cell = cell.join(gold.select("uid", "label", F.col("y").cast("double").alias("y")), ["uid", "label"], "left")
    parts = [f"v_{k}" for k in range(len(sources))] + ["verdict", "blend", "w", "y"]
    vector = once(cell.groupBy("uid", "lang").agg(F.array_sort(F.collect_list(F.struct("label", *parts))).alias("v"), (F.count("y") == F.count("*")).alias("is_gold")))
    rows = vector.select("uid", "lang", "is_gold", F.posexplode("v").alias("at", "c")).select("uid", "lang", "is_gold", (F.col("at") == 0).alias("first"), "c.*")

    unk = F.coalesce(F.col("verdict") == "UNK", F.lit(False))
    yes = F.coalesce(F.col("verdict") == "YES", F.lit(False))
    share = lambda c: F.avg(c.cast("int"))
    wrong = [F.when(F.col("is_gold") & F.col(f"v_{k}").isNotNull(), ((F.col(f"v_{k}") >= 0.5) != (F.col("y") > 0.5)).cast("int")) for k in range(len(sources))]
    pairs = [(i, j) for i in range(len(sources)) for j in range(i + 1, len(sources))]
    sums = {"studies": F.count_if("first"), "gold": F.count_if(F.col("first") & F.col("is_gold")), "n": F.count("*"), "unk": share(unk), "yes": share(yes)}
    sums |= {"gold_rate": F.avg(F.when(F.col("is_gold"), F.col("y"))), "blend_positive": share(F.col("blend") >= 0.5), "blend_unk": F.avg(F.when(unk, F.col("blend")))}
    sums |= {"w_unk": F.avg(F.when(unk, F.col("w"))), "w_addressed": F.avg(F.when(~unk, F.col("w"))), "at_floor": share(F.col("w") <= floor + 1e-9)}
    for k in range(len(sources)):
        sums |= {f"positive_{k}": share(F.col(f"v_{k}") >= 0.5), f"on_unk_{k}": F.avg(F.when(unk, F.col(f"v_{k}"))), f"error_{k}": F.avg(wrong[k])}
    for i, j in pairs:
        known = wrong[i].isNotNull() & wrong[j].isNotNull()
        a, b = F.when(known, wrong[i]), F.when(known, wrong[j])
        sums[f"phi_{i}_{j}"] = _phi(F.count(F.when(known, 1)), F.sum(a), F.sum(b), F.sum(a * b))
        sums[f"agree_{i}_{j}"] = share((F.col(f"v_{i}") >= 0.5) == (F.col(f"v_{j}") >= 0.5))
    sets = [[F.col("lang")], [F.col("label")], [F.col("lang"), F.col("label")], []]
    table = rows.groupingSets(sets, "lang", "label").agg(F.grouping_id().alias("level"), *(c.cast("double").alias(n) for n, c in sums.items()))

    def line(section: int, measure: str, value: str | Column, a: str | None = None, b: str | None = None) -> Column:
        v = F.col(value) if isinstance(value, str) else value
        return F.struct(F.lit(section).alias("section"), F.lit(a).cast("string").alias("a"), F.lit(b).cast("string").alias("b"), F.lit(measure).alias("measure"), v.alias("value"))

    by_label = [line(2, m, m) for m in ("gold_rate", "unk", "yes", "blend_positive", "blend_unk", "w_unk", "w_addressed", "at_floor")]
    for k, s in enumerate(sources):
        by_label += [line(2, "positive", f"positive_{k}", s), line(2, "value_unk", f"on_unk_{k}", s), line(3, "error", f"error_{k}", s)]
    by_label += [line(3, "error_phi", f"phi_{i}_{j}", sources[i], sources[j]) for i, j in pairs]
    # Grouping ids: bit 1 is set where lang is summed over, bit 0 where label is.
    kinds = {1: [line(1, "studies", "studies"), line(1, "gold", "gold")], 2: by_label, 0: [line(4, "unk", "unk"), line(4, "cells", "n")]}
    kinds[3] = [line(1, "all_studies", "studies")] + [line(3, "agreement", f"agree_{i}_{j}", sources[i], sources[j]) for i, j in pairs]
    which = F.when(F.col("level") == 0, F.array(*kinds[0])).when(F.col("level") == 1, F.array(*kinds[1])).when(F.col("level") == 2, F.array(*kinds[2])).otherwise(F.array(*kinds[3]))
    long = once(table.select("lang", "label", F.explode(which).alias("l")).select("l.section", "lang", "label", "l.a", "l.b", "l.measure", "l.value"))
    out = long
    total = long.where("measure = 'all_studies'").select(F.col("value").alias("_all"))  # one row
    shares = long.where("measure = 'studies'").join(F.broadcast(total)).withColumns({"value": F.col("value") / F.col("_all"), "measure": F.lit("share")}).drop("_all")
    out = out.unionByName(shares)

    empty = F.lit(None).cast("string")
    if len(sources) > 1:
        rho = spearman(rows, ["lang", "label"], "v_0", "v_1", least=20).groupBy("lang").agg(F.avg("rho").alias("value"))
        out = out.unionByName(rho.select(F.lit(4).alias("section"), "lang", empty.alias("label"), F.lit(sources[0]).alias("a"), F.lit(sources[1]).alias("b"), F.lit("spearman").alias("measure"), "value"))
    if backfill is not None:
        target, donor = backfill
        one = lambda name: F.get(F.filter("v", lambda c: c["label"] == name), F.lit(0))
        per = vector.select("uid", "is_gold", one(target).alias("t"), one(donor).alias("d"))
        hit = F.coalesce(F.col("t.verdict") == "UNK", F.lit(False))
        take = hit & F.col("d.blend").isNotNull()
        per = per.where("t is not null").select(
            "uid", "is_gold", hit.alias("unk"), F.col("t.y").alias("y"), F.col("t.blend").alias("old"), F.when(take, F.col("d.blend")).otherwise(F.col("t.blend")).alias("new"),
            F.col("t.w").alias("old_w"), F.when(take, F.col("d.w")).otherwise(F.col("t.w")).alias("new_w"),
        )
        per = once(per.withColumn("label", F.lit(target)))
        counts = per.agg(
            share(F.col("unk")).alias("unaddressed"), F.count_if("unk").cast("double").alias("n"), F.count_if(F.col("unk") & F.col("is_gold")).cast("double").alias("gold_unaddressed"),
            F.count_if(F.col("unk") & F.col("is_gold") & (F.col("y") > 0.5)).cast("double").alias("gold_unaddressed_positive"),
            F.avg(F.when(F.col("unk"), F.col("old_w"))).alias("w_before"), F.avg(F.when(F.col("unk"), F.col("new_w"))).alias("w_after"),
        )
        known = per.where("is_gold").withColumn("hard", (F.col("y") > 0.5).cast("int"))
        scored = auc(known.unpivot(["uid", "label", "hard"], ["old", "new"], "which", "p"), ["which"], "hard", "p")
        se = hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
        of_auc = scored.select(F.explode(F.array(F.struct(F.concat(F.lit("auc_"), "which").alias("measure"), F.col("auc").alias("value")), F.struct(F.concat(F.lit("se_"), "which").alias("measure"), se.alias("value")))).alias("m")).select("m.*")
        drawn = with_weights(known, replicates)
        gain = replicate_auc(drawn, ["label"], "hard", "new", replicates).withColumnRenamed("auc", "_new").join(replicate_auc(drawn, ["label"], "hard", "old", replicates), ["label", "replicate"])
        gain = gain.agg(F.avg(F.col("_new") - F.col("auc")).alias("delta"), F.expr("percentile(_new - auc, array(0.025, 0.975))").alias("q")).select("delta", F.col("q")[0].alias("delta_low"), F.col("q")[1].alias("delta_high"))
        lines = counts.unpivot([], counts.columns, "measure", "value").unionByName(of_auc).unionByName(gain.unpivot([], gain.columns, "measure", "value"))
        out = out.unionByName(lines.select(F.lit(5).alias("section"), empty.alias("lang"), F.lit(target).alias("label"), F.lit(donor).alias("a"), empty.alias("b"), "measure", "value"))
    hard = rows.select("uid", "label", F.when(F.col("is_gold"), (F.col("y") > 0.5).cast("double")).alias("gold"), (F.col("blend") >= 0.5).cast("double").alias("weak"))
    matrix = two_triangles(hard, "uid", "label", "gold", "weak")
    return out.unionByName(matrix.select(F.lit(6).alias("section"), empty.alias("lang"), F.col("row").alias("label"), F.col("col").alias("a"), empty.alias("b"), F.concat(F.lit("phi_"), "triangle").alias("measure"), F.col("r").alias("value")))


def reasons(notes: DataFrame, column: str, top: int = 6) -> DataFrame:
    """The most frequent parts of ';'-separated notes."""
    part = notes.select(F.explode(F.split(column, ";")).alias("reason")).select(F.trim("reason").alias("reason")).where("reason <> ''")
    return part.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def word_histogram(docs: DataFrame, count: Column, cap: float = 0.99, width: int = 50) -> DataFrame:
    """Documents per band of word counts up to a quantile."""
    counted = docs.select(count.alias("n"))
    most = counted.agg(F.expr(f"percentile(n, {cap})").alias("cap"))
    return counted.join(F.broadcast(most)).where("n <= cap").groupBy((F.floor(F.col("n") / width) * width).alias("from_words")).agg(F.count("*").alias("docs"))


def value_counts(rows: DataFrame, value: Column, top: int | None = None) -> DataFrame:
    out = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if top is None else out.limit(top)


def plausibility(pred: DataFrame, target: DataFrame, cut: float = 0.5, macro_floor: float = 0.85, label_floor: float = 0.75) -> DataFrame:
    """Per label: AUC with its error, rho, rates at a cut, and flags; pred (uid, label, p), target (uid, label, y)."""
    both = pred.join(target, ["uid", "label"])
    a = auc(both.withColumn("hard", (F.col("y") > 0.5).cast("int")), ["label"], "hard", "p")
    rho = spearman(both, ["label"], "p", "y").select("label", "rho")
    hit, pos = F.col("p") >= cut, F.col("y") > 0.5
    rates = both.groupBy("label").agg(F.try_divide(F.count_if(hit & pos), F.count_if(pos)).alias("sensitivity"), F.try_divide(F.count_if(~hit & ~pos), F.count_if(~pos)).alias("specificity"))
    all_ = macro(a, []).select(F.col("macro_auc").alias("macro_auc"))
    out = a.join(rho, "label").join(rates, "label").join(F.broadcast(all_))
    se = hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return out.select("label", "auc", se.alias("se"), "rho", "sensitivity", "specificity", (F.col("auc") < label_floor).alias("low"), "macro_auc", (F.col("macro_auc") >= macro_floor).alias("plausible"))


def fold_summary(oof: DataFrame, least_gold: int = 4) -> DataFrame:
    """Per fold: rows, macro AUC, gold macro AUC (with enough gold rows), spread of predictions. oof: (fold, uid, label, y, p, is_gold)."""
    hard = oof.withColumn("hard", (F.col("y") > 0.5).cast("int"))
    all_ = macro(auc(hard, ["fold", "label"], "hard", "p"), ["fold"]).select("fold", "macro_auc")
    gold = macro(auc(hard.where("is_gold"), ["fold", "label"], "hard", "p"), ["fold"]).select("fold", F.col("macro_auc").alias("gold_auc"))
    base = oof.groupBy("fold").agg(F.count_distinct("uid").alias("n"), F.count_distinct(F.when(F.col("is_gold"), F.col("uid"))).alias("n_gold"), F.stddev_pop("p").alias("spread"))
    out = base.join(all_, "fold").join(gold, "fold", "left")
    return out.withColumn("gold_auc", F.when(F.col("n_gold") >= least_gold, F.col("gold_auc")))


def pooled(oof: DataFrame) -> DataFrame:
    """Macro AUC over all folds: raw values, and ranks taken within each fold first."""
    from sievework.functions.ranks import with_rank

    hard = oof.withColumn("hard", (F.col("y") > 0.5).cast("int"))
    raw = macro(auc(hard, ["label"], "hard", "p"), []).select(F.col("macro_auc").alias("raw"))
    rank = macro(auc(with_rank(hard, ["fold", "label"], "p", "r"), ["label"], "hard", "r"), []).select(F.col("macro_auc").alias("ranked"))
    return raw.join(F.broadcast(rank))


def order_audit(slices: DataFrame, close: float = 0.99) -> DataFrame:
    """Spearman of file order and position per series, its mean, and the share of series above a bound."""
    rho = spearman(slices, ["series"], "file_at", "position")
    return rho.agg(F.avg("rho").alias("mean_rho"), F.avg((F.col("rho") > close).cast("int")).alias("in_order"), F.count("rho").alias("series"))


def set_comparison(views: DataFrame, sets: DataFrame, target: DataFrame) -> DataFrame:
    """Macro AUC of each set of views: mean of its views' predictions. sets: (set, view); target: (uid, label, y)."""
    mean = views.join(F.broadcast(sets), "view").groupBy("set", "uid", "label").agg(F.round(F.avg("p"), 12).alias("p"))
    return macro(auc(mean.join(target, ["uid", "label"]), ["set", "label"], "y", "p"), ["set"])
