"""Registered queries: ranks, metrics, blends, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import metrics, ranks
from sievework.operators import audit, blend, labels, quality, resample
from sievework.plans import composites
from sievework.plans.inputs import GOLD_SQL, MEMBERS_SQL, SOURCES_SQL, auc_sql, gold, members, members_sql, pct_sql, sources

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


R = lambda c, n=9: F.round(c, n)
ONE = "o AS (SELECT uid, label, y, max(p) FILTER (member = 'm0') AS a, max(p) FILTER (member = 'm1') AS b FROM members GROUP BY ALL)"


def pair(spark, d, first="m0", second="m1"):
    m = members(spark, d)
    return m.groupBy("uid", "label", "y").agg(F.max(F.when(F.col("member") == first, F.col("p"))).alias("a"), F.max(F.when(F.col("member") == second, F.col("p"))).alias("b"))


def one(spark, d, m="m0"):
    return members(spark, d).where(F.col("member") == m)


@query(f"WITH {MEMBERS_SQL}, {auc_sql('t', 'members', 'member, label', 'y', 'p')} SELECT member, round(avg(auc), 9) AS macro_auc, count(auc) AS n_labels FROM t GROUP BY member")
def macro_auc(spark, d):
    """D18, D19"""
    t = metrics.macro(metrics.auc(members(spark, d), ["member", "label"], "y", "p"), ["member"])
    return t.select("member", R("macro_auc").alias("macro_auc"), "n_labels")


@query(
    f"""WITH {MEMBERS_SQL}, {auc_sql('t', 'members', 'member, label', 'y', 'p')}
SELECT member, label, round(auc, 9) AS auc, n_pos, n_neg,
  round(sqrt(greatest(auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc), 0) / (n_pos * n_neg)), 9) AS se FROM t"""
)
def auc_with_error(spark, d):
    """D18, D20"""
    t = metrics.auc(members(spark, d), ["member", "label"], "y", "p")
    return t.select("member", "label", R("auc").alias("auc"), "n_pos", "n_neg", R(metrics.hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg"))).alias("se"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('t', 'members', 'member, label', 'p', 'r')} SELECT member, label, uid, round(r, 9) AS r FROM t")
def pct_rank(spark, d):
    """E1"""
    return ranks.with_rank(members(spark, d), ["member", "label"], "p", "r").select("member", "label", "uid", R("r").alias("r"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('t', 'members', 'member, label, fold', 'p', 'r')}, {auc_sql('a', 't', 'member, label', 'y', 'r')} SELECT member, round(avg(auc), 9) AS pooled FROM a GROUP BY member")
def rank_within_fold(spark, d):
    """Ranks inside folds, pooled"""
    t = ranks.with_rank(members(spark, d), ["member", "label", "fold"], "p", "r")
    return metrics.macro(metrics.auc(t, ["member", "label"], "y", "r"), ["member"], name="pooled").select("member", R("pooled").alias("pooled"))


@query(
    f"""WITH {MEMBERS_SQL} SELECT member, label, uid,
  round(((rank() OVER w + (count(*) OVER (PARTITION BY member, label, p) - 1) / 2.0::DOUBLE) - 1) / (count(*) OVER (PARTITION BY member, label) - 1), 9) AS r
  FROM members WINDOW w AS (PARTITION BY member, label ORDER BY p)"""
)
def endpoint_rank(spark, d):
    """E3"""
    return ranks.with_rank(members(spark, d), ["member", "label"], "p", "r", "end01").select("member", "label", "uid", R("r").alias("r"))


@query(f"WITH {MEMBERS_SQL} SELECT label, uid, round((row_number() OVER (PARTITION BY label ORDER BY p, uid) - 1)::DOUBLE / (count(*) OVER (PARTITION BY label) - 1), 9) AS r FROM members WHERE member = 'm0'")
def row_rank(spark, d):
    """E3, the variant without ties"""
    return ranks.with_row_rank(one(spark, d), ["label"], "p", "uid", "r").select("label", "uid", R("r").alias("r"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('t', 'members', 'member, label', 'p', 'r', 'uid % 5 <> 0')} SELECT member, label, uid, round(r, 9) AS r FROM t")
def scored_rank(spark, d):
    """E4"""
    return ranks.with_rank(members(spark, d), ["member", "label"], "p", "r", on=F.col("uid") % 5 != 0).select("member", "label", "uid", R("r").alias("r"))


@query(f"WITH {SOURCES_SQL}, {pct_sql('t', 'sources', 'source, label', 'value', 'r')} SELECT uid, label, round(avg(r), 9) AS rank_mean FROM t GROUP BY uid, label")
def rank_blend(spark, d):
    """E5"""
    return labels.rank_blend(sources(spark, d)).select("uid", "label", R("rank_mean").alias("rank_mean"))


QMATCH = f"""WITH {MEMBERS_SQL}, pred AS (SELECT uid, label, p FROM members WHERE member = 'm0'), ref AS (SELECT label, p FROM members WHERE member = 'm1' AND uid % 3 <> 0),
r AS (SELECT uid, label, (rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY label) AS q FROM pred),
s AS (SELECT label, p, row_number() OVER (PARTITION BY label ORDER BY p) - 1 AS at, count(*) OVER (PARTITION BY label) AS m FROM ref),
n AS (SELECT label, any_value(m) AS m FROM s GROUP BY label), t AS (SELECT uid, label, q * (m - 1) AS pos FROM r JOIN n USING (label))
SELECT t.uid, t.label, round(lo.p + (hi.p - lo.p) * (pos - floor(pos)), 9) AS matched FROM t JOIN s lo ON lo.label = t.label AND lo.at = floor(pos) JOIN s hi ON hi.label = t.label AND hi.at = ceil(pos)"""


@query(QMATCH)
def quantile_match(spark, d):
    """E6"""
    pred, ref = one(spark, d).select("uid", "label", "p"), one(spark, d, "m1").where("uid % 3 <> 0").select("label", F.col("p").alias("ref"))
    return ranks.quantile_match(pred, ref, ["label"], "p", "ref", "matched").select("uid", "label", R("matched").alias("matched"))


SPEARMAN = """rx AS (SELECT {k}, uid, rank() OVER (PARTITION BY {k} ORDER BY a) + (count(*) OVER (PARTITION BY {k}, a) - 1) / 2.0::DOUBLE AS x,
  rank() OVER (PARTITION BY {k} ORDER BY b) + (count(*) OVER (PARTITION BY {k}, b) - 1) / 2.0::DOUBLE AS z FROM {t})"""


@query(f"WITH {MEMBERS_SQL}, {ONE}, {SPEARMAN.format(k='label', t='o')} SELECT label, round(covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)), 9) AS rho, count(*) AS n FROM rx GROUP BY label")
def spearman(spark, d):
    """D23"""
    return metrics.spearman(pair(spark, d), ["label"], "a", "b").select("label", R("rho").alias("rho"), "n")


@query(
    f"""WITH {SOURCES_SQL}, h AS (SELECT uid, label, source, CASE WHEN value IS NOT NULL THEN (value >= 0.5)::INT END AS hard FROM sources), b AS (
SELECT x.source AS a, y.source AS b, x.label, x.hard AS u, y.hard AS v FROM h x JOIN h y ON x.uid = y.uid AND x.label = y.label AND x.source < y.source)
SELECT a, b, label, round(covar_pop(u, v) FILTER (u IS NOT NULL AND v IS NOT NULL) / (stddev_pop(u) FILTER (v IS NOT NULL) * stddev_pop(v) FILTER (u IS NOT NULL)), 9) AS phi,
  round(avg(((u >= 0.5) = (v >= 0.5))::INT), 9) AS agree, count(*) AS n FROM b GROUP BY a, b, label"""
)
def phi_and_agreement(spark, d):
    """D16, D17, C12"""
    s = sources(spark, d).select("uid", "label", "source", F.when(F.col("value").isNotNull(), (F.col("value") >= 0.5).cast("int")).alias("hard"))
    return audit.phi_between(s, ["uid", "label"], "source", "hard").select("a", "b", "label", R("phi").alias("phi"), R("agree").alias("agree"), "n")


@query(f"WITH {MEMBERS_SQL}, per AS (SELECT uid, sum(w * -(y * ln(q) + (1 - y) * ln(1 - q))) / greatest(sum(w), 1e-6) AS loss FROM (SELECT uid, y, (uid % 3 + 1)::DOUBLE / 3 AS w, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM members WHERE member = 'm0') GROUP BY uid) SELECT round(avg(loss), 8) AS loss, count(*) AS n FROM per")
def weighted_log_loss(spark, d):
    """D21"""
    return metrics.weighted_log_loss(one(spark, d).withColumn("w", (F.col("uid") % 3 + 1) / 3), ["uid"], "y", "p", "w").select(R("loss", 8).alias("loss"), "n")


@query(f"WITH {MEMBERS_SQL}, s AS (SELECT member, label, stddev_pop(p) AS spread, max(p) = min(p) AS constant, count(p) AS n FROM members GROUP BY member, label) SELECT member, label, round(spread, 9) AS spread, constant, n, spread < 0.01 AS collapsed FROM s")
def spread(spark, d):
    """D22, H9"""
    return metrics.spread(members(spark, d), ["member", "label"], "p").select("member", "label", R("spread").alias("spread"), "constant", "n", (F.col("spread") < 0.01).alias("collapsed"))


@query(
    f"""WITH {MEMBERS_SQL}, {ONE}, g AS (SELECT label, max(abs(a - b)) AS mx, avg(abs(a - b)) AS mn FROM o GROUP BY label)
SELECT label, round(mx, 9) AS max_diff, round(mn, 9) AS mean_diff, 0::BIGINT AS unmatched, CASE WHEN mx <= 1e-3 THEN 'equal' WHEN mx <= 0.03 AND mn <= 0.003 THEN 'portable' ELSE 'different' END AS verdict FROM g"""
)
def differences(spark, d):
    """D24, A17"""
    t = metrics.differences(one(spark, d), one(spark, d, "m1"), ["uid", "label"], ["label"], "p")
    return t.select("label", R("max_diff").alias("max_diff"), R("mean_diff").alias("mean_diff"), "unmatched", metrics.verdict(F.col("max_diff"), F.col("mean_diff")).alias("verdict"))


@query(
    f"""WITH {MEMBERS_SQL}, m AS (SELECT *, uid % 4 = 0 AS is_gold FROM members WHERE member = 'm0'), {auc_sql('t', 'm', 'fold, label', 'y', 'p')}, gd AS (SELECT * FROM m WHERE is_gold), {auc_sql('g', 'gd', 'fold, label', 'y', 'p')}
SELECT b.fold, b.n, b.n_gold, round(b.spread, 9) AS spread, round(t2.a, 9) AS macro_auc, CASE WHEN b.n_gold >= 4 THEN round(g2.a, 9) END AS gold_auc
FROM (SELECT fold, count(DISTINCT uid) AS n, count(DISTINCT uid) FILTER (is_gold) AS n_gold, stddev_pop(p) AS spread FROM m GROUP BY fold) b
JOIN (SELECT fold, avg(auc) AS a FROM t GROUP BY fold) t2 USING (fold) LEFT JOIN (SELECT fold, avg(auc) AS a FROM g GROUP BY fold) g2 USING (fold)"""
)
def fold_summary(spark, d):
    """D25"""
    t = audit.fold_summary(one(spark, d).withColumn("is_gold", F.col("uid") % 4 == 0))
    return t.select("fold", "n", "n_gold", R("spread").alias("spread"), R("macro_auc").alias("macro_auc"), R("gold_auc").alias("gold_auc"))


@query(f"WITH {MEMBERS_SQL}, m AS (SELECT * FROM members WHERE member = 'm0'), {pct_sql('r', 'm', 'fold, label', 'p', 'r')}, {auc_sql('x', 'm', 'label', 'y', 'p')}, {auc_sql('z', 'r', 'label', 'y', 'r')} SELECT (SELECT round(avg(auc), 9) FROM x) AS raw, (SELECT round(avg(auc), 9) FROM z) AS ranked")
def pooled_oof(spark, d):
    """Pooled raw against pooled ranks"""
    return audit.pooled(one(spark, d)).select(R("raw").alias("raw"), R("ranked").alias("ranked"))


BLEND = f"{pct_sql('rk', 'members', 'member, label', 'p', 'r')}"


@query(f"WITH {MEMBERS_SQL}, {BLEND}, v AS (SELECT uid, label, CASE WHEN member IN ('m0', 'm1') THEN 'v1' WHEN member = 'm2' THEN 'v2' ELSE 'v3' END AS version, CASE WHEN member IN ('m0', 'm1', 'm2') THEN 'A' ELSE 'B' END AS vote, r FROM rk), a AS (SELECT uid, label, vote, version, avg(r) AS r FROM v GROUP BY ALL), b AS (SELECT uid, label, vote, avg(r) AS r FROM a GROUP BY ALL) SELECT uid, label, round(avg(r), 9) AS p FROM b GROUP BY uid, label")
def rank_mean(spark, d):
    """G5"""
    v = spark.createDataFrame([("m0", "v1", "A"), ("m1", "v1", "A"), ("m2", "v2", "A"), ("m3", "v3", "B")], "member string, version string, vote string")
    return blend.rank_mean(members(spark, d), v).select("uid", "label", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, mm AS (SELECT * FROM members WHERE NOT (member = 'm3' AND uid % 4 = 0)), {pct_sql('rk2', 'mm', 'member, label', 'p', 'r')}, w AS (SELECT 'm' || m AS member, 'c' || k AS label, (m + k + 1)::DOUBLE AS w FROM range(4) a(m), range(4) b(k)) SELECT uid, label, round(sum(w * r) / sum(w), 9) AS p FROM rk2 JOIN w USING (member, label) GROUP BY uid, label")
def weighted_blend(spark, d):
    """Members that cover different rows"""
    w = spark.createDataFrame([(f"m{m}", f"c{k}", float(m + k + 1)) for m in range(4) for k in range(4)], "member string, label string, w double")
    return blend.weighted(members(spark, d).where("not (member = 'm3' and uid % 4 = 0)"), w).select("uid", "label", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, i AS (SELECT CASE WHEN member IN ('m0', 'm1') THEN 0 ELSE 1 END AS fold, uid, label, round(avg(p), 12) AS p FROM members GROUP BY ALL), r AS (SELECT fold, uid, label, ((rank() OVER (PARTITION BY fold, label ORDER BY p) + (count(*) OVER (PARTITION BY fold, label, p) - 1) / 2.0::DOUBLE) - 1) / (count(*) OVER (PARTITION BY fold, label) - 1) AS r FROM i) SELECT uid, label, round(avg(r), 9) AS p FROM r GROUP BY uid, label HAVING count(DISTINCT fold) = 2")
def fold_combine(spark, d):
    """G7"""
    m = members(spark, d).withColumn("fold", F.when(F.col("member").isin("m0", "m1"), 0).otherwise(1))
    m = m.groupBy("fold", "uid", "label").agg(F.round(F.avg("p"), 12).alias("p"))
    return blend.by_folds(m, 2).select("uid", "label", R("p").alias("p"))


def _mix_sql(ra: str, rb: str, more: str) -> str:
    return f"WITH {MEMBERS_SQL}, {ONE}, {pct_sql('x', 'o', 'label', 'a', 'ra', ra)}, {pct_sql('z', 'x', 'label', 'b', 'rb', rb)}, {more}"


#: Doubled average ranks are integers; a and b have the same rows, so quarters of these order the mixes, equal mixes tie, and halves go up.
_WHOLE = "k AS (SELECT o.*, 2 * rank() OVER (PARTITION BY label ORDER BY a) + count(*) OVER (PARTITION BY label, a) - 1 AS ka, 2 * rank() OVER (PARTITION BY label ORDER BY b) + count(*) OVER (PARTITION BY label, b) - 1 AS kb FROM o)"


@query(f"WITH {MEMBERS_SQL}, {ONE}, {_WHOLE}, g AS (SELECT k.*, q / 4::DOUBLE AS beta, (4 - q) * ka + q * kb AS m FROM k, (VALUES (0), (1), (2), (4)) v(q)), f AS (SELECT beta, uid, label, 2 * rank() OVER (PARTITION BY beta, label ORDER BY m) + count(*) OVER (PARTITION BY beta, label, m) - 1 AS t, count(*) OVER (PARTITION BY beta, label) AS n FROM g) SELECT beta, uid, label, (t * 1000000000 + n) // (2 * n) / 1e9 AS p FROM f")
def fork_blend(spark, d):
    """G8, C13"""
    o = pair(spark, d)
    a, b = o.select("uid", "label", F.col("a").alias("p")), o.select("uid", "label", F.col("b").alias("p"))
    return blend.mix_ranked(a, b, [0.0, 0.25, 0.5, 1.0]).select("beta", "uid", "label", R("p").alias("p"))


@query(_mix_sql("uid % 7 <> 0", "uid % 5 <> 0", "f AS (SELECT *, coalesce(0.6 * ra + 0.4 * rb, ra, rb, 0.5) AS p FROM z) SELECT uid, label, round(p, 9) AS p FROM f"))
def failure_aware(spark, d):
    """G9, G39"""
    o = pair(spark, d)
    a = o.select("uid", "label", F.col("a").alias("p"), (F.col("uid") % 7 != 0).alias("ok"))
    b = o.select("uid", "label", F.col("b").alias("p"), (F.col("uid") % 5 != 0).alias("ok"))
    return blend.two_with_failures(a, b, 0.6).select("uid", "label", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('x', 'members', 'member, label', 'p', 'r', chr(40) + 'uid + ascii(substr(member, 2, 1))' + chr(41) + ' % 3 <> 0')} SELECT uid, label, round(sum(CASE WHEN r IS NOT NULL THEN w * r END) / sum(CASE WHEN r IS NOT NULL THEN w END), 9) AS p FROM x JOIN (VALUES ('m0', 4.0::DOUBLE), ('m1', 3.0::DOUBLE), ('m2', 2.0::DOUBLE), ('m3', 1.0::DOUBLE)) w(member, w) USING (member) GROUP BY uid, label")
def renormalised_blend(spark, d):
    """G10"""
    m = members(spark, d).withColumn("ok", (F.col("uid") + F.ascii(F.substring("member", 2, 1))) % 3 != 0)
    w = spark.createDataFrame([(f"m{i}", float(4 - i)) for i in range(4)], "member string, w double")
    return blend.renormalised(m, w).select("uid", "label", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, r AS (SELECT member, uid, label, round(p * 5) / 5 AS p FROM members WHERE label IN ('c0', 'c1')), v AS (SELECT member, uid, string_agg(label || '=' || p, ',' ORDER BY label) AS v FROM r GROUP BY ALL) SELECT member, uid FROM (SELECT *, count(*) OVER (PARTITION BY member, v) AS n FROM v) WHERE n > 1")
def repeated_predictions(spark, d):
    """G11"""
    m = members(spark, d).where(F.col("label").isin("c0", "c1")).withColumn("p", F.round(F.col("p") * 5) / 5)
    return blend.repeated_rows(m).select("member", "uid")


@query(_mix_sql("TRUE", "uid % 5 <> 0", f"g AS (SELECT *, round(coalesce(0.7 * ra + 0.3 * rb, ra), 12) AS m FROM z), {pct_sql('f', 'g', 'label', 'm', 'p')} SELECT uid, label, round(p, 9) AS p FROM f"))
def third_component(spark, d):
    """G12"""
    o = pair(spark, d)
    a, b = o.select("uid", "label", F.col("a").alias("p")), o.select("uid", "label", F.col("b").alias("p"), (F.col("uid") % 5 != 0).alias("ok"))
    return blend.third_component(a, b, 0.3).select("uid", "label", R("p").alias("p"))


@query(f"WITH {SOURCES_SQL} SELECT source AS member, uid, label, value IS NULL AS filled, round(coalesce(value, avg(value) OVER (PARTITION BY source, label), 0.5), 9) AS p FROM sources")
def neutral_fill(spark, d):
    """G36, C4"""
    m = sources(spark, d).select(F.col("source").alias("member"), "uid", "label", F.col("value").alias("p"))
    return blend.neutral_fill(m).select("member", "uid", "label", "filled", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, m AS (SELECT uid, label, round(sum(w * p) / sum(w), 12) AS m FROM members JOIN (VALUES ('m0', 0.5::DOUBLE), ('m1', 0.25::DOUBLE), ('m2', 0.125::DOUBLE), ('m3', 0.125::DOUBLE)) w(member, w) USING (member) GROUP BY uid, label) SELECT uid, label, round(((rank() OVER (PARTITION BY label ORDER BY m) + (count(*) OVER (PARTITION BY label, m) - 1) / 2.0::DOUBLE) - 1) / (count(*) OVER (PARTITION BY label) - 1), 9) AS p FROM m")
def probability_mix(spark, d):
    """G37, D2"""
    w = spark.createDataFrame([("m0", 0.5), ("m1", 0.25), ("m2", 0.125), ("m3", 0.125)], "view string, w double")
    return blend.probability_mix(members(spark, d).withColumnRenamed("member", "view"), w).select("uid", "label", R("p").alias("p"))


@query(
    f"""WITH {MEMBERS_SQL}, e01 AS (SELECT *, (uid % 6 <> 0) AS ok FROM members),
b AS (SELECT uid, label, ((rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0::DOUBLE) - 1) / (count(*) OVER (PARTITION BY label) - 1) AS r0 FROM e01 WHERE member = 'm0'),
f AS (SELECT uid, label, avg(r) AS r FROM (SELECT uid, label, ((rank() OVER (PARTITION BY member, label ORDER BY p) + (count(*) OVER (PARTITION BY member, label, p) - 1) / 2.0::DOUBLE) - 1) / (count(*) OVER (PARTITION BY member, label) - 1) AS r FROM e01 WHERE ok AND member <> 'm0') GROUP BY uid, label)
SELECT uid, label, round(coalesce(r, r0), 9) AS p FROM b LEFT JOIN f USING (uid, label)"""
)
def applicability_merge(spark, d):
    """G38"""
    m = members(spark, d)
    folds = m.where("member <> 'm0'").select(F.col("member").alias("fold"), "uid", "label", "p", (F.col("uid") % 6 != 0).alias("eligible"))
    return blend.applicable(m.where("member = 'm0'"), folds).select("uid", "label", R("p").alias("p"))


@query(
    f"""WITH {MEMBERS_SQL}, w AS (SELECT uid, label, max(p) FILTER (member = 'm0') AS a, max(p) FILTER (member = 'm1') AS b, max(p) FILTER (member = 'm2') AS c FROM members GROUP BY ALL),
{pct_sql('x', 'w', 'label', 'a', 'ra')}, {pct_sql('z', 'x', 'label', 'b', 'ro')}, {pct_sql('v', 'z', 'label', 'c', 'rn')},
n AS (SELECT label, greatest(1 - covar_pop(ro, rn) / (stddev_pop(ro) * stddev_pop(rn)), 1e-4) AS novelty FROM v GROUP BY label),
s AS (SELECT label, greatest(0.8, least(1.2, novelty / greatest((SELECT median(novelty) FROM n), 1e-4))) AS scale FROM n),
g AS (SELECT uid, label, round(ra + 0.06 * scale * (rn - ro), 9) AS m FROM v JOIN s USING (label)), {pct_sql('f', 'g', 'label', 'm', 'p')} SELECT uid, label, round(p, 6) AS p FROM f"""
)
def residual_injection(spark, d):
    """G13"""
    t = lambda k: one(spark, d, k).select("uid", "label", "p")
    return blend.residual(t("m0"), t("m1"), t("m2"), 0.06).select("uid", "label", R("p", 6).alias("p"))


EDGES = [("c0", "c1", 0.1), ("c0", "c2", 0.1), ("c1", "c3", -0.2), ("c3", "c0", 0.05)]


@query(
    f"""WITH {MEMBERS_SQL}, m AS (SELECT * FROM members WHERE member = 'm0'), {pct_sql('x', 'm', 'label', 'p', 'r')},
e(label, neighbour, alpha) AS (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in EDGES)}),
h AS (SELECT x.uid, e.label, avg(x.r) * any_value(e.alpha) AS shift FROM x JOIN e ON x.label = e.neighbour GROUP BY x.uid, e.label),
g AS (SELECT x.uid, x.label, round(x.r + coalesce(h.shift, 0), 9) AS m FROM x LEFT JOIN h USING (uid, label)), {pct_sql('f', 'g', 'label', 'm', 'q')} SELECT uid, label, round(q, 9) AS p FROM f"""
)
def neighbour_residual(spark, d):
    """G14"""
    e = spark.createDataFrame(EDGES, "label string, neighbour string, alpha double")
    return blend.neighbour_residual(one(spark, d).select("uid", "label", "p"), e).select("uid", "label", R("p").alias("p"))


@query(f"WITH {MEMBERS_SQL}, {ONE}, {SPEARMAN.format(k='label', t='o')}, r AS (SELECT label, covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) AS rho FROM rx GROUP BY label) SELECT label, round(rho, 9) AS rho, CASE WHEN rho > 0.992 THEN 0.4 * 0.5 WHEN rho < 0.6 THEN 0.3 + (0.4 - 0.3) * 0.5 ELSE 0.4 END::DOUBLE AS w FROM r")
def guarded_weights(spark, d):
    """G15"""
    t = metrics.spearman(pair(spark, d), ["label"], "a", "b")
    return t.select("label", R("rho").alias("rho"), R(blend.guarded_weight(F.lit(0.4), F.col("rho"), F.lit(0.3))).alias("w"))


@query(_mix_sql("TRUE", "TRUE", f"g AS (SELECT *, round(CASE WHEN label IN ('c1', 'c2') AND rb IS NOT NULL THEN 0.8 * ra + 0.2 * rb ELSE ra END, 12) AS m FROM z), {pct_sql('f', 'g', 'label', 'm', 'p')} SELECT uid, label, round(p, 9) AS p FROM f"))
def specialist_injection(spark, d):
    """G16"""
    o = pair(spark, d)
    return blend.inject_specialist(o.select("uid", "label", F.col("a").alias("p")), o.select("uid", "label", F.col("b").alias("p")), ["c1", "c2"], 0.2).select("uid", "label", R("p").alias("p"))


@query(
    f"""WITH {MEMBERS_SQL}, f AS (SELECT uid, member || label AS feature, p AS x FROM members), s AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS scale FROM f GROUP BY feature),
sc AS (SELECT f.uid, c.label, round(sum(c.coef * round((f.x - round(s.mean, 9)) / round(s.scale, 9), 9)) + c.bias, 6) AS s FROM f JOIN s USING (feature) JOIN (SELECT 'm' || m || 'c' || k AS feature, 'c' || k AS label, (m + 1) / 10.0::DOUBLE AS coef, k::DOUBLE AS bias FROM range(4) a(m), range(4) b(k)) c USING (feature) GROUP BY f.uid, c.label, c.bias),
{pct_sql('rs', 'sc', 'label', 's', 'rs')}, m AS (SELECT uid, label, p FROM members WHERE member = 'm0'), {pct_sql('rb', 'm', 'label', 'p', 'rb')}
SELECT uid, label, round(CASE WHEN label = 'c0' THEN 0.5 * rb + 0.5 * rs ELSE rb END, 6) AS p FROM rb JOIN rs USING (uid, label)"""
)
def linear_stacking(spark, d):
    """G19"""
    m = members(spark, d)
    f = m.select("uid", F.concat("member", "label").alias("feature"), F.col("p").alias("x"))
    scaling = f.groupBy("feature").agg(R(F.avg("x")).alias("mean"), R(F.stddev_pop("x")).alias("scale"))
    coefs = spark.createDataFrame([(f"c{k}", f"m{i}c{k}", (i + 1) / 10) for i in range(4) for k in range(4)] + [(f"c{k}", "", float(k)) for k in range(4)], "label string, feature string, coef double")
    f = f.join(F.broadcast(scaling), "feature").select("uid", "feature", R((F.col("x") - F.col("mean")) / F.col("scale")).alias("x"))
    unit = scaling.select("feature", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    z = f.join(F.broadcast(unit), "feature").select("uid", "feature", "x")
    gated = spark.createDataFrame([("c0", 0.5)], "label string, w double")
    return blend.stack(z, unit, coefs, m.where("member = 'm0'").select("uid", "label", "p"), gated).select("uid", "label", R("p", 6).alias("p"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('x', 'members', 'member, fold, label', 'p', 'r0')}, {pct_sql('z', 'x', 'member, label', 'r0', 'r')} SELECT uid, label, round(avg(r), 9) AS p, count(r) AS n_sets FROM z GROUP BY uid, label")
def distillation_table(spark, d):
    """G25"""
    return blend.distill(members(spark, d).withColumnRenamed("member", "set")).select("uid", "label", R("p").alias("p"), "n_sets")


@query(f"WITH {MEMBERS_SQL}, {ONE.replace('GROUP BY ALL', 'WHERE uid % 2 = 0 GROUP BY ALL')}, {pct_sql('x', 'o', 'label', 'a', 'ra')}, {pct_sql('z', 'x', 'label', 'b', 'rb')} SELECT uid, label, round(round_even(0.3 * ra + 0.7 * rb, 6), 5) AS p FROM z")
def rank_composite(spark, d):
    """G26, B17"""
    o = pair(spark, d)
    index = o.where("uid % 2 = 0").select("uid").distinct()
    return blend.composite(index, o.select("uid", "label", F.col("a").alias("p")), o.select("uid", "label", F.col("b").alias("p")), 0.3).select("uid", "label", R("p", 5).alias("p"))


@query(f"WITH {MEMBERS_SQL}, e AS (SELECT uid, label, member, p, substr(member, 2, 1)::INT AS epoch FROM members WHERE member <> 'm0'), {pct_sql('x', 'e', 'epoch, label', 'p', 'r')} SELECT uid, label, round(avg(r), 9) AS p FROM x GROUP BY uid, label")
def snapshot_mean(spark, d):
    """G22"""
    m = members(spark, d).withColumns({"epoch": F.substring("member", 2, 1).cast("int"), "arm": F.lit("a")})
    return blend.snapshots(m, 3).select("uid", "label", R("p").alias("p"))


_POISSON = " + ".join(f"(u >= {c!r})::INT" for c in [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253])
_DRAWS = "d AS (SELECT m.*, r AS replicate, {p} AS times FROM (SELECT {t}.*, r, ('0x' || substr(md5(r || ':' || uid), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM {t}, range({n}) x(r)) m WHERE {p} > 0)"


def wauc_sql(name: str, source: str, keys: str, s: str) -> str:
    return f"""{name}_c AS (SELECT {keys}, {s} AS s, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE times END) AS neg FROM {source} GROUP BY {keys}, {s}),
{name}_w AS (SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY s) - neg AS before FROM {name}_c),
{name} AS (SELECT {keys}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (2 * before + neg))::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE END AS auc FROM {name}_w GROUP BY {keys})"""


@query(f"WITH {MEMBERS_SQL}, m0 AS (SELECT uid, label, y, p FROM members WHERE member = 'm0'), {_DRAWS.format(t='m0', n=40, p=_POISSON)}, {wauc_sql('t', 'd', 'replicate, label', 'p')}, q AS (SELECT avg(auc) AS a FROM t GROUP BY replicate) SELECT round(avg(a), 9) AS mean, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.975), 9) AS high, count(*) AS n FROM q")
def bootstrap_macro(spark, d):
    """G20"""
    t = resample.bootstrap_macro(one(spark, d).select("uid", "label", "y", "p"), 40)
    return t.select(R("mean").alias("mean"), R("low").alias("low"), R("high").alias("high"), "n")


@query(f"WITH {MEMBERS_SQL}, {ONE}, {_DRAWS.format(t='o', n=40, p=_POISSON)}, {wauc_sql('ta', 'd', 'replicate, label', 'a')}, {wauc_sql('tb', 'd', 'replicate, label', 'b')}, g AS (SELECT label, tb.auc - ta.auc AS gain FROM ta JOIN tb USING (replicate, label)) SELECT label, round(avg(gain), 9) AS mean, round(quantile_cont(gain, 0.1), 9) AS q10, round(quantile_cont(gain, 0.9), 9) AS q90, round(avg((gain > 0)::INT), 9) AS win FROM g GROUP BY label")
def bootstrap_delta(spark, d):
    """Paired gains"""
    t = resample.bootstrap_delta(pair(spark, d), 40)
    return t.select("label", R("mean").alias("mean"), R("q10").alias("q10"), R("q90").alias("q90"), R("win").alias("win"))


GRID = [0.25, 0.35, 0.45, 0.5, 0.55, 0.65, 0.75, 0.8]
_RANKED = f"{MEMBERS_SQL}, {ONE}, {pct_sql('x', 'o', 'label', 'a', 'ra')}, {pct_sql('z', 'x', 'label', 'b', 'rb')}"


def _ranked_pair(spark, d):
    return ranks.with_rank(ranks.with_rank(pair(spark, d), ["label"], "a", "ra"), ["label"], "b", "rb").select("uid", "label", "y", "ra", "rb")


_FIT = f"g AS (SELECT z.*, weight, round((1 - weight) * ra + weight * rb, 9) AS m FROM z, (VALUES {', '.join(f'({g}::DOUBLE)' for g in GRID)}) v(weight)), {auc_sql('t', 'g', 'label, weight', 'y', 'm')}, fit AS (SELECT label, first(weight ORDER BY round(auc, 12) DESC, round(abs(weight - 0.5), 9), weight) AS weight, max(auc) AS auc FROM t WHERE auc IS NOT NULL GROUP BY label)"


@query(f"WITH {_RANKED}, {_FIT} SELECT label, weight, round(auc, 9) AS auc FROM fit")
def fit_target_weights(spark, d):
    """G17, C13"""
    return resample.fit_weights(_ranked_pair(spark, d), GRID, 0.5).select("label", "weight", R("auc").alias("auc"))


@query(f"WITH {_RANKED}, {_DRAWS.format(t='z', n=20, p=_POISSON)}, g AS (SELECT d.*, weight, round((1 - weight) * ra + weight * rb, 9) AS m FROM d, (VALUES {', '.join(f'({g}::DOUBLE)' for g in GRID)}) v(weight)), {wauc_sql('t', 'g', 'replicate, label, weight', 'm')}, best AS (SELECT replicate, label, first(weight ORDER BY round(auc, 12) DESC, round(abs(weight - 0.5), 9), weight) AS weight FROM t WHERE auc IS NOT NULL GROUP BY replicate, label), md AS (SELECT label, first(weight ORDER BY n DESC, weight) AS mode FROM (SELECT label, weight, count(*) AS n FROM best GROUP BY ALL) GROUP BY label) SELECT label, quantile_cont(weight, 0.5) AS median, avg((weight > 0.5)::INT) AS above, mode FROM best JOIN md USING (label) GROUP BY label, mode")
def bootstrap_weights(spark, d):
    """Stability of the best weight"""
    t = resample.bootstrap_weights(_ranked_pair(spark, d), GRID, 0.5, 20)
    return t.select("label", "median", "above", "mode")


_U48 = "('0x' || substr(md5({}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0"


def draws_sql(source: str, n: int, leaf: int) -> str:
    """A CTE d: the rows of `source` (uid, label, y) with replicate and times, drawn by class in two levels."""
    key = "r || ':' || label || ':' || y || ':' || "
    return f"""pl AS (SELECT s.*, row_number() OVER (PARTITION BY label, y ORDER BY substr(md5(uid || ''), 1, 12), uid) - 1 AS place, count(*) OVER (PARTITION BY label, y) AS size FROM {source} s WHERE y IS NOT NULL),
lf AS (SELECT label, y, size, r, floor({_U48.format(key + 'place')} * size)::BIGINT // {leaf} AS leaf, count(*) AS m FROM pl, range({n}) x(r) GROUP BY ALL),
dr AS (SELECT label, y, r, leaf * {leaf} + floor({_U48.format("'leaf:' || " + key + "leaf || ':' || i")} * least({leaf}, size - leaf * {leaf}))::BIGINT AS place, count(*) AS times FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM lf) GROUP BY ALL),
d AS (SELECT pl.*, r AS replicate, times FROM pl JOIN dr ON pl.label = dr.label AND pl.y = dr.y AND pl.place = dr.place)"""


@query(f"WITH {MEMBERS_SQL}, m0 AS (SELECT uid, label, y, p FROM members WHERE member = 'm0'), {draws_sql('m0', 40, 64)}, {wauc_sql('t', 'd', 'replicate, label', 'p')}, q AS (SELECT avg(auc) AS a FROM t GROUP BY replicate) SELECT round(avg(a), 9) AS mean, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.975), 9) AS high, count(*) AS n FROM q")
def bootstrap_by_class(spark, d):
    """Stratified by class within each label"""
    drawn = resample.with_draws(one(spark, d).select("uid", "label", "y", "p"), 40, leaf=64)
    per = metrics.macro(resample.replicate_auc(drawn, ["label"], "y", "p", 40), ["replicate"])
    t = per.agg(F.avg("macro_auc").alias("mean"), F.expr("percentile(macro_auc, array(0.025, 0.975))").alias("q"), F.count("*").alias("n"))
    return t.select(R("mean").alias("mean"), R(F.col("q")[0]).alias("low"), R(F.col("q")[1]).alias("high"), "n")


@query(f"WITH {MEMBERS_SQL}, m0 AS (SELECT uid, label, y FROM members WHERE member = 'm0'), {draws_sql('m0', 20, 64)} SELECT label, y, replicate, sum(times)::BIGINT AS drawn, max(size) AS size, count(*) AS different FROM d GROUP BY label, y, replicate")
def class_draws(spark, d):
    """What each class of each replicate holds; `drawn` equals `size` in every row"""
    drawn = resample.with_draws(one(spark, d).select("uid", "label", "y"), 20, leaf=64)
    each = F.explode(F.array(*(F.struct((F.col("_block") * resample.TOGETHER + k).alias("replicate"), F.col(f"_w{k}").alias("times")) for k in range(resample.TOGETHER))))
    rows = drawn.select("label", "y", "_size", each.alias("r")).select("label", "y", "_size", "r.*").where("replicate < 20")
    return rows.groupBy("label", "y", "replicate").agg(F.sum("times").alias("drawn"), F.max("_size").alias("size"), F.count_if(F.col("times") > 0).alias("different"))


@query(f"WITH {_RANKED}, {_FIT}, pr AS (SELECT label, unnest([{{'k': 'default', 'w': 0.5::DOUBLE}}, {{'k': 'fitted', 'w': weight}}, {{'k': 'half', 'w': (weight + 0.5) / 2}}, {{'k': 'step', 'w': 0.5 + greatest(-0.1, least(0.1, weight - 0.5))}}, {{'k': 'against', 'w': 0.5 - (weight - 0.5) / 2}}]) AS s FROM fit), mx AS (SELECT s.k AS profile, z.label, z.y, round((1 - s.w) * ra + s.w * rb, 9) AS m FROM z JOIN pr USING (label)), {auc_sql('ap', 'mx', 'profile, label', 'y', 'm')}, mp AS (SELECT profile, avg(auc) AS a FROM ap GROUP BY profile) SELECT profile, round(a, 9) AS macro_auc, round(a - (SELECT a FROM mp WHERE profile = 'default'), 9) AS gain FROM mp")
def profile_comparison(spark, d):
    """G18"""
    rows = _ranked_pair(spark, d)
    w = resample.profiles(resample.fit_weights(rows, GRID, 0.5), 0.5)
    return resample.compare_profiles(rows, w).select("profile", R("macro_auc").alias("macro_auc"), R("gain").alias("gain"))


@query(f"WITH {MEMBERS_SQL}, h AS (SELECT m.uid, m.label, m.y, m.p, substr(m.member, 2, 1)::INT AS epoch, s AS split, CASE WHEN ('0x' || substr(md5('half:' || s || ':' || uid), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.5 THEN 'a' ELSE 'b' END AS half FROM members m, range(20) r(s)), {auc_sql('t', 'h', 'split, half, epoch, label', 'y', 'p')}, q AS (SELECT split, half, epoch, avg(auc) AS a FROM t GROUP BY ALL), ch AS (SELECT split, first(epoch ORDER BY round(a, 12) DESC, epoch) AS epoch FROM q WHERE half = 'a' GROUP BY split), b AS (SELECT * FROM q WHERE half = 'b') SELECT round(avg(b.a), 9) AS chosen, round(avg(l.last), 9) AS last, round(avg(l.oracle), 9) AS oracle, count(*) AS splits FROM ch JOIN b ON b.split = ch.split AND b.epoch = ch.epoch JOIN (SELECT split, max_by(a, epoch) AS last, max(a) AS oracle FROM b GROUP BY split) l ON l.split = ch.split")
def split_half_selection(spark, d):
    """G21"""
    m = members(spark, d).withColumn("epoch", F.substring("member", 2, 1).cast("int"))
    t = resample.split_half(m, 20)
    return t.select(R("chosen").alias("chosen"), R("last").alias("last"), R("oracle").alias("oracle"), "splits")


@query(f"WITH {MEMBERS_SQL}, {auc_sql('s1', 'members', 'member, label', 'y', 'p')}, sg AS (SELECT member, avg(auc) AS a FROM s1 GROUP BY member), {pct_sql('rk', 'members', 'member, label', 'p', 'r')}, tg AS (SELECT uid, label, max(y) AS y FROM members GROUP BY ALL), bb AS (SELECT uid, label, round(avg(r), 9) AS p FROM rk WHERE member <> 'm3' GROUP BY ALL), ba AS (SELECT uid, label, round(avg(r), 9) AS p FROM rk GROUP BY ALL), b1 AS (SELECT * FROM bb JOIN tg USING (uid, label)), b2 AS (SELECT * FROM ba JOIN tg USING (uid, label)), {auc_sql('x1', 'b1', 'label', 'y', 'p')}, {auc_sql('x2', 'b2', 'label', 'y', 'p')}, o AS (SELECT bb.uid, bb.label, bb.p AS a, m.p AS b FROM bb JOIN members m ON m.uid = bb.uid AND m.label = bb.label AND m.member = 'm3'), {SPEARMAN.format(k='label', t='o')}, rh AS (SELECT label, covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) AS rho FROM rx GROUP BY label), f AS (SELECT (SELECT a FROM sg WHERE member = 'm3') AS own, (SELECT max(a) FROM sg WHERE member <> 'm3') AS best, (SELECT avg(auc) FROM x1) AS base, (SELECT avg(auc) FROM x2) AS blend, (SELECT avg(rho) FROM rh) AS rho) SELECT round(own, 9) AS own, round(best, 9) AS best, round(base, 9) AS base, round(blend, 9) AS blend, round(rho, 9) AS rho, own >= best - 0.02 AND rho < 0.80 AND blend - base > 0.008 AS accepted FROM f")
def blend_check(spark, d):
    """G23"""
    t = composites.blend_check(members(spark, d), "m3")
    return t.select(*(R(c).alias(c) for c in ("own", "best", "base", "blend", "rho")), "accepted")


@query(f"WITH {MEMBERS_SQL}, {pct_sql('rk', 'members', 'member, label', 'p', 'r')}, b AS (SELECT x.member AS a, z.member AS b, x.uid, x.label, x.y, x.r AS xr, z.r AS zr, round((x.r + z.r) / 2, 9) AS m FROM rk x JOIN rk z ON x.uid = z.uid AND x.label = z.label AND x.member < z.member), {auc_sql('t', 'b', 'a, b, label', 'y', 'm')}, {auc_sql('s1', 'members', 'member, label', 'y', 'p')}, sg AS (SELECT member, avg(auc) AS v FROM s1 GROUP BY member), rh AS (SELECT a, b, avg(rho) AS rho FROM (SELECT a, b, label, covar_pop(xr, zr) / (stddev_pop(xr) * stddev_pop(zr)) AS rho FROM b GROUP BY a, b, label) GROUP BY a, b), q AS (SELECT a, b, avg(auc) AS v FROM t GROUP BY a, b) SELECT q.a, q.b, 'pair' AS kind, round(rho, 9) AS rho, round(q.v, 9) AS both, round(q.v - greatest(s.v, u.v), 9) AS gain FROM q JOIN rh ON q.a = rh.a AND q.b = rh.b JOIN sg s ON s.member = q.a JOIN sg u ON u.member = q.b")
def pair_study(spark, d):
    """G24, C12, D34"""
    t = composites.pair_study(members(spark, d))
    return t.select("a", "b", "kind", R("rho").alias("rho"), R("both").alias("both"), R("gain").alias("gain"))


@query(f"WITH {MEMBERS_SQL}, {pct_sql('rk', 'members', 'member, label', 'p', 'r')}, lo AS (SELECT x.member AS without, rk.uid, rk.label, max(rk.y) AS y, round(avg(rk.r), 9) AS p FROM (SELECT DISTINCT member FROM members) x JOIN rk ON rk.member <> x.member GROUP BY ALL), al AS (SELECT uid, label, max(y) AS y, round(avg(r), 9) AS p FROM rk GROUP BY ALL), {auc_sql('t', 'lo', 'without, label', 'y', 'p')}, {auc_sql('u', 'al', 'label', 'y', 'p')} SELECT without AS member, round((SELECT avg(auc) FROM u), 9) AS \"all\", round(avg(auc), 9) AS rest, round((SELECT avg(auc) FROM u) - avg(auc), 9) AS value FROM t GROUP BY without")
def marginal_value(spark, d):
    """G24"""
    t = composites.marginal_value(members(spark, d))
    return t.select("member", R("all").alias("all"), R("rest").alias("rest"), R("value").alias("value"))


_SUBSETS = f"""{members_sql(8)}, {pct_sql('rk', 'members', 'member, label', 'p', 'r')}, al AS (SELECT m AS mask, bit_count(m) AS k, row_number() OVER (PARTITION BY bit_count(m) ORDER BY m) - 1 AS at, count(*) OVER (PARTITION BY bit_count(m)) AS of FROM range(1, 256) x(m)),
dw AS (SELECT t, 2 + ('0x' || substr(md5('size:' || t), 1, 8))::BIGINT % 6 AS k FROM range(60) y(t)),
sub AS (SELECT mask, any_value(al.k)::INT AS size, count(*)::INT AS draws FROM dw JOIN al ON al.k = dw.k AND al.at = ('0x' || substr(md5('rank:' || t), 1, 12))::BIGINT % al.of GROUP BY mask),
bits AS (SELECT mask, 'm' || i AS member FROM sub, range(8) z(i) WHERE (mask >> i) & 1 = 1),
sm AS (SELECT mask, uid, label, max(y) AS y, round(avg(r), 9) AS p FROM rk JOIN bits USING (member) GROUP BY ALL), {auc_sql('t', 'sm', 'mask, label', 'y', 'p')}, {auc_sql('s1', 'members', 'member, label', 'y', 'p')},
sg AS (SELECT member, avg(auc) AS a FROM s1 GROUP BY member),
rh AS (SELECT a, b, avg(rho) AS rho FROM (SELECT x.member AS a, z.member AS b, x.label, covar_pop(x.r, z.r) / (stddev_pop(x.r) * stddev_pop(z.r)) AS rho FROM rk x JOIN rk z ON x.uid = z.uid AND x.label = z.label AND x.member < z.member GROUP BY ALL) GROUP BY a, b),
st AS (SELECT sub.mask, size, draws, (SELECT string_agg(member, ',' ORDER BY member) FROM bits WHERE bits.mask = sub.mask) AS members, (SELECT avg(rho) FROM rh JOIN bits p ON p.member = rh.a JOIN bits q ON q.member = rh.b AND q.mask = p.mask WHERE p.mask = sub.mask) AS rho,
  (SELECT avg(auc) FROM t WHERE t.mask = sub.mask) AS macro_auc, (SELECT avg(a) FROM sg JOIN bits USING (member) WHERE bits.mask = sub.mask) AS solo FROM sub)"""


@query(f"WITH {_SUBSETS} SELECT mask, members, size, draws, round(rho, 9) AS rho, round(macro_auc, 9) AS macro_auc, round(solo, 9) AS solo, round(macro_auc - solo, 9) AS gain FROM st")
def subset_study(spark, d):
    """Random subsets of eight members"""
    t = composites.subset_study(members(spark, d, 8), 60)
    return t.select("mask", "members", "size", "draws", *(R(c).alias(c) for c in ("rho", "macro_auc", "solo", "gain")))


@query(f"WITH {_SUBSETS}, w AS (SELECT m.member, sum(macro_auc * draws) FILTER (list_contains(string_split(members, ','), m.member)) / sum(draws) FILTER (list_contains(string_split(members, ','), m.member)) AS a, sum(macro_auc * draws) FILTER (NOT list_contains(string_split(members, ','), m.member)) / sum(draws) FILTER (NOT list_contains(string_split(members, ','), m.member)) AS b FROM st, (SELECT DISTINCT member FROM bits) m GROUP BY m.member) SELECT member, round(a, 9) AS \"with\", round(b, 9) AS without, round(a - b, 9) AS value FROM w")
def subset_margins(spark, d):
    """What a member adds over random subsets"""
    t = composites.subset_margins(composites.subset_study(members(spark, d, 8), 60))
    return t.select("member", *(R(c).alias(c) for c in ("with", "without", "value")))


@query(f"WITH {_SUBSETS}, o AS (SELECT macro_auc - solo AS g, 1 - rho AS x, ln(size) AS z FROM st, range(draws)), c AS (SELECT var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, g) AS xg, covar_pop(z, g) AS zg, avg(x) AS mx, avg(z) AS mz, avg(g) AS mg, var_pop(g) AS gg FROM o), b AS (SELECT *, (xg * zz - zg * xz) / (xx * zz - xz * xz) AS bx, (zg * xx - xg * xz) / (xx * zz - xz * xz) AS bz FROM c) SELECT round(mg - bx * mx - bz * mz, 6) AS intercept, round(bx, 6) AS apart, round(bz, 6) AS ln_size, round((bx * xg + bz * zg) / gg, 6) AS r2 FROM b")
def subset_model(spark, d):
    """The gain of a subset by how far apart its members are and how many"""
    t = composites.subset_model(composites.subset_study(members(spark, d, 8), 60))
    of = lambda term: R(F.max(F.when(F.col("term") == term, F.col("coef"))), 6)
    return t.agg(of("1").alias("intercept"), of("apart").alias("apart"), of("ln_size").alias("ln_size"), R(F.max("r2"), 6).alias("r2"))


@query(f"WITH {MEMBERS_SQL}, {ONE} SELECT round(regr_intercept(b, a), 7) AS intercept, round(regr_slope(b, a), 7) AS slope, round(regr_r2(b, a), 7) AS r2 FROM o")
def ols_fit(spark, d):
    """D35"""
    t = resample.ols(pair(spark, d), "b", ["a"])
    return t.agg(R(F.max(F.when(F.col("term") == "1", F.col("coef"))), 7).alias("intercept"), R(F.max(F.when(F.col("term") == "a", F.col("coef"))), 7).alias("slope"), R(F.max("r2"), 7).alias("r2"))


@query(f"WITH {MEMBERS_SQL}, {ONE}, t AS (SELECT uid, label, b AS y2, a AS p FROM o), h AS (SELECT *, (y2 > 0.5)::INT AS hard FROM t), {auc_sql('u', 'h', 'label', 'hard', 'p')}, {SPEARMAN.format(k='label', t='o')}, rh AS (SELECT label, covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) AS rho FROM rx GROUP BY label), rt AS (SELECT label, count(*) FILTER (p >= 0.5 AND hard = 1)::DOUBLE / count(*) FILTER (hard = 1) AS sensitivity, count(*) FILTER (p < 0.5 AND hard = 0)::DOUBLE / count(*) FILTER (hard = 0) AS specificity FROM h GROUP BY label) SELECT label, round(auc, 9) AS auc, round(rho, 9) AS rho, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity, auc < 0.75 AS low, round((SELECT avg(auc) FROM u), 9) AS macro_auc, (SELECT avg(auc) FROM u) >= 0.85 AS plausible FROM u JOIN rh USING (label) JOIN rt USING (label)")
def plausibility(spark, d):
    """G27, C2, B15"""
    o = pair(spark, d)
    t = audit.plausibility(o.select("uid", "label", F.col("a").alias("p")), o.select("uid", "label", F.col("b").alias("y")))
    return t.select("label", R("auc").alias("auc"), R("rho").alias("rho"), R("sensitivity").alias("sensitivity"), R("specificity").alias("specificity"), "low", R("macro_auc").alias("macro_auc"), "plausible")


@query(f"WITH {MEMBERS_SQL}, st(vs, member) AS (VALUES ('a', 'm0'), ('a', 'm1'), ('b', 'm2'), ('b', 'm3'), ('c', 'm0'), ('c', 'm3')), v AS (SELECT vs, uid, label, round(avg(p), 12) AS p, max(y) AS y FROM members JOIN st USING (member) GROUP BY ALL), {auc_sql('t', 'v', 'vs, label', 'y', 'p')} SELECT vs AS \"set\", round(avg(auc), 9) AS macro_auc, count(auc) AS n_labels FROM t GROUP BY vs")
def crop_sets(spark, d):
    """G33"""
    m = members(spark, d)
    sets = spark.createDataFrame([("a", "m0"), ("a", "m1"), ("b", "m2"), ("b", "m3"), ("c", "m0"), ("c", "m3")], "set string, view string")
    target = m.groupBy("uid", "label").agg(F.max("y").alias("y"))
    return audit.set_comparison(m.select(F.col("member").alias("view"), "uid", "label", "p"), sets, target).select("set", R("macro_auc").alias("macro_auc"), "n_labels")


@query(f"WITH {MEMBERS_SQL}, m AS (SELECT uid, label, p FROM members WHERE member = 'm0' AND uid % 20 <> 3), t AS (SELECT DISTINCT uid, label FROM members) SELECT t.uid, t.label, m.p IS NULL AS filled, round(coalesce(m.p, 0.5), 9) AS p FROM t LEFT JOIN m USING (uid, label)")
def submission_fill(spark, d):
    """G34, C4"""
    m = members(spark, d)
    filled, _ = composites.submission(m.select("uid", "label").distinct(), one(spark, d).where("uid % 20 <> 3").select("uid", "label", "p"))
    return filled.select("uid", "label", "filled", R("p").alias("p"))


@query(f"WITH {SOURCES_SQL}, {GOLD_SQL}, j AS (SELECT s.*, g.y FROM sources s JOIN gold g USING (uid, label)), {auc_sql('t', 'j', 'source, label', 'y', 'value')} SELECT source, label, round(auc, 9) AS auc, n_pos, n_neg FROM t")
def source_scores(spark, d):
    """G1 (scores before the override)"""
    t = composites.score_sources(sources(spark, d), gold(spark, d))
    return t.select("source", "label", R("auc").alias("auc"), "n_pos", "n_neg")


@query(f"WITH {MEMBERS_SQL}, {ONE}, {SPEARMAN.format(k='label', t='o')}, r AS (SELECT covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) AS rho FROM rx GROUP BY label) SELECT round(avg(rho), 9) AS mean, round(min(rho), 9) AS least, count(*) FILTER (rho IS NULL) AS unknown FROM r HAVING avg(rho) < 0.9 OR min(rho) < 0.5")
def rank_floor(spark, d):
    """H6"""
    return quality.rank_floor(metrics.spearman(pair(spark, d), ["label"], "a", "b"), 0.9, 0.5).select(R("mean").alias("mean"), R("least").alias("least"), "unknown")


def _audit_sql(n: int) -> str:
    from sievework.plans.queries_tables import CONF

    err = [f"CASE WHEN is_gold AND v{k} IS NOT NULL THEN ((v{k} >= 0.5) <> (y > 0.5))::INT END" for k in range(3)]
    gold_cells = "CASE WHEN is_gold THEN y END"
    by_label = [(2, "gold_rate", None, None, f"avg({gold_cells})"), (2, "unk", None, None, "avg(unk::INT)"), (2, "yes", None, None, "avg(coalesce(verdict = 'YES', FALSE)::INT)")]
    by_label += [(2, "blend_positive", None, None, "avg((blend >= 0.5)::INT)"), (2, "blend_unk", None, None, "avg(blend) FILTER (unk)"), (2, "w_unk", None, None, "avg(w) FILTER (unk)"), (2, "w_addressed", None, None, "avg(w) FILTER (NOT unk)"), (2, "at_floor", None, None, "avg((w <= 0.15 + 1e-9)::INT)")]
    for k in range(3):
        by_label += [(2, "positive", f"s{k + 1}", None, f"avg((v{k} >= 0.5)::INT)"), (2, "value_unk", f"s{k + 1}", None, f"avg(v{k}) FILTER (unk)"), (3, "error", f"s{k + 1}", None, f"avg({err[k]})")]
    pairs = [(0, 1), (0, 2), (1, 2)]
    for i, j in pairs:
        x, z = (f"(CASE WHEN {err[i]} IS NOT NULL AND {err[j]} IS NOT NULL THEN {err[o]} END)" for o in (i, j))
        by_label.append((3, "error_phi", f"s{i + 1}", f"s{j + 1}", f"CASE WHEN stddev_pop({x}) * stddev_pop({z}) > 1e-12 THEN covar_pop({x}, {z}) / (stddev_pop({x}) * stddev_pop({z})) END"))
    q = lambda v: "NULL" if v is None else f"'{v}'"
    parts = [f"SELECT {sec} AS section, NULL AS lang, label, {q(a)} AS a, {q(b)} AS b, '{m}' AS measure, ({x})::DOUBLE AS value FROM b GROUP BY label" for sec, m, a, b, x in by_label]
    parts += [f"SELECT 1, lang, NULL, NULL, NULL, '{m}', ({x})::DOUBLE FROM b GROUP BY lang" for m, x in (("studies", "count(*) FILTER (first)"), ("gold", "count(*) FILTER (first AND is_gold)"), ("share", "count(*) FILTER (first)::DOUBLE / (SELECT count(*) FROM b WHERE first)"))]
    parts += ["SELECT 1, NULL, NULL, NULL, NULL, 'all_studies', (count(*) FILTER (first))::DOUBLE FROM b"]
    parts += [f"SELECT 3, NULL, NULL, 's{i + 1}', 's{j + 1}', 'agreement', avg(((v{i} >= 0.5) = (v{j} >= 0.5))::INT) FROM b" for i, j in pairs]
    parts += ["SELECT 4, lang, label, NULL, NULL, 'unk', avg(unk::INT) FROM b GROUP BY lang, label", "SELECT 4, lang, label, NULL, NULL, 'cells', count(*)::DOUBLE FROM b GROUP BY lang, label"]
    parts += ["SELECT 4, lang, NULL, 's1', 's2', 'spearman', avg(rho) FROM rho GROUP BY lang"]
    for m, x in (("unaddressed", "avg(unk::INT)"), ("n", "count(*) FILTER (unk)"), ("gold_unaddressed", "count(*) FILTER (unk AND is_gold)"), ("gold_unaddressed_positive", "count(*) FILTER (unk AND is_gold AND y > 0.5)"), ("w_before", "avg(w) FILTER (unk)"), ("w_after", "avg(CASE WHEN unk AND dv IS NOT NULL THEN dw ELSE w END) FILTER (unk)")):
        parts.append(f"SELECT 5, NULL, 'toxic', 'quality', NULL, '{m}', ({x})::DOUBLE FROM bf")
    se = "sqrt(greatest(auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc), 0) / (n_pos * n_neg))"
    parts += ["SELECT 5, NULL, 'toxic', 'quality', NULL, 'auc_' || which, auc FROM sc", f"SELECT 5, NULL, 'toxic', 'quality', NULL, 'se_' || which, {se} FROM sc"]
    parts += [f"SELECT 5, NULL, 'toxic', 'quality', NULL, '{m}', {x} FROM gn" for m, x in (("delta", "avg(g)"), ("delta_low", "quantile_cont(g, 0.025)"), ("delta_high", "quantile_cont(g, 0.975)"))]
    tri = "SELECT x.uid, x.label AS a, z.label AS c, x.{v} AS s, z.{v} AS t FROM co x JOIN co z ON x.uid = z.uid AND x.label < z.label WHERE x.{v} IS NOT NULL AND z.{v} IS NOT NULL"
    phi = "CASE WHEN stddev_pop(s) * stddev_pop(t) > 1e-12 THEN covar_pop(s, t) / (stddev_pop(s) * stddev_pop(t)) END"
    parts += [f"SELECT 6, NULL, a, c, NULL, 'phi_gold', {phi} FROM ({tri.format(v='g')}) GROUP BY a, c", f"SELECT 6, NULL, c, a, NULL, 'phi_weak', {phi} FROM ({tri.format(v='w')}) GROUP BY a, c"]
    return f"""WITH {SOURCES_SQL}, {GOLD_SQL}, cell AS (
  SELECT uid, lang, label, max(value) FILTER (source = 's1') AS v0, max(value) FILTER (source = 's2') AS v1, max(value) FILTER (source = 's3') AS v2, max(verdict) FILTER (source = 's1') AS verdict,
         avg(value) AS blend, {CONF.format(s='stddev_pop(value)', m='avg(value)')} AS w FROM sources GROUP BY uid, lang, label),
b AS (SELECT c.*, g.y, count(g.y) OVER (PARTITION BY c.uid, c.lang) = count(*) OVER (PARTITION BY c.uid, c.lang) AS is_gold, row_number() OVER (PARTITION BY c.uid, c.lang ORDER BY c.label) = 1 AS first,
             coalesce(verdict = 'UNK', FALSE) AS unk FROM cell c LEFT JOIN gold g ON g.uid = c.uid AND g.label = c.label),
rk AS (SELECT lang, label, rank() OVER (PARTITION BY lang, label ORDER BY v0) + (count(*) OVER (PARTITION BY lang, label, v0) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang, label ORDER BY v1) + (count(*) OVER (PARTITION BY lang, label, v1) - 1) / 2.0 AS z FROM b WHERE v0 IS NOT NULL AND v1 IS NOT NULL),
rho AS (SELECT lang, label, CASE WHEN count(*) > 20 AND stddev_pop(x) * stddev_pop(z) > 1e-12 THEN covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) END AS rho FROM rk GROUP BY lang, label),
bf AS (SELECT t.*, d.blend AS dv, d.w AS dw, CASE WHEN t.unk AND d.blend IS NOT NULL THEN d.blend ELSE t.blend END AS new FROM b t LEFT JOIN b d ON d.uid = t.uid AND d.label = 'quality' WHERE t.label = 'toxic'),
kn AS (SELECT uid, label, (y > 0.5)::INT AS y, blend AS old, new FROM bf WHERE is_gold),
un AS (SELECT 'old' AS which, y, old AS p FROM kn UNION ALL SELECT 'new', y, new FROM kn), {auc_sql('sc', 'un', 'which', 'y', 'p')},
{_DRAWS.format(t='kn', n=n, p=_POISSON)}, dold AS (SELECT * FROM d WHERE old IS NOT NULL), dnew AS (SELECT * FROM d WHERE new IS NOT NULL), {wauc_sql('ao', 'dold', 'replicate, label', 'old')}, {wauc_sql('an', 'dnew', 'replicate, label', 'new')},
gn AS (SELECT an.auc - ao.auc AS g FROM an JOIN ao ON an.replicate = ao.replicate),
co AS (SELECT uid, label, CASE WHEN is_gold THEN (y > 0.5)::INT::DOUBLE END AS g, (blend >= 0.5)::INT::DOUBLE AS w FROM b),
long AS ({' UNION ALL '.join(parts)})
SELECT section, lang, label, a, b, measure, round(value, 9) AS value FROM long"""


@query(_audit_sql(30))
def label_audit(spark, d):
    """Six sections in one table"""
    t = audit.label_audit(sources(spark, d), gold(spark, d), ["s1", "s2", "s3"], "s1", ("toxic", "quality"), replicates=30)
    return t.select("section", "lang", "label", "a", "b", "measure", R("value").alias("value"))
