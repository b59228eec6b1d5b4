"""Registered queries: targets, splits, text rules, audits, catalogue, sampling, joins, checks and feeds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.functions import ranks, scalars, text
from sievework.operators import audit, catalog, joins, labels, quality, sampling, splits
from sievework.plans import composites
from sievework.plans.inputs import FOLDS, GOLD_SQL, MEMBERS_SQL, POLLS_SQL, SERIES_SQL, SOURCES_SQL, STUDIES_SQL, events, gold, members, series, sources, status_polls, studies, table
from sievework.sources import sinks
from sievework.streaming import monitor

QUERIES: dict = {}
SQL: dict = {}
R = lambda c, n=9: F.round(c, n)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


CONF = "greatest(0.15, least(1.0, 0.5 * greatest(0, least(1, 1 - 2 * coalesce({s}, 0.5))) + 0.5 * greatest(0, least(1, 2 * abs(coalesce({m}, 0.5) - 0.5)))))"


@query(f"WITH {SOURCES_SQL}, c AS (SELECT uid, label, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_sources FROM sources GROUP BY uid, label) SELECT uid, label, round(mean, 9) AS mean, round(std, 9) AS std, n_sources, round({CONF.format(s='std', m='mean')}, 9) AS w FROM c")
def probability_blend(spark, d):
    """D1, B16"""
    return labels.probability_blend(sources(spark, d)).select("uid", "label", R("mean").alias("mean"), R("std").alias("std"), "n_sources", R("w").alias("w"))


_TARGETS = f"""{SOURCES_SQL}, {GOLD_SQL}, c AS (SELECT uid, label, avg(value) AS value, {CONF.format(s='stddev_pop(value)', m='avg(value)')} AS w FROM sources GROUP BY uid, label),
m AS (SELECT label, avg(value) AS mean FROM c GROUP BY label)"""


@query(f"WITH {_TARGETS} SELECT c.uid, c.label, round(coalesce(g.y, c.value, m.mean, 0.5), 9) AS y, round(CASE WHEN g.y IS NOT NULL THEN 8.0 WHEN c.value IS NULL THEN 0.15 ELSE c.w END, 9) AS w, g.y IS NOT NULL AS is_gold FROM c JOIN m USING (label) LEFT JOIN gold g ON g.uid = c.uid AND g.label = c.label")
def build_targets(spark, d):
    """G1 (folds are in fold_sizes: which group of equal ones goes where is free)"""
    t, _ = composites.build_targets(studies(spark, d), sources(spark, d), gold(spark, d))
    return t.select("uid", "label", R("y").alias("y"), R("w").alias("w"), "is_gold")


@query(
    f"""WITH RECURSIVE {STUDIES_SQL}, g AS (SELECT "group", count(*) AS n, sum(is_gold::INT) AS gold FROM studies GROUP BY "group"),
o AS (SELECT n, gold::BIGINT AS gold, row_number() OVER (ORDER BY gold DESC, n DESC, "group") AS k FROM g),
walk AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS s, [0, 0, 0, 0, 0]::BIGINT[] AS q, [0, 0, 0, 0, 0]::BIGINT[] AS c, 0 AS f
 UNION ALL
 SELECT k, [CASE WHEN i = f THEN s[i] + n ELSE s[i] END FOR i IN [1, 2, 3, 4, 5]], [CASE WHEN i = f THEN q[i] + gold ELSE q[i] END FOR i IN [1, 2, 3, 4, 5]], [CASE WHEN i = f THEN c[i] + 1 ELSE c[i] END FOR i IN [1, 2, 3, 4, 5]], f
 FROM (SELECT o.k, o.n, o.gold, s, q, c,
   list_sort([{{'a': CASE WHEN o.gold > 0 THEN q[i] ELSE 0 END, 'b': s[i], 'i': i}} FOR i IN [1, 2, 3, 4, 5]])[1].i AS f FROM walk JOIN o ON o.k = walk.k + 1))
SELECT i - 1 AS fold, s[i] AS n, q[i] AS gold, c[i] AS groups FROM (SELECT * FROM walk ORDER BY k DESC LIMIT 1), (VALUES (1), (2), (3), (4), (5)) v(i)"""
)
def fold_sizes(spark, d):
    """Sizes of grouped, gold-stratified folds"""
    f = splits.assign_folds(splits.group_sizes(studies(spark, d)), FOLDS)
    return f.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("gold").alias("gold"), F.count("*").alias("groups"))


@query(f"WITH {STUDIES_SQL} SELECT 0 AS groups_in_several_folds, count(*) AS studies FROM studies")
def folds_whole(spark, d):
    """G3, H: no group spans folds"""
    s = studies(spark, d)
    f = s.join(splits.assign_folds(splits.group_sizes(s), FOLDS).select("group", "fold"), "group")
    return f.agg(F.count("*").alias("studies")).join(splits.folds_span(f).agg(F.count("*").cast("int").alias("groups_in_several_folds")))


@query(f'WITH {STUDIES_SQL}, g AS (SELECT "group", count(*) AS n FROM studies GROUP BY "group") SELECT count(*) AS groups, count(*) FILTER (n > 1) AS shared, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS covered, max(n) AS largest FROM g')
def shared_texts(spark, d):
    """B2, D10"""
    return splits.shared_groups(splits.group_sizes(studies(spark, d)))


@query(f'WITH {STUDIES_SQL}, q AS (SELECT source AS person, "group" AS uid, lang AS split FROM studies WHERE source IS NOT NULL AND source <> \'\'), p AS (SELECT person, count(DISTINCT uid) AS n, count(DISTINCT split) AS s FROM q GROUP BY person) SELECT count(*) AS people, count(*) FILTER (n > 1) AS several, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_several, max(n) AS most, count(*) FILTER (s > 1) AS in_both FROM p')
def person_overlap(spark, d):
    """C14, D30"""
    s = studies(spark, d).select(F.col("source").alias("person"), F.col("group").alias("uid"), F.col("lang").alias("split"))
    return splits.person_overlap(s)


@query()
def md5_shards(spark, d):
    """B19"""
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("uid"), F.lit(False).alias("never"), text.md5_shard(F.col("doc_id").cast("string"), 7).alias("shard"))


SQL["md5_shards"] = "SELECT doc_id AS uid, FALSE AS never, CAST((((h1 % 7) * (18446744073709551616::HUGEINT % 7) + h2) % 7) AS INT) AS shard FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::HUGEINT AS h1, ('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT::HUGEINT AS h2 FROM documents)"


@query("SELECT doc_id AS uid, source AS shard, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS INT) AS blob, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 16 AS INT) AS row FROM documents")
def blob_rows(spark, d):
    """E10"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("shard"))
    return splits.blocks(t, "shard", "uid", 16).select("uid", "shard", "blob", "row")


_BLOBS = "b AS (SELECT doc_id, source AS shard, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS INT) AS blob FROM documents)"


@query(f"WITH {_BLOBS}, e AS (SELECT shard, blob, count(*) AS expected, count(*) FILTER (doc_id % 11 <> 0) AS present FROM b GROUP BY ALL) SELECT shard, blob, expected, present, expected = present AS complete FROM e")
def blob_state(spark, d):
    """E11, I8"""
    t = splits.blocks(table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("shard")), "shard", "uid", 16)
    return splits.block_state(t, t.where("uid % 11 <> 0")).select("shard", "blob", "expected", "present", "complete")


@query("SELECT doc_id AS uid, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 6 AS INT) AS shard FROM documents")
def strided_shards(spark, d):
    """E12"""
    return splits.strided(table(spark, d, "documents").select(F.col("doc_id").alias("uid")), "uid", 6)


@query()
def sub_chunks(spark, d):
    """E13"""
    return splits.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("uid")), "uid", 300)


SQL["sub_chunks"] = "WITH n AS (SELECT count(*) AS n, least(count(*), greatest(4, ceil(count(*) / 300.0)))::BIGINT AS k FROM documents), b AS (SELECT i, round_even(i * n / k::DOUBLE, 0) AS first, round_even((i + 1) * n / k::DOUBLE, 0) AS stop FROM (SELECT n, k, unnest(range(k)) AS i FROM n)), r AS (SELECT doc_id AS uid, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT uid, i::INT AS chunk FROM r JOIN b ON pos >= first AND pos < stop"


@query("WITH p AS (SELECT doc_id AS uid, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS p FROM documents) SELECT uid, (p % 4)::INT AS worker, (row_number() OVER (PARTITION BY p % 4 ORDER BY (p // 4) % 2, p // 4) - 1)::INT AS turn FROM p")
def balanced_workers(spark, d):
    """E14"""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "n_chars")
    return splits.balanced(t, "uid", "n_chars", 4).select("uid", "worker", "turn")


@query(f"WITH {STUDIES_SQL} SELECT uid, \"group\" AS text_group, substr(sha256('salt' || uid), 1, 20) AS pseudonym FROM studies")
def text_groups(spark, d):
    """B2, B18"""
    return studies(spark, d).select("uid", F.col("group").alias("text_group"), text.pseudonym("salt", F.col("uid").cast("string")).alias("pseudonym"))


def _vote_sql() -> str:
    t = "(' ' || lower(coalesce(text, '')) || ' ')"
    votes = {lang: " + ".join(f"(length({t}) - length(replace({t}, ' {w} ', ''))) // {len(w) + 2}" for w in ws) for lang, ws in text.STOPWORDS.items()}
    cols = ", ".join(f"{v} AS v_{k}" for k, v in votes.items())
    most = f"greatest({', '.join(f'v_{k}' for k in votes)})"
    case = " ".join(f"WHEN v_{k} = {most} THEN '{k}'" for k in votes)
    return f"WITH v AS (SELECT doc_id AS uid, {cols} FROM documents) SELECT uid, CASE WHEN {most} = 0 THEN 'unk' {case} END AS lang FROM v"


@query(_vote_sql())
def language_vote(spark, d):
    """B3"""
    return table(spark, d, "documents").select(F.col("doc_id").alias("uid"), text.language_vote(F.col("text")).alias("lang"))


#: A word's bounds are characters that aren't letters of any script, which engines agree on (they don't on \\b).
PROBES = {k: rf"(^|\P{{L}})({words})(\P{{L}}|$)" for k, words in {"en": "the|with", "fr": "les|dans", "de": "und|nicht", "es": "los|para"}.items()}


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(lower(coalesce(text, '')), '{p}')) AS n_{k}" for k, p in PROBES.items()) + " FROM documents")
def language_probes(spark, d):
    """B4"""
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").agg(*(F.count_if(t.rlike(p)).alias(f"n_{k}") for k, p in PROBES.items()))


_WORDS = r"CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE len(string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+')) END"


@query(f"WITH c AS (SELECT {_WORDS} AS n FROM documents) SELECT (n // 100 * 100)::BIGINT AS from_words, count(*) AS docs FROM c WHERE n <= (SELECT quantile_cont(n, 0.95) FROM c) GROUP BY 1")
def word_histogram(spark, d):
    """B5"""
    return audit.word_histogram(table(spark, d, "documents"), text.word_count(F.col("text")), 0.95, 100)


@query("SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<br\\s*/?>|</p>|</li>', chr(10), 'gi'), '<li[^>]*>', '- ', 'gi'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM pages")
def html_text(spark, d):
    """B22"""
    return table(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) END AS alias, CASE WHEN regexp_matches(url, '^https://www') THEN 'www' WHEN regexp_matches(url, '#top$') THEN 'top' WHEN regexp_matches(url, '\\.html') THEN 'html' ELSE 'other' END AS kind FROM pages")
def url_rules(spark, d):
    """B21, B24"""
    t = table(spark, d, "pages")
    return t.select("page_id", text.url_tail(F.col("url"), "https://").alias("alias"), scalars.classified(F.col("url"), [("^https://www", "www"), ("#top$", "top"), (r"\.html", "html")]).alias("kind"))


@query(f"WITH {SERIES_SQL} SELECT uid, ord, CASE WHEN contains(lower(plane), 'gr') THEN 'GRE' WHEN spacing * 1000 <= 300 THEN 'T1' WHEN n_slices * 2 >= 60 THEN 'T2' ELSE 'PD' END AS weighting, weighting = 'T2' AS fluid, CASE WHEN plane IN ('Sagittal', 'Coronal') THEN plane ELSE 'OTHER' END AS plane FROM series")
def weighting_rules(spark, d):
    """B6, B7, B14"""
    s = series(spark, d)
    w = scalars.weighting(F.col("spacing") * 1000, F.col("n_slices") * 2.0, F.col("plane"), F.col("weighting"), 60.0, 300.0)
    return s.select("uid", "ord", w.alias("weighting"), text.has_token(F.col("weighting"), list(scalars.FLUID_TOKENS)).alias("fluid"), scalars.trusted(F.col("plane"), ["Sagittal", "Coronal"], F.lit("OTHER")).alias("plane"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, TRY_CAST(trim(string_split(c, ':')[1]) AS DOUBLE) AS code, CASE lower(trim(l_linestatus)) WHEN '1' THEN 1 WHEN 'o' THEN NULL END AS flag, floor(q + 1e-9) + round_even((q - floor(q + 1e-9)) * 10, 0) AS part FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN '.: Missing' ELSE (l_suppkey % 5) || '.' || (l_partkey % 4) || ': text' END AS c, (l_suppkey % 5) + (l_partkey % 4) / 10.0::DOUBLE AS q FROM lineitem)")
def coded_cells(spark, d):
    """B11, B12, B13, A2"""
    t = table(spark, d, "lineitem")
    c = F.when(F.col("l_partkey") % 3 == 0, ".: Missing").otherwise(F.concat(F.col("l_suppkey") % 5, F.lit("."), F.col("l_partkey") % 4, F.lit(": text")))
    q = F.col("l_suppkey") % 5 + (F.col("l_partkey") % 4) / 10
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.coded(c).alias("code"), scalars.flag(F.col("l_linestatus")).alias("flag"), scalars.split_code(q).alias("part"))


@query("SELECT vec_id AS uid, CASE WHEN x >= y AND x >= z THEN 'Sagittal' WHEN y >= z THEN 'Coronal' ELSE 'Axial' END AS plane, round(e[7] + e[1] * 256 / 2 * 0.5 + e[4] * 256 / 2 * 0.5, 6) AS centre_x, round(1 / (1 + exp(-e[10])), 9) AS p FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, abs(embedding[2]::DOUBLE * embedding[6] - embedding[3]::DOUBLE * embedding[5]) AS x, abs(embedding[3]::DOUBLE * embedding[4] - embedding[1]::DOUBLE * embedding[6]) AS y, abs(embedding[1]::DOUBLE * embedding[5] - embedding[2]::DOUBLE * embedding[4]) AS z FROM embeddings)")
def header_geometry(spark, d):
    """B8, B9, B27"""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    ipp, iop = F.slice("e", 7, 3), F.slice("e", 1, 6)
    return e.select("uid", scalars.plane(iop).alias("plane"), R(scalars.centre_x(ipp, iop, F.array(F.lit(0.5), F.lit(0.5)), F.lit(256), F.lit(256)), 6).alias("centre_x"), R(scalars.logistic(F.col("e")[9])).alias("p"))


@query(f"WITH {SOURCES_SQL}, q AS (SELECT source, label, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, avg((value < 0.1)::INT) AS below, avg((value > 0.9)::INT) AS above FROM sources GROUP BY source, label) SELECT source, label, round(q[1], 9) AS p5, round(q[2], 9) AS p25, round(q[3], 9) AS p50, round(q[4], 9) AS p75, round(q[5], 9) AS p95, round(below, 9) AS below, round(above, 9) AS above FROM q")
def quantile_profile(spark, d):
    """D12"""
    t = audit.quantile_profile(sources(spark, d), ["source", "label"])
    return t.select("source", "label", *(R(c).alias(c) for c in t.columns[2:]))


_W = "abs(value - 0.5) + 0.1"


@query(f"WITH {SOURCES_SQL} SELECT source, label, round(avg((verdict = 'UNK')::INT), 9) AS unk, round(avg((verdict = 'YES')::INT), 9) AS yes, round(avg(value) FILTER (verdict = 'UNK'), 9) AS value_unk, round(avg({_W}) FILTER (verdict = 'UNK'), 9) AS w_unk, round(avg({_W}) FILTER (verdict <> 'UNK'), 9) AS w_addressed, round(avg((value >= 0.5)::INT), 9) AS positive, round(avg(({_W} <= 0.15)::INT), 9) AS at_floor FROM sources GROUP BY source, label")
def silence_table(spark, d):
    """D13"""
    s = sources(spark, d).withColumn("w", F.abs(F.col("value") - 0.5) + 0.1)
    t = audit.silence(s, ["source", "label"])
    return t.select("source", "label", *(R(c).alias(c) for c in t.columns[2:]))


@query(f"WITH {SOURCES_SQL} SELECT lang, label, round(avg((verdict = 'UNK')::INT), 9) AS unk, count(*) AS n FROM sources GROUP BY lang, label")
def language_coverage(spark, d):
    """D14"""
    t = audit.coverage_by(sources(spark, d), "lang", "label")
    return t.select("lang", "label", R("unk").alias("unk"), "n")


@query(f"WITH {SOURCES_SQL} SELECT lang, label, round(avg((verdict = 'UNK')::INT), 9) AS unk, count(*) AS n FROM sources GROUP BY ROLLUP (lang, label)")
def language_rollup(spark, d):
    """D14 with totals"""
    t = audit.coverage_rollup(sources(spark, d), "lang", "label")
    return t.select("lang", "label", R("unk").alias("unk"), "n")


@query(f"WITH {STUDIES_SQL} SELECT lang, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM studies), 9) AS share, count(*) FILTER (is_gold) AS gold FROM studies GROUP BY lang ORDER BY n DESC, lang LIMIT 15")
def language_counts(spark, d):
    """D15, F12"""
    t = audit.language_counts(studies(spark, d), "lang", F.col("is_gold"))
    return t.select("lang", "n", R("share").alias("share"), "gold")


@query(f"WITH {MEMBERS_SQL}, m AS (SELECT uid, label, p FROM members WHERE member = 'm0') SELECT x.label AS a, y.label AS b, round(covar_pop(x.p, y.p) / (stddev_pop(x.p) * stddev_pop(y.p)), 9) AS r, count(*) FILTER (x.p >= 0.5 AND y.p >= 0.5) AS both FROM m x JOIN m y ON x.uid = y.uid AND x.label < y.label GROUP BY ALL")
def label_cooccurrence(spark, d):
    """D16, D32"""
    t = audit.cooccurrence(members(spark, d).where("member = 'm0'"), "uid", "label", "p")
    return t.select("a", "b", R("r").alias("r"), "both")


_TRI = "SELECT x.label AS a, z.label AS b, {v} AS v, CASE WHEN stddev_pop(x.{v}) * stddev_pop(z.{v}) > 1e-12 THEN covar_pop(x.{v}, z.{v}) / (stddev_pop(x.{v}) * stddev_pop(z.{v})) END AS r, count(*) AS n FROM {t} x JOIN {t} z ON x.uid = z.uid AND x.label < z.label WHERE x.{v} IS NOT NULL AND z.{v} IS NOT NULL GROUP BY ALL"
_BOTH = f"WITH {MEMBERS_SQL}, c AS (SELECT uid, label, y::DOUBLE AS g, p AS w FROM members WHERE member = 'm0' AND uid % 10 <> 7), tri AS (SELECT a AS row, b AS col, 'gold' AS triangle, r, n FROM ({_TRI.format(v='g', t='c').replace('g AS v', '0 AS v')}) UNION ALL SELECT b, a, 'weak', r, n FROM ({_TRI.format(v='w', t='c').replace('w AS v', '0 AS v')}))"


def _triangles(spark, d):
    m = members(spark, d).where("member = 'm0' and uid % 10 <> 7")
    return audit.two_triangles(m.select("uid", "label", F.col("y").cast("double").alias("g"), F.col("p").alias("w")), "uid", "label", "g", "w")


@query(f"{_BOTH} SELECT row, col, triangle, round(r, 9) AS r, n FROM tri")
def label_matrix(spark, d):
    """Gold above the diagonal, weak below"""
    return _triangles(spark, d).select("row", "col", "triangle", R("r").alias("r"), "n")


@query(f"{_BOTH} SELECT row, col, round(r, 9) AS r FROM tri WHERE triangle = 'weak' AND r IS NOT NULL ORDER BY round(abs(r), 12) DESC, row, col LIMIT 5")
def top_label_pairs(spark, d):
    """The five pairs that go together most"""
    return audit.top_pairs(_triangles(spark, d)).select("row", "col", R("r").alias("r"))


@query(f"WITH {SERIES_SQL} SELECT uid, count(*) AS n_series, count(*) FILTER (plane = 'Sagittal') AS \"n_Sagittal\", count(*) FILTER (plane = 'Coronal') AS \"n_Coronal\", count(*) FILTER (fluid) AS n_fluid, count(*) FILTER (fat_sat) AS n_fat_sat, count(*) FILTER (plane = 'Sagittal' AND fluid) AS \"n_Sagittal_fluid\", count(*) FILTER (plane = 'Sagittal' AND fat_sat) AS \"n_Sagittal_fat_sat\", count(*) FILTER (plane = 'Coronal' AND fluid) AS \"n_Coronal_fluid\", count(*) FILTER (plane = 'Coronal' AND fat_sat) AS \"n_Coronal_fat_sat\" FROM series GROUP BY uid")
def protocol_features(spark, d):
    """D11"""
    return catalog.protocol_features(series(spark, d), "uid", ("Sagittal", "Coronal"), ("fluid", "fat_sat"))


_SIDE = f"{SERIES_SQL}, sd AS (SELECT uid, count(*) FILTER (tag = 'L') AS l, count(*) FILTER (tag = 'R') AS r, quantile_cont(centre_x, 0.5) AS m FROM series GROUP BY uid), st AS (SELECT uid, CASE WHEN greatest(l, r) = 0 THEN '' WHEN l >= r THEN 'L' ELSE 'R' END AS tag, CASE WHEN m > 20 THEN 'L' WHEN m < -20 THEN 'R' ELSE '' END AS geo FROM sd)"


@query(f"WITH {_SIDE} SELECT uid, CASE WHEN tag <> '' AND geo <> '' AND tag <> geo THEN '' WHEN tag <> '' THEN tag ELSE geo END AS side, tag, geo, (tag <> '' AND geo <> '' AND tag <> geo)::INT AS conflict FROM st")
def study_side(spark, d):
    """D8"""
    return catalog.side(series(spark, d))


@query(f"WITH {SERIES_SQL}, c AS (SELECT uid, plane, count(*) AS n FROM series GROUP BY uid, plane) SELECT uid, first(plane ORDER BY n DESC, plane) AS plane, max(n) AS votes FROM c GROUP BY uid")
def majority_plane(spark, d):
    """D7"""
    return catalog.mode_of(series(spark, d), ["uid"], "plane")


@query(f"WITH {SERIES_SQL}, c AS (SELECT uid, plane, count(*) AS n FROM series GROUP BY uid, plane), b AS (SELECT uid, first(plane ORDER BY n DESC, plane) AS best FROM c GROUP BY uid) SELECT s.uid, s.ord, s.plane, (SELECT count(*) FROM series t WHERE t.uid = s.uid AND t.plane <> b.best) AS removed FROM series s JOIN b USING (uid) WHERE s.plane = b.best")
def majority_clean(spark, d):
    """F14"""
    return catalog.majority_only(series(spark, d), ["uid"], "plane").select("uid", "ord", "plane", "removed")


@query(f"WITH {SERIES_SQL} SELECT uid, median(field) AS field, round(median(spacing * n_slices), 9) AS fov, max(fluid::INT) AS fluid, string_agg(DISTINCT plane, ';' ORDER BY plane) AS planes FROM series GROUP BY uid")
def study_profile(spark, d):
    """D9"""
    t = catalog.profile(series(spark, d), "uid", {"field": F.col("field"), "fov": F.col("spacing") * F.col("n_slices")}, {"fluid": F.col("fluid")}, {"planes": F.col("plane")})
    return t.select("uid", "field", R("fov").alias("fov"), "fluid", "planes")


def _slots_sql() -> str:
    """The same greedy as twelve steps, each with the series that are still free."""
    steps, prev = [], "SELECT DISTINCT uid, []::VARCHAR[] AS used, MAP {}::MAP(VARCHAR, VARCHAR) AS slots FROM series"
    k = 0
    for strict in (True, False):
        for name, plane, tight, loose in catalog.SLOTS:
            rule = (tight if strict else loose).replace("r.", "s.")
            steps.append(f"st{k} AS ({prev})")
            prev = f"""SELECT p.uid, CASE WHEN c.series IS NULL THEN p.used ELSE list_append(p.used, c.series) END AS used,
              CASE WHEN c.series IS NULL THEN p.slots ELSE map_concat(p.slots, MAP {{'{name}': c.series}}) END AS slots
              FROM st{k} p LEFT JOIN (SELECT s.uid, first(s.series ORDER BY abs(s.n_slices - 32), s.ord) AS series FROM series s JOIN st{k} q ON q.uid = s.uid
                WHERE s.plane = '{plane}' AND ({rule}) AND NOT list_contains(q.used, s.series) AND len(map_extract(q.slots, '{name}')) = 0 GROUP BY s.uid) c ON c.uid = p.uid"""
            k += 1
    steps.append(f"done AS ({prev})")
    return f"WITH {SERIES_SQL}, " + ", ".join(steps)


_NAMES = [n for n, *_ in catalog.SLOTS]


@query(_slots_sql() + " SELECT uid, " + ", ".join(f"map_extract(slots, '{n}')[1] AS {n}" for n in _NAMES) + " FROM done")
def slot_selection(spark, d):
    """F1"""
    return catalog.select_slots(series(spark, d)).select("uid", *(F.col("slots")[n].alias(n) for n in _NAMES))


@query(_slots_sql() + ", " + _SIDE[len(SERIES_SQL) + 2 :] + " SELECT d.uid, len(map_keys(slots))::INT AS n_slots, " + " || ".join(f"CASE WHEN len(map_extract(slots, '{n}')) > 0 THEN '1' ELSE '0' END" for n in _NAMES) + " AS mask, CASE WHEN tag <> '' AND geo <> '' AND tag <> geo THEN '' WHEN tag <> '' THEN tag ELSE geo END AS side, ((((('0x' || substr(md5(d.uid::VARCHAR), 1, 16))::UBIGINT::HUGEINT % 4) * (18446744073709551616::HUGEINT % 4)) + ('0x' || substr(md5(d.uid::VARCHAR), 17, 16))::UBIGINT::HUGEINT) % 4)::INT AS shard FROM done d JOIN st USING (uid)")
def manifest(spark, d):
    """G29"""
    return catalog.build_manifest(series(spark, d), 4).select("uid", "n_slots", "mask", "side", "shard")


@query(f"WITH {SERIES_SQL} SELECT uid, first(series ORDER BY NOT fluid, ord) AS series FROM series WHERE plane = 'Sagittal' GROUP BY uid")
def preferred_series(spark, d):
    """F2"""
    return catalog.preferred(series(spark, d), "uid", "Sagittal", "fluid")


@query(f"WITH {SERIES_SQL} SELECT uid, plane, first(series ORDER BY n_slices DESC, ord) AS series FROM series GROUP BY uid, plane")
def longest_series(spark, d):
    """F2"""
    return catalog.longest(series(spark, d), ["uid", "plane"])


@query(f"WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE plane WHEN 'Sagittal' THEN 1 WHEN 'Coronal' THEN 2 ELSE 3 END, fat_sat DESC, fluid DESC, series) AS n FROM series WHERE n_slices >= 5) SELECT uid, series, n::INT AS n FROM r WHERE n <= 4")
def ordered_series(spark, d):
    """F15"""
    return catalog.ordered_series(series(spark, d), "uid", 4).select("uid", "series", "n")


@query(f"WITH {SERIES_SQL}, b AS (SELECT uid, series, n_slices, tag, round_even(0.1 * (n_slices - 1), 0) AS lo, round_even(0.9 * (n_slices - 1), 0) AS hi FROM series), c AS (SELECT uid, series, tag, CASE WHEN hi <= lo THEN 0 ELSE lo END AS lo, CASE WHEN hi <= lo THEN n_slices - 1 ELSE hi END AS hi FROM b) SELECT uid, series, k::INT AS k, round_even(lo + (CASE WHEN tag = 'R' THEN 7 - k ELSE k END) * (hi - lo) / 7, 0)::INT AS place FROM c, range(8) t(k)")
def band_sample(spark, d):
    """F4, E17"""
    t = catalog.band_sample(series(spark, d), 8, 0.1, 0.9, reverse=F.col("tag") == "R")
    return t.select("uid", "series", "k", "place")


@query(f"WITH {SERIES_SQL}, k AS (SELECT *, CASE WHEN bool_and(uid % 3 <> 0) OVER (PARTITION BY uid) THEN centre_x WHEN bool_and(uid % 3 <> 0 OR n_slices > 20) OVER (PARTITION BY uid) THEN n_slices END AS k FROM series) SELECT uid, ord, row_number() OVER (PARTITION BY uid ORDER BY k NULLS FIRST, ord) - 1 AS place FROM k")
def slice_order(spark, d):
    """F3, B10"""
    s = series(spark, d).select("uid", "ord", F.when(F.col("uid") % 3 != 0, F.col("centre_x")).alias("position"), F.when((F.col("uid") % 3 != 0) | (F.col("n_slices") > 20), F.col("n_slices")).alias("instance"))
    return catalog.slice_order(s, "uid", "position", "instance", "ord").select("uid", "ord", F.col("place").cast("long").alias("place"))


_GOOD = f"{SERIES_SQL}, r AS (SELECT uid, ord, n_slices > 15 AS good, row_number() OVER (PARTITION BY uid ORDER BY ord, n_slices) - 1 AS place FROM series)"


@query(f"WITH {_GOOD} SELECT a.uid, a.ord, first(b.place ORDER BY abs(b.place - a.place), b.place) AS source FROM r a LEFT JOIN r b ON b.uid = a.uid AND b.good GROUP BY a.uid, a.ord, a.place")
def nearest_good(spark, d):
    """F5"""
    s = series(spark, d).select("uid", "ord", (F.col("n_slices") > 15).alias("good"), (F.row_number().over(W.partitionBy("uid").orderBy("ord", "n_slices")) - 1).cast("long").alias("place"))
    return catalog.nearest_good(s, ["uid"], "place", "good").select("uid", "ord", "source")


@query(f"WITH {_GOOD} SELECT uid, ord, greatest(0, place - 2) AS before, least(max(place) OVER (PARTITION BY uid), place + 2) AS after FROM r")
def slice_neighbours(spark, d):
    """E7"""
    s = series(spark, d).select("uid", "ord", (F.row_number().over(W.partitionBy("uid").orderBy("ord")) - 1).cast("long").alias("place"))
    return catalog.neighbours(s, ["uid"], "place", 2).select("uid", "ord", "before", "after")


@query(f"WITH {SERIES_SQL}, c AS (SELECT uid, ord, n_slices AS n, unnest(range(1, n_slices - 1)) AS centre FROM series WHERE n_slices >= 3), k AS (SELECT *, n < 20 OR (centre - 1 >= 6 AND centre + 1 <= n - 7) AS ok FROM c), w AS (SELECT *, bool_or(ok) OVER p AS any_ok, row_number() OVER (PARTITION BY uid, ord ORDER BY centre) - 1 AS pos, count(*) OVER p AS m FROM k WINDOW p AS (PARTITION BY uid, ord)) SELECT uid, ord, count(*) AS windows, sum(centre)::BIGINT AS centres FROM w WHERE ok OR (NOT any_ok AND pos = m // 2) GROUP BY uid, ord")
def trimmed_windows(spark, d):
    """F6, F9"""
    s = series(spark, d).select("uid", "ord", F.col("n_slices").alias("n"))
    t = sampling.trim_ends(sampling.centres(s), ["uid", "ord"], "centre", "n", 6)
    return t.groupBy("uid", "ord").agg(F.count("*").alias("windows"), F.sum("centre").alias("centres"))


@query(f"WITH {SERIES_SQL}, m AS (SELECT uid, median(n_slices) AS m FROM series GROUP BY uid), k AS (SELECT s.uid, s.ord, n_slices >= 0.8 * m AS ok, row_number() OVER (PARTITION BY s.uid ORDER BY n_slices DESC, ord) AS r FROM series s JOIN m USING (uid)), w AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY uid) AS l FROM k) SELECT uid, ord FROM w WHERE ok OR (l < 2 AND r <= 2)")
def blank_windows(spark, d):
    """F9"""
    return sampling.drop_blank(series(spark, d), ["uid"], "ord", "n_slices", 0.8).select("uid", "ord")


@query(f"WITH {SERIES_SQL}, w AS (SELECT uid, ord, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY ord) - 1 AS pos FROM series) SELECT uid, ord FROM w WHERE n <= 3 OR pos IN (0, round_even((n - 1) / 2.0::DOUBLE, 0), n - 1)")
def equidistant_subset(spark, d):
    """F7"""
    return sampling.equidistant(series(spark, d), ["uid"], "ord", 3).select("uid", "ord")


@query(f"WITH {SERIES_SQL}, h AS (SELECT uid, plane, ord, md5('s' || ord) AS h FROM series), f AS (SELECT *, (row_number() OVER (PARTITION BY uid, plane ORDER BY h) <= 1)::INT AS f FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY f DESC, h) AS k FROM f) SELECT uid, ord FROM k WHERE k <= 4")
def stratified_sample(spark, d):
    """F8"""
    return sampling.stratified(series(spark, d), ["uid"], "plane", "ord", 4, 1).select("uid", "ord")


_QUOTAS = """t AS (SELECT uid, plane, sum(n_slices)::INT AS room, avg(n_slices) AS share FROM series GROUP BY uid, plane),
v AS (SELECT uid, list(plane ORDER BY plane) AS slots, list(room ORDER BY plane) AS caps, list(share ORDER BY plane) AS s FROM t GROUP BY uid),
i AS (SELECT *, list_transform(s, lambda x: 60 * x / list_reduce(s, lambda a, b: a + b)) AS ideal FROM v),
f AS (SELECT *, list_transform(ideal, lambda x: floor(x)::INT) AS base, list_transform(ideal, lambda x: x - floor(x)) AS rest FROM i),
q AS (SELECT *, list_transform(range(1, len(s) + 1), lambda k: least(caps[k], base[k] + (len(list_filter(range(1, len(s) + 1), lambda j: rest[j] > rest[k] OR (rest[j] = rest[k] AND j < k))) < 60 - list_sum(base))::INT)) AS q0 FROM f),
r(uid, slots, caps, s, q, owed, n) AS (
  SELECT uid, slots, caps, s, q0, list_transform(q0, lambda x: 0.0::DOUBLE), (least(60, list_sum(caps)) - list_sum(q0))::BIGINT FROM q
  UNION ALL
  SELECT uid, slots, caps, s, list_transform(range(1, len(q) + 1), lambda k: q[k] + (k = best)::INT), list_transform(range(1, len(q) + 1), lambda k: due[k] - (k = best)::INT::DOUBLE), n - 1
  FROM (SELECT *, list_reduce(list_filter(range(1, len(q) + 1), lambda k: q[k] < caps[k]), lambda a, b: CASE WHEN due[b] > due[a] THEN b ELSE a END) AS best
    FROM (SELECT *, list_transform(range(1, len(q) + 1), lambda k: owed[k] + CASE WHEN q[k] < caps[k] THEN s[k] / w ELSE 0 END) AS due
      FROM (SELECT *, list_reduce(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN q[k] < caps[k] THEN s[k] ELSE 0.0::DOUBLE END), lambda a, b: a + b) AS w FROM r WHERE n > 0))))"""


@query(f"WITH RECURSIVE {SERIES_SQL}, {_QUOTAS} SELECT uid, unnest(slots) AS plane, unnest(q) AS quota FROM r WHERE n = 0")
def capacity_quotas(spark, d):
    """of 60 slices a study, by mean length of its planes and as far as these have slices"""
    s = series(spark, d).groupBy("uid", "plane").agg(F.sum("n_slices").cast("int").alias("room"), F.avg("n_slices").alias("share"))
    return sampling.allocate(s, "uid", "plane", "room", "share", 60)


_VIEWS = f"{MEMBERS_SQL}, v AS (SELECT uid, label, list_sort(list(p), 'DESC') AS l, avg(p) AS mean, max(p) AS max, avg(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))) AS lg, sum(exp(8 * p) * p) / sum(exp(8 * p)) AS softmax FROM members GROUP BY uid, label)"


@query(f"WITH {_VIEWS} SELECT uid, label, round(mean, 8) AS mean, round(max, 8) AS max, round(softmax, 8) AS softmax, round(list_avg(l[1:2]), 8) AS top2, round(list_avg(l[1:3]), 8) AS top3, round(1 / (1 + exp(-lg)), 8) AS logit FROM v")
def view_pooling(spark, d):
    """F11"""
    t = sampling.pool_views(members(spark, d), ["uid", "label"], "p")
    return t.select("uid", "label", *(R(c, 8).alias(c) for c in ("mean", "max", "softmax", "top2", "top3", "logit")))


@query(f"WITH {SERIES_SQL}, q AS (SELECT plane, quantile_cont(centre_x, 0.01) AS a, quantile_cont(centre_x, 0.99) AS b FROM series GROUP BY plane) SELECT uid, ord, round((greatest(a, least(b, centre_x)) - a) / greatest(b - a, 1e-6), 9) AS scaled FROM series JOIN q USING (plane)")
def robust_scaling(spark, d):
    """F16"""
    return sampling.robust_scale(series(spark, d), ["plane"], "centre_x").select("uid", "ord", R("scaled").alias("scaled"))


@query("WITH u AS (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 20) SELECT l_orderkey AS uid, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT * FROM u) GROUP BY 1")
def smoke_subset(spark, d):
    """A11"""
    return sampling.smoke(series(spark, d), "uid", 20).groupBy("uid").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT p_brand AS name, count(*) AS n, max(p_size) AS top FROM part GROUP BY p_brand HAVING count(*) > 3) SELECT name, n AS s0, top AS s1 FROM c ORDER BY n DESC, top DESC, name LIMIT 1")
def best_candidate(spark, d):
    """F17"""
    c = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.max("p_size").alias("top"))
    return sampling.best_candidate(c, "n > 3", ["n", "top"], "name")


@query(f"WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, plane ORDER BY ord) AS n, count(*) OVER (PARTITION BY uid, plane) AS n_files FROM series), g AS (SELECT *, row_number() OVER (PARTITION BY uid, plane ORDER BY n) AS k FROM r WHERE n <= 5 AND n_slices > 10) SELECT uid, plane, ord, n_files FROM g WHERE k = 1")
def header_scan(spark, d):
    """A10"""
    s = series(spark, d).select("uid", "plane", F.concat_ws("/", "uid", "plane").alias("bag"), "ord", (F.col("n_slices") > 10).alias("ok"))
    return catalog.header_scan(s, "bag", "ord", "ok").select("uid", "plane", "ord", F.col("n_slices").alias("n_files"))


@query("WITH f AS (SELECT page_id % 40 AS knee, page_id % 3 AS series, max(url) AS url FROM pages GROUP BY ALL), a AS (SELECT *, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) END AS alias FROM f) SELECT knee, series, alias FROM a WHERE knee IN (SELECT knee FROM a GROUP BY knee HAVING count(alias) = 3)")
def external_series(spark, d):
    """G31, F13, E18"""
    f = table(spark, d, "pages").select((F.col("page_id") % 40).alias("knee"), (F.col("page_id") % 3).alias("series"), "url")
    return catalog.choose_external(f, "https://").select("knee", "series", "alias")


@query(f"WITH {SERIES_SQL}, a AS (SELECT DISTINCT plane FROM series), b AS (SELECT DISTINCT weighting FROM series) SELECT a.plane, b.weighting, count(s.uid) AS n FROM a CROSS JOIN b LEFT JOIN series s ON s.plane = a.plane AND s.weighting = b.weighting GROUP BY ALL")
def combination_counts(spark, d):
    """C15"""
    return joins.combinations_missing(series(spark, d), "plane", "weighting")


@query("WITH b(slot, ord, size) AS (VALUES ('a', 1, 24), ('b', 2, 14), ('c', 3, 1), ('d', 4, 8)), c AS (SELECT slot, size, sum(size) OVER (ORDER BY ord) AS stop FROM b), p AS (SELECT doc_id AS uid, doc_id % 47 AS pos FROM documents) SELECT uid, slot, round(CASE WHEN size > 1 THEN (pos - (stop - size))::DOUBLE / (size - 1) ELSE 0 END, 9) AS inside FROM p JOIN c ON pos >= stop - size AND pos < stop")
def slot_lookup(spark, d):
    """C16, E9"""
    b = spark.createDataFrame([("a", 1, 24), ("b", 2, 14), ("c", 3, 1), ("d", 4, 8)], "slot string, ord int, size int")
    p = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), (F.col("doc_id") % 47).alias("pos"))
    return joins.place_in_slots(p, b).select("uid", "slot", R("inside").alias("inside"))


@query("WITH r AS (SELECT c_custkey AS uid, n, n * 7 % 3 AS prio, c_custkey % (n + 2) <> 0 AS ok FROM customer, range(3) t(n)) SELECT uid, first(n ORDER BY prio, n) AS file FROM r WHERE ok GROUP BY uid")
def merged_runs(spark, d):
    """C10, C11"""
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("file"))
    r = r.withColumns({"prio": F.col("file") * 7 % 3, "ok": F.col("uid") % (F.col("file") + 2) != 0})
    return joins.union_complete(r, "uid", "prio", "file", "ok").select("uid", "file")


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS \"both\", count(*) FILTER (l.doc_id IS NULL) AS only_a, 0::BIGINT AS only_b FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def key_coverage(spark, d):
    """C1, C2, C6, H4"""
    return joins.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT o_custkey AS uid FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def members_in_all(spark, d):
    """C5"""
    return joins.in_all(table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderstatus").alias("member")), "uid", "member")


@query("SELECT doc_id AS uid, -1 AS fold, FALSE AS is_gold, source FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, (doc_id % 5)::INT, TRUE, NULL FROM labels")
def cohort_append(spark, d):
    """C9, C7"""
    base = table(spark, d, "labels").select(F.col("doc_id").alias("uid"), (F.col("doc_id") % 5).cast("int").alias("fold"), F.lit(True).alias("is_gold"))
    extra = table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("uid"), "source")
    return joins.append_cohort(base, extra, table(spark, d, "labels").select(F.col("doc_id").alias("uid"))).select("uid", "fold", "is_gold", "source")


@query("SELECT conv_id AS topic, turn, turn AS depth FROM conversations")
def reply_depths(spark, d):
    """Each turn answers the one before"""
    key = lambda t: F.col("conv_id") * 1000 + t
    c = table(spark, d, "conversations").select(key(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("parent"), F.col("conv_id").alias("topic"))
    return joins.reply_tree(c).select("topic", (F.col("id") % 1000).alias("turn"), F.col("depth").cast("long").alias("depth"))


@query("SELECT conv_id AS topic, arg_min(text, turn) AS text, count(*) AS votes FROM conversations GROUP BY conv_id")
def search_merge(spark, d):
    """D36"""
    c = table(spark, d, "conversations")
    h = c.join(c.groupBy("conv_id").agg(F.count("*").alias("votes")), "conv_id").select(F.col("conv_id").alias("topic"), F.col("turn").alias("page"), F.lit(0).alias("at"), F.lit("f").alias("forum"), "votes", "text")
    return joins.search_merge(h, "f").select("topic", "text", "votes")


@query("WITH e AS (SELECT user_id, event_id, event_type, value FROM events) SELECT user_id AS uid, first(value ORDER BY (event_type = 'error'), event_id DESC) AS value, first(event_type = 'error' ORDER BY (event_type = 'error'), event_id DESC) AS failed FROM e GROUP BY user_id")
def merged_evidence(spark, d):
    """C17"""
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("user_id").alias("uid"), "value", F.when(F.col("event_type") == "error", "x").alias("error")))
    lines = e.select(line.alias("line"), F.lit("f").alias("file"), F.col("event_id").alias("at"))
    t = joins.merge_evidence(lines, "uid long, value double, error string", "uid")
    return t.select("uid", "r.value", F.col("r.error").isNotNull().alias("failed"))


@query("SELECT o_custkey AS uid, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS price FROM orders GROUP BY 1")
def first_known(spark, d):
    """D4"""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"), "o_orderkey")
    return labels.first_known(o, ["uid"], "price", "o_orderkey")


@query("WITH r AS (SELECT p_partkey AS uid, CASE WHEN p_size > 25 THEN p_size::DOUBLE / 50 END AS a, CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE END AS b FROM part) SELECT uid, coalesce(a, 0.5) AS \"y__A\", coalesce(b, 0.5) AS \"y__B\", 0.5::DOUBLE AS \"y__C\", (a IS NOT NULL)::INT AS \"w__A\", (b IS NOT NULL)::INT AS \"w__B\", 0 AS \"w__C\" FROM r WHERE a IS NOT NULL OR b IS NOT NULL")
def masked_targets(spark, d):
    """D5, D6, G30"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("uid"), F.when(F.col("p_size") > 25, F.col("p_size") / 50).alias("a"), F.when(F.col("p_partkey") % 3 == 0, 1.0).alias("b"))
    return labels.masked_targets(p, {"A": F.col("a"), "B": F.col("b")}, ["A", "B", "C"]).drop("a", "b")


@query(f"WITH {MEMBERS_SQL}, v AS (SELECT * FROM members WHERE NOT (uid % 9 = 0 AND member = 'm2')), c AS (SELECT uid, label, sum(w * p) / sum(w) AS p, count(p) AS k FROM v JOIN (VALUES ('m0', 0.4::DOUBLE), ('m1', 0.3::DOUBLE), ('m2', 0.2::DOUBLE), ('m3', 0.1::DOUBLE)) w(member, w) USING (member) GROUP BY uid, label) SELECT uid, label, round(p, 9) AS p FROM c WHERE uid IN (SELECT uid FROM c GROUP BY uid HAVING sum(k) = 16)")
def view_blend(spark, d):
    """D2, A8"""
    w = spark.createDataFrame([("m0", 0.4), ("m1", 0.3), ("m2", 0.2), ("m3", 0.1)], "view string, w double")
    v = members(spark, d).where("not (uid % 9 = 0 and member = 'm2')").withColumnRenamed("member", "view")
    return labels.blend_views(v, w, 4, 4).select("uid", "label", R("p").alias("p"))


@query("SELECT l_suppkey AS key, count(DISTINCT l_tax) AS kinds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) > 1")
def inconsistent_side_data(spark, d):
    """D3"""
    return labels.weights_consistent(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), "l_tax"), ["key"], "l_tax")


_MIX = f"""{MEMBERS_SQL}, soft AS (SELECT uid, label, p AS value FROM members WHERE member = 'm0'), teach AS (SELECT uid, label, p AS value FROM members WHERE member = 'm1' AND uid % 5 <> 1 AND uid % 4 <> 0),
rf AS (SELECT label, value AS p, row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS at, count(*) OVER (PARTITION BY label) AS m FROM soft WHERE uid % 4 <> 0),
rk AS (SELECT uid, label, (rank() OVER (PARTITION BY label ORDER BY value) + (count(*) OVER (PARTITION BY label, value) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY label) AS q FROM teach),
ps AS (SELECT uid, label, q * ((SELECT max(m) FROM rf WHERE rf.label = rk.label) - 1) AS pos FROM rk),
mt AS (SELECT ps.uid, ps.label, lo.p + (hi.p - lo.p) * (pos - floor(pos)) AS t FROM ps JOIN rf lo ON lo.label = ps.label AND lo.at = floor(pos) JOIN rf hi ON hi.label = ps.label AND hi.at = ceil(pos))"""


@query(f"WITH {_MIX} SELECT s.uid, s.label, round(CASE WHEN t IS NULL THEN value WHEN s.uid % 3 = 0 THEN 0.2 * value + 0.8 * t ELSE 0.5 * value + 0.5 * t END, 9) AS value FROM soft s LEFT JOIN mt USING (uid, label)")
def teacher_mix(spark, d):
    """G2"""
    m = members(spark, d)
    soft = m.where("member = 'm0'").select("uid", "label", F.col("p").alias("value"))
    teach = m.where("member = 'm1' and uid % 5 <> 1").select(F.lit("t").alias("source"), "uid", "label", F.col("p").alias("value"))
    gold_ = soft.where("uid % 4 = 0").select("uid").distinct()
    t = labels.mix_teacher(soft, teach, gold_, 0.5, soft.where("uid % 3 = 0").select("uid", "label"), 0.8)
    return t.select("uid", "label", R("value").alias("value"))


@query(f"WITH {SOURCES_SQL}, c AS (SELECT uid, label, verdict, value, 0.4::DOUBLE AS w FROM sources WHERE source = 's1'), o AS (SELECT uid, value AS dv FROM c WHERE label = 'quality') SELECT c.uid, c.label, round(CASE WHEN hit THEN dv ELSE value END, 9) AS value, round(CASE WHEN hit THEN {CONF.format(s='0', m='dv')} ELSE w END, 9) AS w FROM (SELECT c.*, o.dv, c.label = 'toxic' AND c.verdict = 'UNK' AND o.dv IS NOT NULL AS hit FROM c LEFT JOIN o USING (uid)) c")
def backfilled_labels(spark, d):
    """G28 (back-fill)"""
    c = sources(spark, d).where("source = 's1'").select("uid", "label", "verdict", "value", F.lit(0.4).alias("w"))
    return labels.backfill(c, "toxic", "quality").select("uid", "label", R("value").alias("value"), R("w").alias("w"))


@query("WITH n AS (SELECT trim(unnest(string_split(CASE WHEN l_returnflag = 'A' THEN 'no image; late' WHEN l_returnflag = 'N' THEN 'late;' ELSE 'short' END, ';'))) AS reason FROM lineitem) SELECT reason, count(*) AS n FROM n WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 6")
def exclusion_reasons(spark, d):
    """D29"""
    note = F.when(F.col("l_returnflag") == "A", "no image; late").when(F.col("l_returnflag") == "N", "late;").otherwise("short")
    return audit.reasons(table(spark, d, "lineitem").select(note.alias("note")), "note")


@query("WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT n AS value, count(*) AS n FROM c GROUP BY 1")
def series_histogram(spark, d):
    """D31"""
    c = series(spark, d).groupBy("uid").agg(F.count("*").alias("k"))
    return audit.value_counts(c, F.col("k"))


@query(f"WITH {SERIES_SQL} SELECT plane, weighting, round(avg((n_slices >= 24)::INT), 9) AS enough, count(*) AS n FROM series GROUP BY ALL")
def slice_coverage(spark, d):
    """D33, D31"""
    return series(spark, d).groupBy("plane", "weighting").agg(R(F.avg((F.col("n_slices") >= 24).cast("int"))).alias("enough"), F.count("*").alias("n"))


@query(f"WITH {SERIES_SQL} SELECT plane, round(min(140 / spacing), 9) AS least, round(max(140 / spacing), 9) AS most, round(max(140 / spacing) / min(140 / spacing), 9) AS ratio FROM series GROUP BY plane")
def crop_widths(spark, d):
    """D37"""
    px = 140 / F.col("spacing")
    return series(spark, d).groupBy("plane").agg(R(F.min(px)).alias("least"), R(F.max(px)).alias("most"), R(F.max(px) / F.min(px)).alias("ratio"))


@query("WITH r AS (SELECT (round(c_acctbal * 100)::BIGINT + 5000) // 10000 / 100::DOUBLE AS v FROM customer WHERE c_acctbal BETWEEN 0 AND 5000) SELECT v AS value, count(*) AS n FROM r GROUP BY v")
def score_histogram(spark, d):
    """D26"""
    return audit.value_counts(table(spark, d, "customer").where("c_acctbal between 0 and 5000"), F.round(F.col("c_acctbal") / 10000, 2))


@query("WITH a AS (SELECT s_suppkey AS team, s_acctbal AS score FROM supplier), b AS (SELECT s_suppkey AS team, floor(s_acctbal / 2) AS score FROM supplier WHERE s_suppkey % 4 <> 0), x AS (SELECT team, score, rank() OVER (ORDER BY score DESC) AS private_rank, row_number() OVER (ORDER BY score DESC, team) AS private_row FROM a), y AS (SELECT team, score, rank() OVER (ORDER BY score DESC) AS public_rank FROM b) SELECT x.team, x.score AS private, x.private_rank::INT AS private_rank, x.private_row::INT AS private_row, y.score AS public, y.public_rank::INT AS public_rank, round(x.score - y.score, 6) AS gap FROM x LEFT JOIN y USING (team)")
def board_merge(spark, d):
    """C3, D27, E15, G35"""
    s = table(spark, d, "supplier")
    a = s.select(F.col("s_suppkey").alias("team"), F.col("s_acctbal").alias("score"))
    b = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("team"), F.floor(F.col("s_acctbal") / 2).cast("double").alias("score"))
    t = composites.board(a, b)
    return t.select("team", "private", "private_rank", "private_row", "public", "public_rank", R("gap", 6).alias("gap"))


@query("SELECT o_orderkey AS entry, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::INT AS number FROM orders WHERE o_orderstatus <> 'P'")
def entry_numbers(spark, d):
    """E16"""
    from sievework.functions.ranks import running_total

    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    per = o.groupBy(F.lit(0).alias("all"), F.unix_timestamp("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    before = running_total(per, ["all"], "day", ["n"]).select("day", "n_before")
    within = F.row_number().over(W.partitionBy("day").orderBy("o_orderkey"))
    return o.withColumn("day", F.unix_timestamp("o_orderdate")).withColumn("k", within).join(before, "day").select(F.col("o_orderkey").alias("entry"), (F.col("k") + F.col("n_before")).cast("int").alias("number"))


@query("SELECT user_id, event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w, 3) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lag(ts) OVER w IS NOT NULL")
def step_seconds(spark, d):
    """E8"""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    t = events(spark, d).withColumn("s", F.unix_micros("ts") / 1e6)
    t = t.withColumn("seconds", F.col("s") - F.lag("s").over(w)).where("seconds is not null")
    return t.select("user_id", "event_id", R("seconds", 3).alias("seconds"))


@query("WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events), r AS (SELECT user_id, max(s) - min(s) AS s, max(done) - min(done) AS n FROM p WHERE done >= 20 GROUP BY user_id HAVING max(done) > min(done)) SELECT round(median(s / n), 3) AS median, round(quantile_cont(s / n, 0.9), 3) AS p90, round(max(s / n), 3) AS most, round(median(s / n) * 1000 / 3600, 3) AS hours_for_1000 FROM r")
def steady_rate(spark, d):
    """D28, I6"""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    p = events(spark, d).select("user_id", (F.unix_micros("ts") / 1e6).alias("s"), F.row_number().over(w).alias("done")).where("done >= 20")
    r = p.groupBy("user_id").agg((F.max("s") - F.min("s")).alias("s"), (F.max("done") - F.min("done")).alias("n")).where("n > 0").withColumn("r", F.col("s") / F.col("n"))
    q = r.agg(F.median("r").alias("median"), F.expr("percentile(r, 0.9)").alias("p90"), F.max("r").alias("most"))
    return q.select(R("median", 3).alias("median"), R("p90", 3).alias("p90"), R("most", 3).alias("most"), R(F.col("median") * 1000 / 3600, 3).alias("hours_for_1000"))


@query(f"WITH {POLLS_SQL}, u AS (SELECT DISTINCT ref, poll_ts, status, sent FROM polls), w AS (SELECT *, lag(status) OVER o AS before, lag(poll_ts) OVER o AS prev, coalesce(bool_or(status IN ('COMPLETE', 'ERROR', 'CANCELED')) OVER (PARTITION BY ref ORDER BY poll_ts, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM u WINDOW o AS (PARTITION BY ref ORDER BY poll_ts, status)), e AS (SELECT *, status IN ('COMPLETE', 'ERROR', 'CANCELED') AS terminal, CASE WHEN status IN ('COMPLETE', 'ERROR', 'CANCELED') THEN (epoch_us(poll_ts) - epoch_us(sent)) / 6e7 END AS minutes, (epoch_us(poll_ts) - epoch_us(prev)) / 6e7 AS gap FROM w WHERE before IS NOT NULL AND before <> status AND NOT ended) SELECT ref, before, status, terminal, round(minutes, 3) AS minutes, round(CASE WHEN minutes IS NOT NULL THEN greatest(0, minutes - gap) END, 3) AS minutes_low FROM e")
def status_changes(spark, d):
    """I2, I3, I9 over a finished feed (the streaming forms are in streaming.monitor and its tests)"""
    t = monitor.status_changes_batch(status_polls(spark, d))
    return t.select("ref", "before", "status", "terminal", R("minutes", 3).alias("minutes"), R("minutes_low", 3).alias("minutes_low"))


@query("SELECT user_id AS worker, epoch(date_trunc('day', ts))::BIGINT AS start, round(max(value) - min(value), 9) AS rows, count(*) AS lines FROM events GROUP BY ALL")
def window_rates(spark, d):
    """Tumbling windows"""
    e = events(spark, d).select("ts", F.col("user_id").alias("worker"), "value")
    return monitor.rates(e, "1 day", "1 hour", done="value").select("worker", F.unix_timestamp("start").alias("start"), R("rows").alias("rows"), "lines")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    """H2"""
    return quality.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL AND NOT c_acctbal BETWEEN 0 AND 9000")
def range_violations(spark, d):
    """H3"""
    return quality.out_of_range(table(spark, d, "customer"), "c_acctbal", 0, 9000).select("c_custkey", "c_acctbal")


@query("WITH r AS (SELECT o_orderkey AS uid, c AS label, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 7 = k THEN 2 ELSE (o_orderkey % 2)::INT END AS w FROM orders, (VALUES (1, 'a'), (2, 'b')) v(k, c)) SELECT uid, label, 'weight not 0 or 1' AS rule FROM r WHERE w NOT IN (0, 1) UNION ALL SELECT uid, label, 'weight without supervision' FROM r WHERE label <> 'a' AND w > 0 UNION ALL SELECT uid, NULL, 'no supervised cell' FROM r GROUP BY uid HAVING sum(w) = 0")
def weight_violations(spark, d):
    """H3"""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.explode(F.array(F.struct(F.lit(1).alias("k"), F.lit("a").alias("label")), F.struct(F.lit(2).alias("k"), F.lit("b").alias("label")))).alias("c")).select("uid", "c.*")
    o = o.withColumn("w", F.when(F.col("uid") % 10 == 0, 0).when(F.col("uid") % 7 == F.col("k"), 2).otherwise(F.col("uid") % 2))
    return quality.weight_rules(o.drop("k"), F.col("label") == "a")


@query("SELECT 'rows' AS what, count(*) AS found, 7 AS expected FROM lineitem UNION ALL SELECT 'uids', count(DISTINCT l_orderkey), 3 FROM lineitem")
def count_violations(spark, d):
    """H4"""
    return quality.counts(table(spark, d, "lineitem"), "l_orderkey", 7, 3)


@query("SELECT l.doc_id AS uid FROM labels l WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def gold_leaks(spark, d):
    """H5"""
    train = table(spark, d, "labels").select(F.col("doc_id").alias("uid"))
    return quality.gold_in_training(train, table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("uid")))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS has, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def unequal_sets(spark, d):
    """H7"""
    return quality.sets_differ(table(spark, d, "orders"), "o_orderstatus", "o_custkey").select("o_custkey", "has", "parts")


@query("WITH s AS (SELECT source, avg(n_chars) AS m FROM documents GROUP BY source) SELECT source, round(m, 6) AS found, round(CASE WHEN source < 'src2' THEN m + 1 ELSE m END, 6) AS logged FROM s WHERE source < 'src2'")
def metric_drift(spark, d):
    """H8"""
    s = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"))
    t = quality.unlike_log(s, s.withColumn("m", F.when(F.col("source") < "src2", F.col("m") + 1).otherwise(F.col("m"))), ["source"], "m")
    return t.select("source", R("found", 6).alias("found"), R("logged", 6).alias("logged"))


@query("SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) AS n, greatest(5, ceil(count(*) * 0.05))::BIGINT AS allowed FROM events HAVING count(*) FILTER (event_type = 'error') > greatest(5, ceil(count(*) * 0.05))")
def failed_rows(spark, d):
    """H10"""
    return quality.too_many_failed(table(spark, d, "events"), F.col("event_type") == "error", 5, 0.05)


@query("SELECT l_returnflag AS label, regexp_replace(l_returnflag, 'A', 'a') AS flag, (l_quantity IS NOT NULL AND l_tax IS NOT NULL) AS gold, 'fold=' || (l_orderkey % 5) || '|band=0.1' AS signature, '1' || '1' AS mask, count(*) AS n FROM lineitem GROUP BY ALL")
def gold_and_signature(spark, d):
    """B1, B20"""
    t = table(spark, d, "lineitem")
    t = t.select(F.col("l_returnflag").alias("label"), F.replace("l_returnflag", F.lit("A"), F.lit("a")).alias("flag"), scalars.is_gold(["l_quantity", "l_tax"]).alias("gold"), scalars.version(fold=F.col("l_orderkey") % 5, band="0.1").alias("signature"), scalars.mask(["l_quantity", "l_tax"]).alias("mask"))
    return t.groupBy("label", "flag", "gold", "signature", "mask").agg(F.count("*").alias("n"))


@query(f"WITH {MEMBERS_SQL}, m AS (SELECT * FROM members WHERE member = 'm0') SELECT uid, " + ", ".join(f"round(max(p) FILTER (label = 'c{k}'), 9) AS c{k}" for k in range(4)) + ", " + ", ".join(f"round(max(fold + 1.0) FILTER (label = 'c{k}'), 9)::DOUBLE AS w__c{k}" for k in range(4)) + ", any_value(fold) AS fold FROM m GROUP BY uid")
def wide_targets(spark, d):
    """A14"""
    m = members(spark, d).where("member = 'm0'")
    cells = m.select("uid", "label", R("p").alias("y"), (F.col("fold") + 1.0).alias("w"))
    return sinks.target_table(cells, [f"c{k}" for k in range(4)], m.select("uid", "fold").distinct())


@query("WITH r AS (SELECT '{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || ',\"l_returnflag\":\"' || l_returnflag || '\"}' AS j FROM lineitem) SELECT count(*) AS n, bit_xor(('0x' || substr(md5(j), 1, 8))::BIGINT) AS \"xor\", sum(('0x' || substr(md5(j), 9, 8))::BIGINT)::BIGINT AS total FROM r")
def table_checksum(spark, d):
    """A16"""
    return sinks.checksum(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(f"WITH {SERIES_SQL}, r AS (SELECT uid, rank() OVER (PARTITION BY uid ORDER BY ord) + (count(*) OVER (PARTITION BY uid, ord) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY uid ORDER BY centre_x) + (count(*) OVER (PARTITION BY uid, centre_x) - 1) / 2.0::DOUBLE AS z FROM series), c AS (SELECT uid, CASE WHEN stddev_pop(x) * stddev_pop(z) > 1e-12 THEN covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)) END AS rho FROM r GROUP BY uid) SELECT round(avg(rho), 9) AS mean_rho, round(avg((rho > 0.99)::INT), 9) AS in_order, count(rho) AS series FROM c")
def order_audit(spark, d):
    """G32"""
    s = series(spark, d).select(F.col("uid").alias("series"), F.col("ord").alias("file_at"), F.col("centre_x").alias("position"))
    t = audit.order_audit(s)
    return t.select(R("mean_rho").alias("mean_rho"), R("in_order").alias("in_order"), "series")


@query("SELECT event_id AS id, user_id AS done FROM events WHERE user_id % 3 = 1")
def progress_lines(spark, d):
    """An event is a log file of one entry"""
    e = table(spark, d, "events")
    line = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("[0:50] studies "), "user_id", F.lit("/200 | elapsed 30.5s"))).otherwise("noise")
    files = e.select("event_id", F.to_json(F.array(F.struct(F.lit("stdout").alias("stream_name"), line.alias("data")))).alias("value"))
    out = text.log_lines(files).withColumn("p", text.progress(F.col("line"))).where("p is not null")
    return out.select(F.col("event_id").alias("id"), F.col("p.done").cast("long").alias("done"))


QUERIES["pct_rank_on_documents"] = lambda spark, d: ranks.with_rank(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "r").select("doc_id", R("r").alias("r"))
SQL["pct_rank_on_documents"] = "SELECT doc_id, round((rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY lang), 9) AS r FROM documents"
