"""The given tables seen as studies, series, label sources, predictions and feeds, with the same views in SQL.

All values come from the tables by integer arithmetic and md5, so both engines get the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import text_group

CLASSES, MEMBERS, FOLDS = 4, 4, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest_number(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def members(spark: SparkSession, sf_dir: str, n: int = MEMBERS) -> DataFrame:
    """Predictions (member, uid, label, p, y, fold) of n members: each is one dimension of the embeddings per label."""
    e = table(spark, sf_dir, "embeddings")
    p = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.floor(F.col("embedding")[i].cast("double") * 1000) + 500) / 1000))
    cells = F.array(*(F.struct(F.lit(f"m{m}").alias("member"), F.lit(f"c{k}").alias("label"), p(k * n + m).alias("p"), (F.col("label") % CLASSES == k).cast("int").alias("y")) for k in range(CLASSES) for m in range(n)))
    return e.select(F.col("vec_id").alias("uid"), (F.col("vec_id") % FOLDS).cast("int").alias("fold"), F.explode(cells).alias("c")).select("uid", "fold", "c.*")


def members_sql(n: int) -> str:
    return f"""members AS (
  SELECT e.vec_id AS uid, CAST(e.vec_id % {FOLDS} AS INT) AS fold, 'm' || m AS member, 'c' || k AS label,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, (floor(e.embedding[k * {n} + m + 1]::DOUBLE * 1000) + 500) / 1000)) AS p,
         CAST(e.label % {CLASSES} = k AS INT) AS y
  FROM embeddings e, range({CLASSES}) a(k), range({n}) b(m))"""


MEMBERS_SQL = members_sql(MEMBERS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sources (uid, lang, source, label, value, verdict) for the documents; one value in seven is missing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "lang")
    cells = F.array(*(F.struct(F.lit(s).alias("source"), F.lit(c).alias("label")) for s in ("s1", "s2", "s3") for c in ("quality", "toxic")))
    rows = d.select("uid", "lang", F.explode(cells).alias("c")).select("uid", "lang", "c.*").withColumn("h", digest_number(F.col("source"), F.col("label"), F.col("uid").cast("string")))
    verdict = F.when(F.col("h") % 3 == 0, "YES").when(F.col("h") % 3 == 1, "NO").otherwise("UNK")
    return rows.select("uid", "lang", "source", "label", F.when(F.col("h") % 7 != 0, (F.col("h") % 1001) / 1000).alias("value"), verdict.alias("verdict"))


SOURCES_SQL = """hashed AS (
  SELECT doc_id AS uid, lang, s AS source, c AS label, ('0x' || substr(md5(s || ':' || c || ':' || doc_id), 1, 8))::BIGINT AS h
  FROM documents, (VALUES ('s1'), ('s2'), ('s3')) a(s), (VALUES ('quality'), ('toxic')) b(c)),
sources AS (
  SELECT uid, lang, source, label, CASE WHEN h % 7 <> 0 THEN (h % 1001) / 1000.0::DOUBLE END AS value,
         CASE h % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' ELSE 'UNK' END AS verdict FROM hashed)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return t.unpivot(["uid"], ["quality", "toxic"], "label", "y").where("y is not null")


GOLD_SQL = """gold AS (
  SELECT doc_id AS uid, 'quality' AS label, quality::DOUBLE AS y FROM labels WHERE quality IS NOT NULL
  UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels WHERE toxic IS NOT NULL)"""


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as studies: uid, text, lang, source, group of equal texts, is_gold."""
    d = table(spark, sf_dir, "documents")
    g = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select("doc_id").distinct().withColumn("_g", F.lit(True))
    return d.join(g, "doc_id", "left").select(F.col("doc_id").alias("uid"), "text", "lang", "source", text_group(F.col("text")).alias("group"), F.coalesce("_g", F.lit(False)).alias("is_gold"))


STUDIES_SQL = r"""studies AS (
  SELECT d.doc_id AS uid, d.text, d.lang, d.source, substr(md5(lower(regexp_replace(coalesce(d.text, ''), '^\s+|\s+$', '', 'g'))), 1, 16) AS "group",
         g.doc_id IS NOT NULL AS is_gold
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) g ON g.doc_id = d.doc_id)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as series of their order: plane, flags, weighting, slices, tags and places."""
    t = table(spark, sf_dir, "lineitem")
    plane = F.when(F.col("l_returnflag") == "A", "Sagittal").when(F.col("l_returnflag") == "N", "Coronal").otherwise("Axial")
    tag = F.when(F.col("l_partkey") % 5 == 0, "L").when(F.col("l_partkey") % 5 == 1, "R").otherwise("")
    return t.select(
        F.col("l_orderkey").alias("uid"),
        F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey").alias("series"),
        (F.col("l_linenumber").cast("long") * 10**12 + F.col("l_partkey") * 10**6 + F.col("l_suppkey")).alias("ord"),
        plane.alias("plane"),
        (F.col("l_linestatus") == "O").alias("fluid"),
        (F.col("l_partkey") % 2 == 0).alias("fat_sat"),
        F.when(F.col("l_suppkey") % 3 == 0, "T1").otherwise("T2").alias("weighting"),
        F.col("l_quantity").cast("int").alias("n_slices"),
        tag.alias("tag"),
        (F.floor("l_extendedprice") % 100 - 50).cast("double").alias("centre_x"),
        ((F.col("l_partkey") % 7 + 1) / 10).alias("spacing"),
        F.when(F.col("l_suppkey") % 2 == 0, 1.5).otherwise(3.0).alias("field"),
    )


SERIES_SQL = """series AS (
  SELECT l_orderkey AS uid, l_linenumber || '.' || l_partkey || '.' || l_suppkey AS series,
         l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord,
         CASE l_returnflag WHEN 'A' THEN 'Sagittal' WHEN 'N' THEN 'Coronal' ELSE 'Axial' END AS plane,
         l_linestatus = 'O' AS fluid, l_partkey % 2 = 0 AS fat_sat, CASE WHEN l_suppkey % 3 = 0 THEN 'T1' ELSE 'T2' END AS weighting,
         l_quantity::INT AS n_slices, CASE l_partkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE '' END AS tag,
         (floor(l_extendedprice)::BIGINT % 100 - 50)::DOUBLE AS centre_x, (l_partkey % 7 + 1) / 10.0::DOUBLE AS spacing,
         CASE WHEN l_suppkey % 2 = 0 THEN 1.5::DOUBLE ELSE 3.0::DOUBLE END AS field
  FROM lineitem)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as an instant (the files have it without a time zone; it is read in the session's)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def status_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of a reference per user: purchases complete it, errors end it."""
    e = events(spark, sf_dir)
    status = F.when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "PENDING").otherwise("RUNNING")
    return e.select(F.col("ts").alias("poll_ts"), F.concat_ws("-", "user_id", (F.dayofmonth("ts"))).alias("ref"), status.alias("status"), F.date_trunc("day", "ts").alias("sent"), F.col("value").alias("score"), "event_id")


POLLS_SQL = """polls AS (
  SELECT ts AS poll_ts, user_id || '-' || day(ts) AS ref,
         CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'PENDING' ELSE 'RUNNING' END AS status,
         date_trunc('day', ts)::TIMESTAMP AS sent, value AS score, event_id FROM events)"""


def pct_sql(name: str, source: str, keys: str, p: str, out: str, where: str = "TRUE") -> str:
    """A CTE that adds the percentile rank with average ties over the rows of `where`; other rows get null."""
    return f"""{name} AS (
  SELECT s.*, CASE WHEN {p} IS NOT NULL AND ({where}) THEN
      (rank() OVER (PARTITION BY {keys}, {p} IS NOT NULL AND ({where}) ORDER BY {p}) + (count(*) OVER (PARTITION BY {keys}, {p} IS NOT NULL AND ({where}), {p}) - 1) / 2.0::DOUBLE)
      / count(*) OVER (PARTITION BY {keys}, {p} IS NOT NULL AND ({where})) END AS {out}
  FROM {source} s)"""


def auc_sql(name: str, source: str, keys: str, y: str, s: str) -> str:
    """A CTE with keys, auc, n_pos, n_neg."""
    on = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_c AS (
  SELECT {on}{s} AS s, count(*) FILTER ({y} = 1) AS pos, count(*) FILTER ({y} <> 1) AS neg FROM {source} WHERE {s} IS NOT NULL AND {y} IS NOT NULL GROUP BY {on}{s}),
{name}_w AS (SELECT *, sum(neg) OVER ({part}ORDER BY s) - neg AS before FROM {name}_c),
{name} AS (
  SELECT {on}CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (2 * before + neg))::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE END AS auc,
         sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM {name}_w {group})"""
