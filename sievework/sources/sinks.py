"""Writers: stable column order, no empty caches, comparable outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def target_table(cells: DataFrame, labels: list[str], meta: DataFrame) -> DataFrame:
    """Wide targets in fixed order: uid, labels, w__labels, then meta's columns."""
    wide = cells.groupBy("uid").pivot("label", labels).agg(F.first("y").alias("y"), F.first("w").alias("w"))
    cols = [F.col(f"`{c}_y`").alias(c) for c in labels] + [F.col(f"`{c}_w`").alias(f"w__{c}") for c in labels]
    return wide.select("uid", *cols).join(meta, "uid").select("uid", *(F.col(f"`{c}`") for c in labels), *(F.col(f"`w__{c}`") for c in labels), *(c for c in meta.columns if c != "uid"))


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path, sep=sep)


def write_one_file(df: DataFrame, path: str, sep: str = ",") -> None:
    """A table of bounded size as one CSV file of this name: written aside, then renamed, so that no half file is ever seen."""
    spark = df.sparkSession
    jvm, aside = spark.sparkContext._jvm, f"{path}.tmp"
    write_csv(df, aside, sep, one_file=True)
    at = jvm.org.apache.hadoop.fs.Path(aside)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{aside}/part-*"))]
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not rename to {path}")
    fs.delete(at, True)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Small aggregate tables as JSON lines or TSV in one file."""
    out = rows.coalesce(1).write.mode("overwrite")
    if kind == "json":
        out.json(path)
    elif kind == "tsv":
        out.option("header", True).csv(path, sep="\t")
    else:
        raise ValueError(f"unknown kind {kind!r}")


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of at most `most` rows of an aggregate."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(most).collect()]
    return "\n".join([head, *body])


def cached(spark: SparkSession, path: str, make, schema=None) -> DataFrame:
    """The table at path if it is complete, else `make()` written there; an empty result is never kept."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return spark.read.parquet(path)
    df = make()
    if df.isEmpty():
        return df
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has; Spark's committer makes the change visible when all tasks are done."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def checksum(df: DataFrame) -> DataFrame:
    """A hash of a table's content that doesn't depend on the order of rows: count, xor and sum of md5 prefixes of rows."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    part = lambda k: F.conv(F.substring(F.md5(row.cast("binary")), k, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("xor"), F.coalesce(F.sum(part(9)), F.lit(0)).alias("total"))


def compare(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Largest absolute difference over the values and rows without a match."""
    left = a.select(*on, *(F.col(f"`{v}`").alias(f"_a_{i}") for i, v in enumerate(values)), F.lit(1).alias("_a"))
    right = b.select(*on, *(F.col(f"`{v}`").alias(f"_b_{i}") for i, v in enumerate(values)), F.lit(1).alias("_b"))
    both = left.join(right, on, "full")
    gaps = [F.abs(F.col(f"_a_{i}") - F.col(f"_b_{i}")) for i in range(len(values))]
    return both.agg(F.max(F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("max_diff"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"))
