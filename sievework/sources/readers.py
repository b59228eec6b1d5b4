"""Readers: schemas are always given, keys are strings, NaN becomes null."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.ranks import null_if_nan
from sievework.operators import quality
from sievework.operators.labels import to_long


def wide_schema(ids: list[str], labels: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.StringType()) for c in ids), *(T.StructField(c, T.DoubleType()) for c in labels)])


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: null_if_nan(F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def first_lines(spark: SparkSession, path: str | list[str], n: int = 1) -> dict[str, list[str]]:
    """The first n lines of each file of a path, glob or list: the files are opened, not read, several at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def lines(uri: str) -> tuple[str, list[str]]:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            read = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream if codec is None else codec.createInputStream(stream), "UTF-8"))
            found = [read.readLine() for _ in range(n)]
        finally:
            stream.close()
        return at.toString(), [x for x in found if x is not None]

    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(lines, sorted(spark.read.text(path).inputFiles())))


def columns_of(line: str, sep: str = ",") -> list[str]:
    """The cells of a header line, without quotes, blanks around them or a byte order mark."""
    return [c.strip() for c in next(csv.reader([line.removeprefix("\ufeff")], delimiter=sep, skipinitialspace=True))]


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file, or of the first file of a folder."""
    for lines in first_lines(spark, path).values():
        return columns_of(lines[0], sep) if lines else []
    return []


def _by_header(spark: SparkSession, path: str | list[str], sep: str, n: int = 1) -> list[tuple[list[str], list[list[str]], list[str]]]:
    """(columns, further lines, files) for each group of files that start alike; files without a line are left out."""
    alike: dict[tuple, list[str]] = {}
    for file, lines in first_lines(spark, path, n).items():
        if lines:
            alike.setdefault(tuple(lines), []).append(file)
    return [(columns_of(head, sep), [columns_of(x, sep) for x in more], files) for (head, *more), files in sorted(alike.items())]


def _typed(spark: SparkSession, names: list[str], files: list[str], sep: str, kinds: dict[str, T.DataType], wanted: list[str]) -> DataFrame:
    """The wanted columns, by name, of files with one header; an unnamed or repeated column can't be asked for."""
    at = {n: i for i, n in reversed(list(enumerate(names)))}
    schema = T.StructType([T.StructField(f"c{i}", kinds.get(n, T.StringType())) for i, n in enumerate(names)])
    part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nanValue", "nan").csv(files, sep=sep)
    return part.select(*(F.col(f"c{at[c]}").alias(c) for c in wanted if c in at))


def _together(spark: SparkSession, path: str | list[str], sep: str, kinds: dict[str, T.DataType], wanted: list[str], parts=None) -> DataFrame:
    """Files of any column order as one table; a wanted column that no file has is an error, one that some lack is null there."""
    groups = parts if parts is not None else [(names, files) for names, _, files in _by_header(spark, path, sep)]
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in wanted])
    if not groups:
        return spark.createDataFrame([], schema)
    lacking = [c for c in wanted if not any(c in names for names, _ in groups)]
    if lacking:
        raise quality.DataError(f"{path}: no file has the columns {lacking}")
    out = None
    for names, files in groups:
        part = _typed(spark, names, files, sep, kinds, wanted)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.select(*(F.col(f"`{c}`") for c in wanted))


def read_table(spark: SparkSession, path: str | list[str], ids: list[str], labels: list[str]) -> DataFrame:
    """CSV with string keys and double labels; columns by name, quoted or not, others are pruned. Files of one path may have
    their columns in different orders: those of one header are read together; a column that only some have is null in the
    others, and one that none has is an error."""
    return nan_to_null(_together(spark, path, ",", {c: T.DoubleType() for c in labels}, [*ids, *labels]))


def read_coded(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Pipe-separated cells, all strings, by name in each file."""
    return _together(spark, path, "|", {}, columns)


def read_described(spark: SparkSession, path: str | list[str], columns: list[str], key: str) -> DataFrame:
    """TSV whose second line describes the columns: that row goes, by its key cell, wherever splits fall."""
    out = None
    for names, more, files in _by_header(spark, path, "\t", 2):
        rows = _together(spark, path, "\t", {}, list(dict.fromkeys([*columns, key])), [(names, files)])
        if more:
            rows = rows.where(F.col(f"`{key}`").isNull() | (F.col(f"`{key}`") != more[0][names.index(key)]))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return _together(spark, path, "\t", {}, columns, [])
    return out.select(*(F.col(f"`{c}`") for c in columns))


def load_sources(spark: SparkSession, root: str, files: dict[str, str], names: list[str], index: DataFrame, labels: list[str], uid: str = "uid") -> tuple[DataFrame, list[str]]:
    """The named sources in long form on the index, and what was left out and why.

    An unknown name is an error; a missing file or missing columns leave the source out; no source at all is an error.
    """
    unknown = [n for n in names if n not in files]
    if unknown:
        raise quality.DataError(f"unknown sources {unknown}")
    parts, notes = [], []
    for n in names:
        path = f"{root}/{files[n]}"
        try:
            have = header(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            notes.append(f"{n}: no file")
            continue
        lacking = [c for c in labels if c not in have]
        if lacking:
            notes.append(f"{n}: no columns {lacking}")
            continue
        rows = to_long(read_table(spark, path, [uid], labels), labels, [uid])
        every = index.select(uid).crossJoin(F.broadcast(rows.select("label").distinct()))
        parts.append(every.join(rows, [uid, "label"], "left").select(uid, F.lit(n).alias("source"), "label", "value"))
    if not parts:
        raise quality.DataError(f"no source could be read: {notes}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, notes


def source_coverage(sources: DataFrame) -> DataFrame:
    return sources.groupBy("source", "label").agg(F.count("value").alias("known"), F.count("*").alias("rows"))


def load_teachers(spark: SparkSession, files: dict[str, str], labels: list[str], uid: str = "uid") -> DataFrame:
    """Teacher tables in long form; missing columns, duplicate uids and values outside [0, 1] are errors."""
    out = None
    for n, path in files.items():
        lacking = [c for c in labels if c not in header(spark, path)]
        if lacking:
            raise quality.DataError(f"{n}: no columns {lacking}")
        wide = read_table(spark, path, [uid], labels)
        quality.require(quality.duplicates(wide, [uid]), f"{n}: duplicate uids")
        long = to_long(wide, labels, [uid]).select(uid, F.lit(n).alias("source"), "label", "value")
        quality.require(quality.out_of_range(long, "value"), f"{n}: values outside [0, 1]")
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise quality.DataError("no teacher tables")
    return out


def read_oof(spark: SparkSession, root: str, ids: list[str], labels: list[str], epochs: bool = False) -> DataFrame:
    """Out-of-fold files <version>_fold<k>_oof.csv, or with epochs <version>_fold<k>_ep<e>_oof.csv, with what their names say."""
    fold = "_fold{[0-9],[0-9][0-9],[0-9][0-9][0-9]}"
    pattern = f"*{fold}_ep*_oof.csv" if epochs else f"*{fold}_oof.csv"
    columns = [*ids, *(f"{kind}__{c}" for c in labels for kind in ("pred", "y", "w"))]
    schema = T.StructType([T.StructField(c, T.StringType() if c in ids else T.DoubleType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(f"{root}/{pattern}").withColumn("_f", F.col("_metadata.file_name"))
    name = r"^(v\w+?)_fold(\d+)(?:_ep(\d+))?_oof\.csv$"
    part = lambda k: F.regexp_extract("_f", name, k)
    return nan_to_null(df.withColumns({"version": part(1), "fold": part(2).cast("int"), "epoch": part(3).try_cast("int")}).drop("_f"))


def oof_long(wide: DataFrame, labels: list[str], ids: list[str]) -> DataFrame:
    """(ids..., label, pred, y, w)."""
    cells = F.array(*(F.struct(F.lit(c).alias("label"), *(F.col(f"`{k}__{c}`").alias(k) for k in ("pred", "y", "w"))) for c in labels))
    return wide.select(*ids, F.explode(cells).alias("c")).select(*ids, "c.*")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that Spark can list; no tree below it is walked."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).globStatus(path):
            return p
    raise FileNotFoundError(f"none of {paths}")


def shallow_glob(root: str, name: str, depth: int = 3) -> list[str]:
    """Glob paths down to a depth, for spark.read; deeper trees aren't listed."""
    return [f"{root}/{'*/' * d}{name}" for d in range(depth + 1)]


def read_views(spark: SparkSession, root: str) -> DataFrame:
    """View probabilities (shard, view, uid, label, p) of Parquet shards; unfinished .tmp files aren't read."""
    schema = "shard string, view string, uid string, label string, p double"
    df = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(root)
    return nan_to_null(df.where(~F.col("_metadata.file_name").contains(".tmp")))


MANIFEST = "uid string, slots string, n_slots int, side string, shard int, blob string, row int, cached int, mask string, cache_version string"


def read_manifests(spark: SparkSession, paths: str | list[str], mask_width: int = 6) -> DataFrame:
    """Union of manifest shards, columns by name in each: cached rows with a version only; the mask keeps its leading zeros."""
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(MANIFEST)}
    df = _together(spark, paths, ",", kinds, list(kinds))
    return df.where((F.col("cached") == 1) & F.col("cache_version").isNotNull()).withColumn("mask", F.lpad("mask", mask_width, "0"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole log files, one row each, for `functions.text.log_lines`."""
    return spark.read.text(path, wholetext=True)
