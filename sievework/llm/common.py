"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that `lookup` and `drop_listed` broadcast; rows there are a few numbers wide.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder of a local
    session; on a cluster that is an error, as no other machine would see it."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-sievework-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; for narrow tables and the rounds of a loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the table once to the shared folder and reads it back: several readers, one computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, taken by position, so that extra columns (also of the same name in another case) do no harm."""
    seen: dict[str, int] = {}
    for at, c in enumerate(df.columns):
        seen.setdefault(c, at)
    lower = {c.lower(): at for at, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*(f"c{at}" for at in range(len(df.columns))))
    return plain.select(*(F.col(f"c{seen.get(n, lower.get(n.lower()))}").alias(n) for n in names))


def in_batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `most` rows from tuples."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= most:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def small_batches(spark: SparkSession) -> None:
    """Rows here are whole texts: where the session has Arrow's default of 10,000 rows a batch, 1,000 are sent at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def row_stream(batches: Iterable[pa.RecordBatch], at_once: int = 200) -> Iterator[tuple]:
    """Rows as tuples; only a slice of a batch is held as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            yield from zip(*(c.to_pylist() for c in b.slice(at, at_once).columns))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str, arrow: pa.Schema) -> DataFrame:
    """fn over the rows of each partition as a stream of tuples, batched by Arrow; nothing of a partition is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(fn(row_stream(batches)), arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ddl)


def lookup(left: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with `small` (one row per key): broadcast if it has at most `limit` rows, else shuffled, where AQE splits hot keys.

    `small` must be cheap to count (a checkpointed or written table).
    """
    few = small.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(small) if few else small, on, how)


def together(rows: DataFrame, by: list[str], *then: str) -> DataFrame:
    """Deals rows so that those of one key `by` are in one task and follow one another, in the order of `then`.

    For `map_rows`, of which Spark can't know that it needs whole keys: behind a join on the same columns it drops a repartition by
    them, and then may read the join's partitions in parts (as a local read once a side proves small, or a split of a skewed one).
    A repartition by a hash of the columns isn't the join's, and stays.
    """
    return rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *then)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def drop_listed(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text) isn't listed; listed: doc_id, text_key. Null ids match null ids."""
    listed = checkpointed(listed.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    few = listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = F.broadcast(listed) if few else listed
    return docs.join(right, docs["doc_id"].eqNullSafe(right["_id"]) & (text_key(docs["text"]) == right["_key"]), "left_anti")


def connected_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(a, b) edges of long nodes to (node, component), the component being its smallest node; one row per node with an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round is two grouped
    minima and two joins, so a hub's neighbours are never gathered. Nodes without an edge to another node aren't returned.
    """
    now = _distinct_edges(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    seen = _mark(now)
    if not seen[0]:
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        large = large.distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("x"), F.col("m").alias("y")), F.struct(F.col("lo").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = _distinct_edges(small.select(F.greatest("e.x", "e.y").alias("hi"), F.least("e.x", "e.y").alias("lo")))
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("connected_components did not settle")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _distinct_edges(edges: DataFrame) -> DataFrame:
    return checkpointed(edges.where("hi <> lo").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.shiftright(F.xxhash64("lo", "hi"), 24))).first())


def local_file(path: str) -> bytes:
    """A bounded public file (a tokenizer's vocabulary), read on the driver and sent along with the tasks."""
    with open(os.fspath(path), "rb") as f:
        return f.read()
