"""Sharding by vector bin packing.

Groups of equal texts are items with three sizes: bytes, tokens (words) and rows. Items are placed by descending size, each
in the shard where the dot product of its sizes with the shard's residual capacity is highest among those that it fits
(Panigrahy et al., 2011).

Placing is sequential, so it runs over a bounded number of items: groups are hashed into BUNDLES bundles, and a group that
by itself is above 1 / (HEAVY x shards) of any total is an item of its own (there are at most 3 x HEAVY x shards of them).
A group larger than a shard's fair share can't stay together: its rows are split by a hash into pieces of at most a
quarter of a shard. Only these items, whose number doesn't depend on the tables, reach the driver.

Slots are numbered without a gather: rows are counted per shard and chunk (a hash of bundle and row of bounded size),
the counts give each chunk its first slot, and rows are numbered within their chunk.

Cases: null and empty texts have size 1 and form one group each; repeated rows are placed as their text is and get slots of
their own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import columns_only, lookup, written

BUNDLES = 1 << 14
HEAVY = 64
#: Rows that are numbered in one window, about.
CHUNK_ROWS = 50_000


def place(items: list[tuple], shards: int) -> list[int]:
    """Shards for items (key, bytes, tokens, rows), in the given order of items."""
    if not items:
        return []
    sizes = np.array([x[1:] for x in items], np.float64)
    unit = sizes / np.maximum(sizes.sum(axis=0), 1) * shards  # a shard's fair share is 1 in each dimension
    order = sorted(range(len(items)), key=lambda i: (-unit[i].max(), items[i][0]))
    rest = np.ones((shards, 3))
    out = [0] * len(items)
    for i in order:
        v = unit[i]
        dot = rest @ v
        fits = (rest >= v).all(axis=1)
        if fits.any():
            dot = np.where(fits, dot, -np.inf)
        at = int(np.argmax(dot))
        rest[at] -= v
        out[i] = at
    _even(sizes[:, 0], out, shards)
    return out


def _even(size: np.ndarray, where: list[int], shards: int, moves: int = 1000) -> None:
    """Evens the bytes out where the three sizes pulled apart: the item nearest to half the gap goes from the fullest to the
    emptiest shard, as long as that narrows it."""
    place = np.array(where)
    total = np.bincount(place, weights=size, minlength=shards)
    for _ in range(moves):
        high, low = int(total.argmax()), int(total.argmin())
        gap = total[high] - total[low]
        mine = np.flatnonzero(place == high)
        best = mine[np.abs(size[mine] - gap / 2).argmin()] if len(mine) else None
        if best is None or not 0 < size[best] < gap:
            break
        place[best] = low
        total[high] -= size[best]
        total[low] += size[best]
    where[:] = place.tolist()


def pack(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, n_tokens, shard, slot."""
    spark = docs.sparkSession
    given = columns_only(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = given.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_tokens"),
        F.xxhash64(text, F.col("text").isNull()).alias("group"),
    )
    rows = written(rows, "pack")
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", "n_tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    over = lambda share: (F.col("bytes") > share * total["bytes"]) | (F.col("tokens") > share * (total["tokens"] + 1)) | (F.col("rows") > share * total["rows"])
    groups = rows.groupBy("group").agg(*sums)
    # Groups that are items of their own, and into how many pieces they are split: 1 but for those above a fair share.
    most = F.greatest(F.col("bytes") / total["bytes"], F.col("tokens") / (total["tokens"] + 1), F.col("rows") / total["rows"]) * shards
    heavy = groups.where(over(1 / (HEAVY * shards))).select("group", F.when(most > 1, F.ceil(most * 4)).otherwise(1).cast("int").alias("pieces"))
    heavy = spark.createDataFrame([tuple(r) for r in heavy.collect()], "group long, pieces int")  # at most 3 * HEAVY * shards
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod("group", F.lit(BUNDLES)))).otherwise(
        F.concat_ws(":", F.lit("g"), "group", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64(F.lit(5), "doc_id"), "pieces")).otherwise(0))
    )
    named = rows.join(F.broadcast(heavy), "group", "left").withColumn("item", item)
    # At most BUNDLES + 3 * HEAVY * shards * pieces rows, whatever the table's size.
    items = [tuple(r) for r in named.groupBy("item").agg(*sums).orderBy("item").collect()]
    chunks = max(1, -(-total["rows"] // (CHUNK_ROWS * BUNDLES)))
    where = spark.createDataFrame(list(zip([x[0] for x in items], place(items, shards), [chunks if x[0][0] == "b" else max(1, -(-x[3] // CHUNK_ROWS)) for x in items])), "item string, shard int, parts long")
    # A chunk: rows of one item, split further where an item has many rows.
    placed = named.join(F.broadcast(where), "item").withColumn("chunk", F.concat_ws("/", "item", F.pmod(F.xxhash64(F.lit(9), "doc_id", "text_crc32"), "parts")))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.select("shard", "chunk", first.alias("first")), "offsets")
    numbered = placed.withColumn("within", F.row_number().over(W.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32")) - 1)
    slotted = lookup(numbered, offsets, ["shard", "chunk"], "inner")
    return slotted.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("first") + F.col("within")).alias("slot"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
