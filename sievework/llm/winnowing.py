"""Benchmark decontamination by winnowing.

Words are hashed, k consecutive words make a k-gram, and of each w consecutive k-gram hashes the smallest (the rightmost of
equals) is kept as a fingerprint (Schleimer, Wilkerson and Aiken, 2003). A span of k + w - 1 words that a document shares
with an item therefore yields the same fingerprint, at the same place of the span, on both sides. With k = 5 and w = 6 that
holds for every window of ten words. Items of fewer words are one window; for each such length t that occurs there is a
scheme of its own with k = ceil(t / 2) and w = t - k + 1.

Each window's fingerprint is the smallest k-gram in it. Documents look it up in a bit map of the items' fingerprints (fixed
size, whatever the tables' size); a hit is extended to its whole window, whose 128-bit digest must pass a second bit map.
What passes is joined with the items on fingerprint and digest together, so a k-gram that is frequent in documents and in
items meets only the items that agree in the whole window. The hit places are united per document. So what is shuffled are
real hits, the few false ones of the bit maps, and a narrow row per document.

Cases: null and empty texts have no words, as documents and as items; repeated document rows each get a result; repeated
items count once per item_id; items without an id are matched, but not named in `items`; an empty benchmark leaves every
document clean; extra columns are ignored, or kept by `keep_clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, drop_listed, map_rows, text_key

WINDOW = 10
#: Bits of each of the two maps, of item fingerprints and of item windows: 2 MB, sent to every task.
MAP_BITS = 24
#: Item windows, and ids of them, that are broadcast at most, of about 70 bytes each; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 500_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all other non-ASCII characters, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it holds too many words, so its memory is bounded."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def scheme(t: int) -> tuple[int, int]:
    """k and w that guarantee a fingerprint in every shared span of t words."""
    k = (t + 1) // 2
    return k, t - k + 1


def fingerprints(hashes: np.ndarray, t: int) -> np.ndarray:
    """The fingerprint of each window of t words: the smallest hash of its k-grams."""
    k, w = scheme(t)
    n = len(hashes) - k + 1
    if n < w:
        return np.zeros(0, np.uint64)
    gram = np.full(n, np.uint64(t))
    for i in range(k):
        gram = (gram ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(31)
    best = gram[w - 1 :].copy()
    for back in range(1, w):
        np.minimum(best, gram[w - 1 - back : n - back], out=best)
    return best


def _hash_row(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _window(words: list[bytes], at: int, t: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[at : at + t]))


def _slot(window: bytes) -> int:
    return int.from_bytes(window[:8], "big") >> (64 - MAP_BITS)


_PRINTS_DDL = "item_id long, t int, print long, print_slot int, window binary, window_slot int"
_PRINTS_ARROW = pa.schema([("item_id", pa.int64()), ("t", pa.int32()), ("print", pa.int64()), ("print_slot", pa.int32()), ("window", pa.binary()), ("window_slot", pa.int32())])


def _item_prints(items: DataFrame) -> DataFrame:
    def rows(it):
        known = WordHashes()
        for item_id, text in it:
            words = words_of(text)
            if not words:
                continue
            t = min(WINDOW, len(words))
            for at, h in enumerate(fingerprints(_hash_row(words, known), t).tolist()):
                window = _window(words, at, t)
                yield item_id, t, _signed(h), h >> (64 - MAP_BITS), window, _slot(window)

    return map_rows(columns_only(items, "item_id", "text"), rows, _PRINTS_DDL, _PRINTS_ARROW)


def _bit_map(slots: DataFrame, slot: str) -> np.ndarray:
    """One bit for each slot that occurs: at most 2^MAP_BITS bits reach the driver, whatever the number of items."""
    cells = slots.select(F.expr(f"cast({slot} div 64 as int)").alias("cell"), F.expr(f"shiftleft(1L, cast({slot} % 64 as int))").alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for cell, bits in cells.groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():
        out[cell] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _in_map(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0


_DOC_DDL = "doc_id long, text_key long, n_words long, hits array<struct<t:int,print:long,window:binary,place:int>>"
_HIT = pa.struct([("t", pa.int32()), ("print", pa.int64()), ("window", pa.binary()), ("place", pa.int32())])
_DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT))])


def _doc_prints(docs: DataFrame, lengths: list[int], prints: np.ndarray, windows: np.ndarray) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast((prints, windows))

    def rows(it):
        (of_prints, of_windows), hashed = known.value, WordHashes()
        for doc_id, key, text in it:
            words = words_of(text)
            hashes = _hash_row(words, hashed)
            # One row of each document counts it. No item has t = 0; the id's hash spreads these rows in a shuffle.
            hits = [{"t": 0, "print": _signed(xxhash.xxh64_intdigest(str(doc_id), 7)), "window": b"", "place": None}]
            for t in lengths:
                best = fingerprints(hashes, t)
                places = np.flatnonzero(_in_map(of_prints, best >> np.uint64(64 - MAP_BITS))).tolist()
                found = [_window(words, at, t) for at in places]
                passed = _in_map(of_windows, np.array([_slot(x) for x in found], np.uint64)).tolist()
                hits += [{"t": t, "print": _signed(int(best[at])), "window": x, "place": at} for at, x, ok in zip(places, found, passed) if ok]
            yield doc_id, key, len(words), hits

    given = columns_only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return map_rows(given, rows, _DOC_DDL, _DOC_ARROW)


def _matched(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document (t = 0) and per window of it that passes the maps, with the ids of the items that hold the window
    (null where none does)."""
    prints = checkpointed(_item_prints(items))
    lengths = [r.t for r in prints.select("t").distinct().orderBy("t").collect()]  # ten at most
    # Equal windows, as in repeated items, are one row with a list of items.
    right = checkpointed(prints.groupBy("t", "print", "window").agg(F.collect_set("item_id").alias("item_ids")))
    few = right.agg(F.coalesce(F.sum(F.size("item_ids") + 1), F.lit(0))).first()[0] <= BROADCAST_FINGERPRINTS
    each = _doc_prints(docs, lengths, _bit_map(prints, "print_slot"), _bit_map(prints, "window_slot"))
    one = each.select("doc_id", "text_key", "n_words", F.explode("hits").alias("h")).select("doc_id", "text_key", "n_words", "h.*")
    return one.join(F.broadcast(right) if few else right, ["t", "print", "window"], "left")


_UNITED = """aggregate(raw, cast(array() as array<struct<start:int,stop:int>>), (acc, s) ->
    if(size(acc) > 0 and element_at(acc, -1).stop >= s.start,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, s.stop)))),
       concat(acc, array(s))))"""


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, spans (united, in words), items (sorted ids), contaminated."""
    hit = F.col("item_ids").isNotNull()
    spans = _matched(docs, items).select(
        "doc_id", "text_key", "n_words", (F.col("t") == 0).alias("whole"),
        F.when(hit, F.struct(F.col("place").alias("start"), (F.col("place") + F.col("t")).alias("stop"))).alias("span"), "item_ids",
    )
    # Rows of one id and text have equal hits: they are counted, handled once and given out again.
    per = spans.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if("whole").cast("int").alias("rows"),
        F.array_sort(F.collect_set("span")).alias("raw"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("item_ids"))), lambda x: x.cast("string"))).alias("items"),
    )
    per = per.withColumn("spans", F.expr(_UNITED)).withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return per.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    return drop_listed(docs, decontaminate(docs, items).where("contaminated").select("doc_id", "text_key"))


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
