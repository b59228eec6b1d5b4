"""Repeated passages by relative Lempel-Ziv parsing.

A window of 13 words that also starts in an earlier document (a smaller doc_id) is a repeat; its words go. To compare every
document with all earlier text without comparing every two documents, the reference is cut by content. Of the k-grams of a
window the one with the smallest hash (the rightmost of equals) is its anchor, so equal windows have equal anchors at the same
place, wherever they stand. Consecutive windows with one anchor form a segment of 13 to 21 words; segments with the same
anchor form a reference block. Each window lies in one segment of its document, and all its other occurrences lie in segments
of the same block.

1. Texts that equal a whole earlier one are repeats as they are. Of all others the anchors are counted; those of one
   occurrence can't be repeats. A bit map of the others, sized by their number up to a bound, keeps nearly all unrepeated
   segments from being written; what it lets through only costs time.
2. Equal segments are one, with their smallest and largest doc_id, summed up before they are dealt.
3. A task reads a block in ascending order of doc_id. The segments read so far are indexed in a suffix automaton over words;
   the next one is factored greedily: the automaton follows it as long as the reference goes on with the same words. A factor
   of 13 words or more is a repeat. At its end, the suffix links keep the longest tail of the factor that the reference goes
   on with, so that windows across the boundary of two factors are found too.
4. The decisions go back to the segments' documents: a segment whose words stand in an earlier document is repeated as a whole,
   else the windows that its factors cover are.

Blocks of more than `most` different segments (a very frequent k-gram) are cut again: each window of their different segments
is a block of its own, whose members are all equal, so that its factor is the window and its smallest doc_id decides. So no
task holds more than `most` segments of a block, and a block costs what its different segments cost, not their pairs.

Cases: null and empty texts have no words, texts of fewer than 13 words no window; a repeat within one document isn't one, nor
are repeats among rows of one doc_id; a null doc_id comes after all others, and rows without an id don't repeat each other;
repeated rows each get a result; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, lookup, map_rows, text_key, together, written
from sievework.llm.winnowing import WordHashes

WINDOW, GRAM = 13, 5
#: Different segments of a block that one task indexes.
MOST = 2048
#: Bits of the map for each anchor that it holds, and at most: 16 MB, sent to every task.
BITS_EACH, MOST_BITS = 16, 27
LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments of a text: first window, number of windows, anchor (the hash of its k-gram)."""
    windows = len(words) - WINDOW + 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - GRAM + 1
    gram = np.full(n, np.uint64(GRAM))
    for i in range(GRAM):
        gram = (gram ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    best, place = gram[:windows].copy(), np.zeros(windows, np.int64)
    for o in range(1, WINDOW - GRAM + 1):
        other = gram[o : o + windows]
        lower = other <= best
        best[lower], place[lower] = other[lower], o
    place += np.arange(windows)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return first, np.diff(np.append(first, windows)), best[first]


class Reference:
    """A suffix automaton over the words of the texts added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extended(last, w)

    def _extended(self, last: int, w) -> int:
        """The state of the text that ends in `last`, followed by w; shared with earlier texts where these have it."""
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(w)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, w, known)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last >= 0 and w not in nxt[last]:
            nxt[last][w] = new
            last = link[last]
        if last >= 0:
            known = nxt[last][w]
            link[new] = known if length[known] == length[last] + 1 else self._split(last, w, known)
        return new

    def _split(self, last: int, w, known: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[known]))
        length.append(length[last] + 1)
        link.append(link[known])
        link[known] = copy
        while last >= 0 and nxt[last].get(w) == known:
            nxt[last][w] = copy
            last = link[last]
        return copy

    def factors(self, words: list, least: int = WINDOW) -> list[tuple[int, int]]:
        """Stretches of `words`, of `least` words and more, that the reference holds and that can't be made longer."""
        nxt, link, length = self.next, self.link, self.length
        state, have, out = 0, 0, []
        for at, w in enumerate(words):
            if w not in nxt[state]:
                if have >= least:
                    out.append((at - have, at))
                while state > 0 and w not in nxt[state]:
                    state = link[state]
                have = length[state]
            if w in nxt[state]:
                state, have = nxt[state][w], have + 1
        if have >= least:
            out.append((len(words) - have, len(words)))
        return out


def repeated(segments: list[tuple[int, list]]) -> list[int]:
    """For each (doc, words), in ascending order of doc, its windows that an earlier doc's segment holds, as bits."""
    out, reference = [], Reference()
    for doc, same in groupby(segments, key=lambda s: s[0]):
        same = [words for _, words in same]
        for words in same:
            bits = 0
            for start, stop in reference.factors(words):
                bits |= ((1 << (stop - WINDOW + 1)) - 1) >> start << start
            out.append(bits)
        if len(out) < len(segments):
            for words in same:
                reference.add(words)
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, number, text_key, text, and whether the whole text is that of an earlier document."""
    rows = columns_only(docs, "doc_id", "text")
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("number"), text_key(F.col("text")).alias("text_key"), F.md5(F.col("text").cast("binary")).alias("_md5"), "text")
    several = rows.where("text is not null").groupBy("_md5").agg(F.min("number").alias("_low"), F.max("number").alias("_high")).where("_low < _high")
    marked = lookup(rows, checkpointed(several.select("_md5", "_low")), ["_md5"])
    return marked.select("doc_id", "number", "text_key", "text", F.coalesce(F.col("number") > F.col("_low"), F.lit(False)).alias("copy"))


def _frequent_anchors(rows: DataFrame) -> DataFrame:
    """Anchors that stand in more than one row."""

    def run(it):
        known = WordHashes()
        for (text,) in it:
            yield (np.unique(anchors(words_of(text), known)[2]).view(np.int64).tolist(),)

    each = map_rows(rows.select("text"), run, "anchors array<long>", pa.schema([("anchors", pa.list_(pa.int64()))]))
    return each.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")


def bit_map(frequent: DataFrame, most_bits: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """A bit for the leading bits of each value, and their number: enough for the count of values, `most_bits` at most."""
    bits = min(max(12, (frequent.count() * BITS_EACH).bit_length()), most_bits)
    slots = frequent.select(F.shiftrightunsigned("anchor", 64 - bits).alias("slot"))
    cells = slots.select(F.expr("slot div 64").alias("cell"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for cell, found in cells.groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():
        out[cell] = np.uint64(found & 0xFFFFFFFFFFFFFFFF)
    return out, bits


_SEGMENT_DDL = "number long, text_key long, first int, windows int, anchor long, seg binary, words string"
_SEGMENT = pa.schema([("number", pa.int64()), ("text_key", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int64()), ("seg", pa.binary()), ("words", pa.string())])


def _segments(rows: DataFrame, frequent: DataFrame, most_bits: int) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(bit_map(frequent, most_bits))

    def run(it):
        (bit, bits), known = held.value, WordHashes()
        for number, key, text in it:
            words = words_of(text)
            first, windows, anchor = anchors(words, known)
            slot = anchor >> np.uint64(64 - bits)
            keep = np.flatnonzero((bit[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
            for at, n, a in zip(first[keep].tolist(), windows[keep].tolist(), anchor[keep].view(np.int64).tolist()):
                own = b" ".join(words[at : at + n + WINDOW - 1])
                yield number, key, at, n, a, xxhash.xxh3_128_digest(own), own.decode("utf-8", "replace")

    return map_rows(rows.select("number", "text_key", "text"), run, _SEGMENT_DDL, _SEGMENT)


_DECISION = pa.schema([("seg", pa.binary()), ("low", pa.int64()), ("high", pa.int64()), ("bits", pa.int32())])


def _cut(large: DataFrame) -> DataFrame:
    """Segments of blocks that are too large (seg, words, low, high) to (seg, low, high, bits): each of their windows is a block of
    its own, of which only the smallest doc_id counts."""
    at = F.explode(F.expr(f"sequence(0, size(split(words, ' ')) - {WINDOW})"))
    pieces = large.select("seg", "low", "high", F.split("words", " ").alias("w"), at.alias("at"))
    pieces = pieces.select("seg", "low", "high", "at", F.unhex(F.md5(F.array_join(F.slice("w", F.col("at") + 1, WINDOW), " ").cast("binary"))).alias("piece"))
    first = checkpointed(pieces.groupBy("piece").agg(F.min("low").alias("first")))
    repeated_at = F.when(F.col("first") < F.col("low"), F.expr("shiftleft(1, at)")).otherwise(0)
    return lookup(pieces, first, ["piece"], "inner").groupBy("seg", "low", "high").agg(F.bit_or(repeated_at).alias("bits"))


def _decided(segments: DataFrame, most: int) -> DataFrame:
    """(seg, low, bits) of the segments with a repeated window: low is the smallest doc_id that has the segment; of this document
    the windows `bits` are repeats, of all others the whole segment is."""
    different = written(segments.groupBy("anchor", "seg", "words").agg(F.min("number").alias("low"), F.max("number").alias("high")), "blocks")
    sizes = different.groupBy("anchor").agg(F.count("*").alias("n"))
    several = checkpointed(sizes.where("n > 1").select("anchor", (F.col("n") > most).alias("large")))
    met = lookup(different, several, ["anchor"])
    blocks = together(met.where("not large"), ["anchor"], "low", "seg").select("anchor", "low", "high", "seg", "words")

    def run(it):
        for _, block in groupby(it, key=lambda r: r[0]):
            block = list(block)
            bits = repeated([(low, words.split(" ")) for _, low, _, _, words in block])
            yield from ((seg, low, high, b) for (_, low, high, seg, _), b in zip(block, bits))

    columns = ["seg", "low", "high", "bits"]
    found = met.where("large is null").select("seg", "low", "high", F.lit(0).alias("bits")).unionByName(map_rows(blocks, run, "seg binary, low long, high long, bits int", _DECISION))
    if not several.where("large").isEmpty():
        found = found.unionByName(_cut(met.where("large")).select(columns))
    return written(found.where("bits <> 0 or low < high").select("seg", "low", "bits"), "factors")


_OUT_DDL = "doc_id long, n_words long, n_removed long, spans array<struct<start:int,stop:int>>, kept string"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.string())])


def _stretches(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word stretches that windows, given as (first, bits), cover."""
    starts = sorted({first + j for first, bits in windows for j in range(bits.bit_length()) if bits >> j & 1})
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + WINDOW
        else:
            out.append([s, s + WINDOW])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, most: int = MOST, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (of removed words), kept (the other words, one space apart)."""
    rows = _numbered(docs)
    first = rows.where("not copy")
    frequent = written(_frequent_anchors(first), "anchors")
    segments = written(_segments(first, frequent, most_bits), "segments")
    decided = _decided(segments, most)
    found = lookup(segments.select("number", "text_key", "first", "windows", "seg"), decided, ["seg"], "inner", 300_000)
    whole = F.expr("shiftleft(1, windows) - 1")
    hits = found.select("number", "text_key", "first", F.when(F.col("number") > F.col("low"), whole).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")
    per = hits.groupBy("number", "text_key").agg(F.collect_set(F.struct("first", "bits")).alias("windows"))
    joined = rows.join(per, ["number", "text_key"], "left").select("doc_id", "text", "copy", "windows")

    def run(it):
        for doc_id, text, copy, windows in it:
            words = words_of(text)
            if copy:
                spans = [(0, len(words))] if len(words) >= WINDOW else []
            else:
                spans = _stretches([(w["first"], w["bits"]) for w in windows or ()])
            kept, at = [], 0
            for start, stop in spans:
                kept += words[at:start]
                at = stop
            kept += words[at:]
            yield doc_id, len(words), len(words) - len(kept), [{"start": a, "stop": b} for a, b in spans], b" ".join(kept).decode("utf-8", "replace")

    return map_rows(joined, run, _OUT_DDL, _OUT)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
