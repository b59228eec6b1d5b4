"""Token ids in canonical, length-limited Huffman code.

Code lengths come from the counts of all ids of the corpus by package-merge (Larmore and Hirschberg, 1990), at most MAX_BITS
bits, or as many as the number of distinct ids needs (then a decoding table has up to twice as many entries as there are ids);
codes are canonical, so the lengths alone are the table. The ids of consecutive documents, in ascending doc_id order,
form blocks; a block is decoded on its own. Within a block, the bit offset of every STRIDE-th id is kept as a checkpoint, so
a reader can enter there, and decoding runs from all checkpoints in step: one look at as many bits as the longest code has gives an id and its
length by table.

File format: Parquet in a folder `blocks`, a row per block: part and block number, number of ids, ids before it in its
part, document ids and lengths, checkpoints and the bits (big-endian 64-bit words, first bit highest); and a folder
`lengths`, the code lengths by id. Parts hold ascending ranges of doc_id; Spark's own writer puts the files, so any store
works, and a lost task is written again.

Work per record: the text is tokenised once, to a written table; counts are one grouped sum of at most a vocabulary's rows;
one shuffle by range of doc_id orders the ids.

Cases: a null text is an empty one and gives the end id only; equal doc_ids are ordered by their ids; a null doc_id comes
first; an empty table gives no blocks and an empty result; a corpus of one distinct id gets a code of one bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievework.llm.common import columns_only, in_batches, local_file, map_rows, row_stream, small_batches, written

MAX_BITS = 16
STRIDE = 256
#: Ids of a block at least, when documents follow; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
END_ID = 2


def package_merge(counts: list[int], most: int = MAX_BITS) -> list[int]:
    """Optimal code lengths of at most `most` bits for positive counts."""
    n = len(counts)
    if n == 0:
        return []
    if n == 1:
        return [1]
    if n > 1 << most:
        raise ValueError("more ids than codes")
    c = np.array(sorted(counts), np.float64)
    order = sorted(range(n), key=lambda i: (counts[i], i))
    # Each level merges the single ids with the pairs of the level below; `single` tells which items are ids.
    levels = []
    weights, single = c, np.ones(n, bool)
    for _ in range(most - 1):
        levels.append(single)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([c, pairs])
        by = np.argsort(both, kind="stable")
        weights, single = both[by], by < n
    levels.append(single)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for single in reversed(levels):
        ids = int(np.count_nonzero(single[:take]))
        lengths[:ids] += 1
        take = 2 * (take - ids)
    out = [0] * n
    for i, length in zip(order, lengths.tolist()):
        out[i] = length
    return out


class Code:
    """Codes and the decoding table of canonical code lengths; ids without a length have no code."""

    def __init__(self, lengths: np.ndarray):
        self.length = lengths.astype(np.uint64)
        self.code = np.zeros(len(lengths), np.uint64)
        self.width = max(1, int(lengths.max(initial=0)))
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.bits = np.zeros(1 << self.width, np.uint8)
        at = 0
        ids = np.nonzero(lengths)[0]
        for i in ids[np.lexsort((ids, lengths[ids]))].tolist():
            size = 1 << (self.width - int(lengths[i]))
            self.code[i] = at >> (self.width - int(lengths[i]))
            self.symbol[at : at + size] = i
            self.bits[at : at + size] = lengths[i]
            at += size

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits and the offset of every STRIDE-th id."""
        length, code = self.length[ids], self.code[ids]
        ends = np.cumsum(length)
        starts = ends - length
        word, bit = (starts >> np.uint64(6)).astype(np.int64), starts & np.uint64(63)
        n = int(ends[-1] + np.uint64(127)) // 64 if len(ids) else 1
        room = np.uint64(64) - bit
        fits = length <= room
        high = np.where(fits, code << ((room - length) & np.uint64(63)), code >> ((length - room) & np.uint64(63)))
        out = np.zeros(n + 1, np.uint64)
        # Codes of one word have no bits in common, so their sum is their union; words are ascending runs.
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[first]] = np.add.reduceat(high, first)
            over = np.flatnonzero(~fits)
            out[word[over] + 1] += code[over] << (np.uint64(64) - (length[over] - room[over]))
        return out.astype(">u8").tobytes(), starts[::STRIDE].astype(np.int64)

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u8").astype(np.uint64)
        at = checkpoints.astype(np.uint64)
        out = np.zeros((STRIDE, len(at)), np.uint32)
        live = len(at)
        for k in range(min(STRIDE, n)):
            if k == n - (len(checkpoints) - 1) * STRIDE:
                live -= 1  # the last stretch may be shorter
                at = at[:live]
            word, bit = at >> np.uint64(6), at & np.uint64(63)
            window = words[word] << bit | words[word + np.uint64(1)] >> np.uint64(1) >> (np.uint64(63) - bit)
            window >>= np.uint64(64 - self.width)
            out[k, :live] = self.symbol[window]
            at = at + self.bits[window]
        return out.T.ravel()[:n] if n % STRIDE == 0 else np.concatenate([out[:, :-1].T.ravel(), out[: n % STRIDE, -1]])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: ASCII that is neither letter, digit nor white space, without the apostrophe of contractions and what special tokens hold.
_SYMBOLS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _byte_names() -> dict[int, str]:
    """What the vocabulary calls each byte that isn't printable ASCII, as a table for str.translate over Latin-1."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(others)}


class Words(dict):
    """Stretches of text between white space to their ids, filled on look-up.

    The library's model takes words as its own normaliser and splitter would hand them over: lower-case letters in composed
    form are one word as they stand, and symbols behind what normalises to a letter are a word of their own, to the end. All else
    goes through the whole tokenizer. When the table is full, it becomes the older one of two.
    """

    def __init__(self, encoder: Encoder, older: dict):
        super().__init__()
        self.encoder, self.older = encoder, older

    def __missing__(self, s: bytes) -> bytes:
        if (ids := self.older.get(s)) is None:
            ids = self._made(s)
        self[s] = ids
        return ids

    def _made(self, s: bytes) -> bytes:
        word = self.encoder.word
        if word is not None:
            if s.isalpha() and s.islower():
                return word(s.decode())
            head = s.rstrip(_SYMBOLS)
            if 0 < len(head) < len(s) and (head[-1] in _LETTERS or head[-1] > 127 and self.encoder.ends_in_letter(head.decode("utf-8", "replace"))):
                return self[head] + self[s[len(head) :]]
            text = s.decode("utf-8", "replace")
            if text.isalpha() and text.islower() and is_normalized("NFC", text):
                return word(s.decode("latin-1").translate(_NAMES))
        return self.encoder.whole(s.decode("utf-8", "replace"))


_NAMES = _byte_names()


class Encoder:
    """The tokenizers library on stretches between white space, which no word of the vocabulary's pattern crosses; the ids
    of stretches are kept in a bounded table.

    The vocabulary lower-cases, so A-Z are lowered before the look-up, but for texts with combining marks (which could
    compose with another letter) or what may be a special token.
    """

    MOST = 500_000

    def __init__(self, file: bytes, kind: str = "<u4"):
        """kind: the integers in which ids are given, of two or four bytes."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        pack = struct.Struct({"<u2": "<H", "<u4": "<I"}[kind]).pack
        self.bytes_of = [pack(i) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        # Words go to the model directly only where that is seen to give the same.
        self.word = self._word if all(self._word(w.encode().decode("latin-1").translate(_NAMES)) == self.whole(w) for w in ("probe", "naïveté", "æther", "слово", "a")) else None
        self.known = Words(self, {})

    def _word(self, word: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.model.tokenize(word)])

    def ends_in_letter(self, text: str) -> bool:
        """Whether the text does once it is normalised: a capital I with a dot becomes a letter and a combining mark, which the
        splitter joins with the punctuation behind it."""
        last = text[-1:]
        if last.isalpha() and len(last.lower()) == 1 and is_normalized("NFC", last):
            return True  # stays a letter, whatever stands before it
        normal = self.tokenizer.normalizer
        return (text if normal is None else normal.normalize_str(text))[-1:].isalpha()

    def whole(self, text: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers."""
        out = []
        for t in texts:
            if len(self.known) > self.MOST:
                self.known = Words(self, dict(self.known))
            raw = t.encode("utf-8", "replace")
            parts = (raw if b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw else raw.translate(_LOWER)).split()
            out.append(b"".join(map(self.known.__getitem__, parts)))
        return out


@lru_cache(maxsize=2)
def _encoder(digest: bytes, file: bytes, kind: str) -> Encoder:
    return Encoder(file, kind)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def id_kind(vocabulary: str, end_id: int | None) -> str:
    """Two bytes where they hold every id, else four."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id or 0, *Tokenizer.from_file(vocabulary).get_vocab().values()) < 1 << 16 else "<u4"


def tokenise(docs: DataFrame, vocabulary: str, end_id: int | None = END_ID, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids as little-endian unsigned integers of a kind), the end id appended to each document."""
    file = docs.sparkSession.sparkContext.broadcast(local_file(vocabulary))
    end = b"" if end_id is None else end_id.to_bytes(int(kind[2]), "little")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data = file.value
        encoder = _encoder(hashlib.sha256(data).digest(), data, kind)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x + end for x in ids], pa.binary())], schema=_TOKENS)

    small_batches(docs.sparkSession)
    return columns_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, kind: str = "<u4") -> DataFrame:
    """(id, n) over the whole corpus; each task sends one row per id that it saw."""

    def rows(it):
        total = np.zeros(0, np.int64)
        for (ids,) in it:
            c = np.bincount(np.frombuffer(ids, kind), minlength=len(total))
            if len(c) > len(total):
                total = np.pad(total, (0, len(c) - len(total)))
            total += c
        for i in np.flatnonzero(total).tolist():
            yield i, int(total[i])

    return map_rows(tokens.select("ids"), rows, "id long, n long", pa.schema([("id", pa.int64()), ("n", pa.int64())])).groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK_DDL = "part int, block int, n long, before long, doc_ids array<long>, sizes array<int>, checkpoints array<long>, bits binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("checkpoints", pa.list_(pa.int64())), ("bits", pa.binary())])


def write_ids(tokens: DataFrame, path: str, kind: str = "<u4") -> None:
    """Writes (doc_id, ids), a table that is cheap to read twice, in the module's format."""
    spark = tokens.sparkSession
    # At most a vocabulary's rows reach the driver.
    counts = sorted((r.id, r.n) for r in id_counts(tokens, kind).collect())
    lengths = np.zeros(counts[-1][0] + 1 if counts else 1, np.uint8)
    lengths[[i for i, _ in counts]] = package_merge([n for _, n in counts], max(MAX_BITS, (len(counts) - 1).bit_length()))
    spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in counts], pa.int64()), "bits": pa.array(lengths[[i for i, _ in counts]].tolist(), pa.int32())}).to_pandas(), "id long, bits int").coalesce(1).write.parquet(f"{path}/lengths")
    shared = spark.sparkContext.broadcast(lengths)

    def rows(it):
        code = Code(shared.value)
        docs, sizes, ids, n, block, before, part = [], [], [], 0, 0, 0, 0

        def done():
            bits, checkpoints = code.encode(np.concatenate(ids).astype(np.int64))
            return part, block, n, before, docs, sizes, checkpoints.tolist(), bits

        for part, doc_id, raw in it:
            x = np.frombuffer(raw, kind)
            docs.append(doc_id)
            sizes.append(len(x))
            ids.append(x)
            n += len(x)
            if n >= BLOCK_IDS:
                yield done()
                docs, sizes, ids, block, before, n = [], [], [], block + 1, before + n, 0
        if docs and n:
            yield done()

    ordered = tokens.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids")
    numbered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids")
    one_at_a_time(numbered, rows).write.parquet(f"{path}/blocks")


def one_at_a_time(df: DataFrame, fn) -> DataFrame:
    """Blocks leave a task one at a time, so only one is held."""

    def run(batches):
        yield from in_batches(fn(row_stream(batches)), _BLOCK_ARROW, 1)

    return df.mapInArrow(run, _BLOCK_DDL)


_READ_DDL = "part int, doc_id long, before long, ids binary"
_READ_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files: start counts the ids of all documents before it."""
    lengths = np.zeros(1, np.uint8)
    for r in sorted(spark.read.parquet(f"{path}/lengths").collect(), reverse=True):
        if r.id >= len(lengths):
            lengths = np.pad(lengths, (0, r.id + 1 - len(lengths)))
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(_BLOCK_DDL).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # a row per file
    offsets = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))

    def rows(it):
        code = Code(shared.value)
        for part, before, n, docs, sizes, checkpoints, bits in it:
            ids = code.decode(bits, np.array(checkpoints, np.int64), n).astype("<u4")
            at = 0
            for doc_id, size in zip(docs, sizes):
                yield part, doc_id, before + at, ids[at : at + size].tobytes()
                at += size

    found = map_rows(blocks.select("part", "before", "n", "doc_ids", "sizes", "checkpoints", "bits"), rows, _READ_DDL, _READ_ARROW)
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def store(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = END_ID) -> None:
    kind = id_kind(vocabulary, end_id)
    write_ids(written(tokenise(docs, vocabulary, end_id, kind), "ids"), path, kind)


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
