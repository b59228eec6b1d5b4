"""Vector codes by integer k-means per part, with assignment by LAESA pivots.

Vectors become integers, are cut into equal parts, and each part position has a codebook of its own. The distances of every
part to a few fixed pivots of its position are computed once and written with the vector (Mico, Oncina and Vidal, 1994). In a
round the driver's small codebooks are compared with the same pivots: by the triangle inequality, |d(part, pivot) -
d(entry, pivot)| is a lower bound of d(part, entry) for each pivot. A part takes its entries in the order of their bounds,
evaluates them exactly in integers, and stops where the next bound exceeds the best distance so far. Distances are kept as
their integer square roots, so a bound is one less than the difference of these, never too large.

A round is one pass over the written table: a task sums the parts per entry as it assigns them, so what it sends on has at
most a row per entry of the codebooks; these sums are added in Spark, and the driver gets a row per entry. Codebooks and
pivots are some tens of KB whatever the table's size.

Cases: vectors that are null, empty, hold a null or non-finite component or can't be cut into equal parts are dropped, as are
those of another length than the vector of the smallest vec_id; components are held to +-2^27 after scaling (where they lie
beyond 131072), so that all distances fit 64 bits; null ids come last; rows of one vec_id are in the order of their values and
each get a code; with fewer vectors than entries the codebook is as small; entries that no part chooses stay; equal labels
share a sum, nulls too; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import checkpointed, columns_only, lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Fixed pivots of each part position.
PIVOTS = 8
#: Vectors assigned at once, and entries that each evaluates before it looks at its bounds again.
AT_ONCE, STEP = 1024, 8
LARGEST = 1 << 27


def roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) * (r + 1) <= squares
    return r


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, one after another; both are small."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def choose_pivots(part: np.ndarray, n: int) -> np.ndarray:
    """n rows that lie far apart: the first, then always the one farthest from those taken."""
    taken = [0]
    far = ((part - part[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(part)):
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((part - part[taken[-1]]) ** 2).sum(axis=1))
    return part[taken]


def nearest(part: np.ndarray, near: np.ndarray, entries: np.ndarray, entry_near: np.ndarray, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each part's nearest entry (ties to the lower index) and squared distance. near, entry_near: distances to the pivots,
    rounded down. count: adds up the exact evaluations."""
    bound = np.zeros((len(part), len(entries)), np.int64)
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p, None] - entry_near[None, :, p]) - 1, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    bound *= bound
    best, index, rows = np.full(len(part), np.iinfo(np.int64).max), np.zeros(len(part), np.int64), np.arange(len(part))
    for at in range(0, len(entries), STEP):
        # A bound equal to the best may hide a tie, so only larger ones end the search.
        rows = rows[bound[rows, at] <= best[rows]]
        if not len(rows):
            break
        some = order[rows, at : at + STEP]
        d = ((part[rows, None, :] - entries[some]) ** 2).sum(axis=2)
        if count is not None:
            count[0] += some.size
        least = d.min(axis=1)
        first = np.where(d == least[:, None], some, len(entries)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], first[better]
    return index, best


@dataclass
class Codebooks:
    entries: np.ndarray  # part, entry, position
    pivots: np.ndarray  # part, pivot, position

    def pivot_distances(self) -> list[np.ndarray]:
        return [roots(squared(e, p)) for e, p in zip(self.entries, self.pivots)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def valid(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(vec_id, embedding, label) of the vectors that can be cut and hold only finite components."""
    rows = columns_only(vectors, "vec_id", "embedding", "label")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & whole)


def _columns(batch: pa.RecordBatch, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The integers (row, part, position) and pivot distances (row, part, pivot) of a batch of the written table."""
    read = lambda name, *shape: np.frombuffer(b"".join(batch.column(name).to_pylist()), "<i4").reshape(batch.num_rows, *shape).astype(np.int64)
    return read("ints", parts, width // parts), read("near", parts, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def prepare(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """The written table (vec_id, label, ints, near) and the first codebooks: the parts of the `entries` smallest vec_ids."""
    rows = valid(vectors, parts)
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    width = len(first[0].embedding) if first else parts
    rows = rows.where(F.size("embedding") == width)
    label = rows.schema["label"].dataType.simpleString()
    given = rows.schema["vec_id"].dataType.simpleString()
    start = scaled(np.array([r.embedding for r in first if len(r.embedding) == width], np.float64).reshape(-1, width))
    cut = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    fixed = np.stack([choose_pivots(p, pivots) for p in cut]) if len(start) else np.zeros((parts, 0, width // parts), np.int64)

    def run(batches):
        for b in _slices(batches):
            ints = scaled(b.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, parts, -1)
            near = np.stack([roots(squared(ints[:, k], fixed[k])) for k in range(parts)], axis=1)
            blobs = [pa.array([r.tobytes() for r in x.reshape(b.num_rows, -1).astype("<i4")], pa.binary()) for x in (ints, near)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *blobs], names=["vec_id", "label", "ints", "near"])

    table = written(rows.mapInArrow(run, f"vec_id {given}, label {label}, ints binary, near binary"), "vectors")
    return table, Codebooks(cut.copy(), fixed) if len(start) else None


def _assigned(batch: pa.RecordBatch, books: Codebooks, known: list[np.ndarray]):
    """(ints, codes, squared distances) of a batch, parts in the second axis."""
    parts, _, length = books.entries.shape
    ints, near = _columns(batch, parts * length, parts)
    found = [nearest(ints[:, k], near[:, k], books.entries[k], known[k]) for k in range(parts)]
    return ints, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def improve(table: DataFrame, books: Codebooks) -> Codebooks:
    """One round: all parts to their nearest entries, then entries to the floor of the mean of their parts."""
    parts, size, length = books.entries.shape
    known = books.pivot_distances()

    def run(batches):
        sums, count = np.zeros((parts, size, length), np.int64), np.zeros((parts, size), np.int64)
        for b in _slices(batches):
            ints, codes, _ = _assigned(b, books, known)
            for k in range(parts):
                np.add.at(sums[k], codes[:, k], ints[:, k])
                np.add.at(count[k], codes[:, k], 1)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    partial = table.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(length)))
    entries = books.entries.copy()
    for part, entry, n, *s in totals.collect():  # a row per entry
        entries[part, entry] = [int(x) // n for x in s]
    return Codebooks(entries, books.pivots)


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, and the squared distances summed over the parts."""
    known = books.pivot_distances()
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))

    def run(batches):
        for b in _slices(batches):
            _, codes, squares = _assigned(b, books, known)
            code = ["".join(f"{x:0{digits}x}" for x in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(squares.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = {c: table.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return table.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, rounds: int = ROUNDS, **sizes: int) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all valid vectors after `rounds` rounds, and the codebooks."""
    table, books = prepare(vectors, **sizes)
    if books is None:
        return table.selectExpr("vec_id", "label", "cast(null as string) code", "0L error"), None
    for _ in range(rounds):
        books = improve(table, books)
    return encode(table, books), books


def digest(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    codes = written(codes, "codes")
    key = [F.col("label").isNull().alias("_no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    codes = codes.select("vec_id", "code", "error", *key)
    sums = checkpointed(codes.groupBy("_no_label", "_label").agg(F.sum("error").alias("label_error")))
    return lookup(codes, sums, ["_no_label", "_label"]).select("vec_id", "code", "error", "label_error", F.lit(books and books.digest()).cast("string").alias("codebooks_sha256"))
