"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a random vector of r + 1 bits; for each non-zero vector v of r + 1 bits the mask of v holds the
positions whose vector has an odd inner product with v (Pagh, 2016). Two fingerprints that differ in at most r bits agree
under at least one of the 2^(r+1) - 1 masks, always: the r differing positions span at most r dimensions, so some v is
orthogonal to all of them. A mask with its bits of a fingerprint is a bucket.

All work is on distinct fingerprints, so copies cost one row. Buckets with one member go at once. A bucket with more than
`most` members is split without losing a pair: its free bits are cut into r + 1 blocks, one of which must agree, so each
block added to the mask gives a finer bucket; this repeats until buckets are small or all members are within r bits of
each other anyway. Within a bucket, a task finds the connected parts and returns a tree of links for each (as a heap, so no
node has many links), never all pairs. Components are found by `common.connected_components`.

Cases: null and empty texts and texts of white space only have fingerprint zero and are linked like any other; repeated
rows each get a result; a null doc_id gets its component, but names none unless a whole component has no id; extra columns
are ignored, or kept by `keep_one`; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import BROADCAST_ROWS, checkpointed, columns_only, connected_components, drop_listed, lookup, map_rows, text_key, together, written

RADIUS = 3
#: Members of a bucket that one task compares with each other.
MOST = 2048
#: Fingerprints, texts and shingles of a block in `keep_one`; a task compares two blocks at most.
BLOCK_PRINTS, BLOCK_TEXTS, BLOCK_SHINGLES = 1 << 14, 1024, 1_000_000
#: Values of a part whose pairs are verified one by one.
SMALL_PART = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (x >> 63 << 64)


@lru_cache(maxsize=None)
def masks(radius: int, seed: int = 1) -> tuple[int, ...]:
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    return tuple(sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1)))


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False, seed: int = 42) -> int:
    """The 64-bit SimHash of the XXH64 values of all shingles, repeats included, or of the distinct ones."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if shingle > 1 else words
    if distinct:
        pieces = set(pieces)
    h = np.array([xxhash.xxh64_intdigest(p, seed) for p in pieces], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False) -> DataFrame:
    rows = columns_only(docs, "doc_id", "text").select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])
    return map_rows(rows, lambda it: ((i, key, signed(fingerprint(t, shingle, distinct))) for i, key, t in it), "doc_id long, text_key long, fp long", schema)


def parts_within(members: np.ndarray, radius: int) -> list[np.ndarray]:
    """The connected parts, of two members and more, of a graph that links values at most `radius` bits apart."""
    rest, out = members, []
    while len(rest) > 1:
        front, rest, part = [rest[0]], rest[1:], [rest[:1]]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                new = rest[near]
                part.append(new)
                front.extend(new)
                rest = rest[~near]
        if len(part) > 1:
            out.append(np.concatenate(part))
    return out


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    """(mask, key, fp), whole buckets together and in order, to links (a, b)."""

    def links(members: list[int]):
        for part in parts_within(np.unique(np.array(members, np.int64).view(np.uint64)), radius):
            part = part.view(np.int64).tolist()
            yield from ((part[(i - 1) // 2], part[i]) for i in range(1, len(part)))

    def run(it):
        bucket, members = None, []
        for mask, key, fp in it:
            if (mask, key) != bucket:
                if len(members) > 1:
                    yield from links(members)
                bucket, members = (mask, key), []
            members.append(fp)
        if len(members) > 1:
            yield from links(members)

    return map_rows(rows, run, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _blocks(mask: int, n: int) -> list[int]:
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k::n]) for k in range(n)]


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect exactly the values `fp` of `distinct` which chains of at most `radius` bits connect."""
    spark = distinct.sparkSession
    table = masks(radius)
    rows = distinct.select(F.explode(F.array(*(F.lit(signed(m)) for m in table))).alias("mask"), "fp").withColumn("key", F.expr("mask & fp"))
    out = None
    while True:
        sizes = checkpointed(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"))
        wide = F.bit_count(F.bitwise_not("mask")) > radius
        # Up to `most` members a task compares all; if at most `radius` bits are free, all members are links of one another.
        shared = rows.join(sizes, ["mask", "key"])
        small = shared.where((F.col("n") <= most) & wide).select("mask", "key", "fp")
        found = _bucket_links(together(small, ["mask", "key"]), radius)
        star = shared.where(~wide).groupBy("mask", "key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
        out = found if out is None else out.unionByName(found)
        large = checkpointed(sizes.where((F.col("n") > most) & wide).select("mask", "key"))
        heads = large.select("mask").distinct().collect()  # masks, not data: at most (radius + 1) times as many as before
        if any(bin(signed(m) & ALL).count("1") >= 64 - radius for m in table):
            out = out.unionByName(star)
        if not heads:
            return checkpointed(out.distinct())
        finer = spark.createDataFrame([(r.mask, [signed(x) for x in _blocks(r.mask & ALL, radius + 1)]) for r in heads], "mask long, finer array<long>")
        members = rows.join(large, ["mask", "key"], "left_semi").join(F.broadcast(finer), "mask")
        rows = checkpointed(members.select(F.explode("finer").alias("mask"), "fp").withColumn("key", F.expr("mask & fp")).distinct())
        table = tuple(x & ALL for r in heads for x in _blocks(r.mask & ALL, radius + 1))


def components(prints: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(doc_id, fp, ...), written, with component_id: the smallest doc_id that links of at most `radius` bits reach."""
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(links(distinct.select("fp"), radius, most))
    named = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"), F.col("component").isNotNull().alias("linked"))
    named = checkpointed(named)
    # Only linked fingerprints need a minimum over their component.
    low = named.where("linked").groupBy("root").agg(F.min("least").alias("low"))
    ids = named.where("linked").join(low, "root").select("fp", F.col("low").alias("component_id")).unionByName(named.where("not linked").select("fp", F.col("least").alias("component_id")))
    return prints.join(ids, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, fp (signed), fingerprint (hex), component_id."""
    prints = written(fingerprints(docs, shingle), "simhash")
    return components(prints, radius).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def _shingle_sets(texts: DataFrame, shingle: int, print_shingle: int) -> DataFrame:
    """(node, text) to (node, shingles, n, other): the distinct XXH64 values of a text's shingles, their number, and a second
    fingerprint, whose hashes have nothing to do with those of the first."""

    def rows(it):
        for node, text in it:
            words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
            found = sorted({signed(xxhash.xxh64_intdigest(p, 42)) for p in parts})
            yield node, found, len(found), signed(fingerprint(text, print_shingle, True, 7))

    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64())), ("n", pa.int64()), ("other", pa.int64())])
    return map_rows(texts, rows, "node long, shingles array<long>, n long, other long", schema)


def _meeting(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """Deals the `parts` blocks of each key by a hash of `by`; each two blocks i <= j of a key meet as (key, i, j), in order.
    A pair of rows of one key meets at least once, and no task holds more than two blocks, however large the key is."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(by), "parts"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    met = dealt.withColumn("at", F.explode(meet)).select(*key, "at.i", "at.j", *(c for c in dealt.columns if c not in (*key, "parts")))
    return met.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")


def close_links(distinct: DataFrame, radius: int, block: int = BLOCK_PRINTS, small: int = SMALL_PART) -> DataFrame:
    """(fp, many) to links (a, b, large). A bucket's values that chains of at most `radius` bits connect are a part. Parts of up to
    `small` values, none of them `many`, give all their pairs, to be verified one by one; others a tree of links.

    Nearly all buckets have one member or two; a bucket's smallest and largest member tell both, so these need no second look.
    Each two blocks of a bucket of more than `block` members meet: rows grow with members / `block`, where a split by `radius` + 1
    blocks of bits would multiply those of close fingerprints at each level."""
    # Each value becomes a row per mask: enough tasks that none holds too many. A bucket's name is a hash of its mask and bits: two
    # of one name are one bucket, which adds members that `radius` tells apart, and rows are narrower.
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    names = F.array(*(F.xxhash64(F.lit(signed(m)), F.col("fp").bitwiseAND(F.lit(signed(m)))) for m in masks(radius)))
    rows = dealt.select(F.explode(names).alias("bucket"), "fp", "many")
    sizes = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1 and a <> b"))
    two = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b").distinct()
    marked = checkpointed(distinct.where("many").select("fp"))
    twice = [marked.select(F.col("fp").alias(side), F.lit(True).alias(f"many_{side}")) for side in ("a", "b")]
    large = F.coalesce("many_a", F.lit(False)) | F.coalesce("many_b", F.lit(False))
    two = lookup(lookup(two, twice[0], ["a"]), twice[1], ["b"]).select("a", "b", large.alias("large"))
    parts = sizes.where("n > 2").select("bucket", F.ceil(F.col("n") / block).alias("parts"))
    met = _meeting(lookup(rows, parts, ["bucket"], "inner", 300_000), ["bucket"], "fp")

    def run(it):
        for _, whole in groupby(it, key=lambda r: r[:3]):
            whole = list(whole)
            many = {r[3] for r in whole if r[4]}
            for part in parts_within(np.unique(np.array([r[3] for r in whole], np.int64).view(np.uint64)), radius):
                part = part.view(np.int64).tolist()
                if len(part) <= small and many.isdisjoint(part):
                    yield from ((min(a, b), max(a, b), False) for i, a in enumerate(part) for b in part[:i])
                else:
                    yield from ((part[(i - 1) // 2], part[i], True) for i in range(1, len(part)))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("large", pa.bool_())])
    others = map_rows(met.select("bucket", "i", "j", "fp", "many"), run, "a long, b long, large boolean", schema)
    return checkpointed(two.unionByName(others).distinct())


#: Links that one look at a partition holds; a task reads about so many.
FOREST = 100_000


def forest(links: DataFrame, most: int = FOREST) -> DataFrame:
    """Links (a, b) that connect the same nodes as the given ones, a table that is cheap to read twice: of each stretch of `most`
    links a star per connected part. Few large stretches leave few links: a family's masks and blocks give each member many."""

    def tree(stretch: list[tuple[int, int]]):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for a, b in stretch:
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        yield from ((root(x), x) for x in up)

    def run(it):
        stretch: list[tuple[int, int]] = []
        for link in it:
            stretch.append(link)
            if len(stretch) == most:
                yield from tree(stretch)
                stretch = []
        yield from tree(stretch)

    tasks = max(1, math.ceil(links.count() / most))
    near = links.select("a", "b").repartition("a").sortWithinPartitions("a", "b").coalesce(tasks)
    return map_rows(near, run, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _candidates(texts: DataFrame, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(node, text_key, fp), one row per text, to pairs of nodes (a, b) and groups (node, grp).

    Nearly all candidates are pairs. Only what a single bucket shows to be a family of many texts, or one fingerprint of several
    texts, makes a group: chains that unrelated texts form from bucket to bucket don't.
    """
    distinct = checkpointed(texts.groupBy("fp").agg((F.count("*") > 1).alias("many")))
    found = close_links(distinct, radius, block)
    chains = checkpointed(connected_components(forest(found.where("large"))).withColumnsRenamed({"node": "fp", "component": "chain"}))
    alike = checkpointed(distinct.where("many").select("fp", F.col("fp").alias("own")))
    grouped = lookup(lookup(texts, chains, ["fp"]), alike, ["fp"])
    groups = checkpointed(grouped.select("node", F.coalesce("chain", "own").alias("grp")).where("grp is not null"))
    pairs = found.where("not large").select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("fp").alias(side), F.col("node").alias(f"_{side}")), side)
    pairs = checkpointed(pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    # All pairs of a group are compared there.
    for side in ("a", "b"):
        pairs = lookup(pairs, groups.select(F.col("node").alias(side), F.col("grp").alias(f"grp_{side}")), [side])
    return checkpointed(pairs.where("not (grp_a <=> grp_b) or grp_a is null").select("a", "b")), groups


def verified_pairs(pairs: DataFrame, sets: DataFrame, similarity: float, other: int) -> DataFrame:
    """The pairs of nodes (a, b) of `similarity` and more. Their sizes and second fingerprints (at most `other` bits apart) are
    compared first, so sets are joined only for pairs that are likely to be alike."""
    near = pairs
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("other").alias(f"o_{side}")), side)
    near = near.where((F.col("n_a") >= similarity * F.col("n_b")) & (F.col("n_b") >= similarity * F.col("n_a")) & (F.bit_count(F.col("o_a").bitwiseXOR(F.col("o_b"))) <= other))
    near = checkpointed(near.select("a", "b"))
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return near.where(shared >= similarity * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def alike_within(blocks: list[int], sets: list[np.ndarray], similarity: float):
    """Links (i, j) that connect exactly the sets which chains of Jaccard similarity of `similarity` and more connect. With
    two blocks only links from one to the other count. Two such sets share one of the rarest values of each (a prefix filter)."""
    sizes, block = np.array([len(s) for s in sets]), np.array(blocks)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    once = int(np.count_nonzero(often == 1))
    values = [np.sort(x) for x in np.split(rank[code], np.cumsum(sizes)[:-1])]
    # The rarest values come first; those that only one set has lead to no other.
    firsts = [v[: len(v) - math.ceil(similarity * len(v) - 1e-9) + 1] for v in values]
    firsts = [v[v >= once] for v in firsts]
    value, owner = np.concatenate(firsts), np.repeat(np.arange(len(sets)), [len(v) for v in firsts])
    order = np.lexsort((owner, value))
    owner, starts = owner[order], np.searchsorted(value[order], np.arange(len(often) + 1))
    part, mine, cross = np.arange(len(sets)), np.zeros(len(often), bool), block.min() != block.max()
    for i in range(1, len(sets)):
        if not len(firsts[i]):
            continue
        near = np.concatenate([owner[starts[v] : starts[v + 1]] for v in firsts[i]])
        near = near[(near < i) & (part[near] != part[i])]
        near = near[(sizes[near] >= similarity * sizes[i]) & (sizes[i] >= similarity * sizes[near])]
        near = np.unique(near[block[near] != block[i]] if cross else near)
        mine[values[i]] = True
        while len(near):
            j, near = int(near[0]), near[1:]
            shared = int(np.count_nonzero(mine[values[j]]))
            if shared >= similarity * (sizes[i] + sizes[j] - shared):
                yield j, i
                part[part == part[j]] = part[i]
                near = near[part[near] != part[i]]
        mine[values[i]] = False


def verified_links(sets: DataFrame, similarity: float, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(node, grp, shingles) to links (a, b) that connect exactly the nodes of each group which chains of pairs of `similarity`
    and more connect. Large groups are dealt to blocks, and each two blocks meet in a task, which returns a tree of links."""
    count = sets.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.size("shingles")).alias("m"))
    parts = checkpointed(count.select("grp", F.greatest(F.ceil(F.col("n") / block_texts), F.ceil(F.col("m") / block_shingles)).alias("parts")))
    met = _meeting(lookup(sets, parts, ["grp"], "inner"), ["grp"], "node").select("grp", "i", "j", "node", "block", "shingles")

    def run(it):
        for _, whole in groupby(it, key=lambda r: r[:3]):
            nodes, blocks, values = [], [], []
            for *_, node, block, shingles in whole:
                nodes.append(node)
                blocks.append(block)
                values.append(np.array(shingles, np.int64))
            yield from ((nodes[a], nodes[b]) for a, b in alike_within(blocks, values, similarity))

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return map_rows(met, run, "a long, b long", schema)


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 7, print_shingle: int = 1, block: int = BLOCK_PRINTS) -> DataFrame:
    """One document of each group of copies, with all its columns.

    Of equal texts the smallest doc_id stays. Pairs of fingerprints at most `radius` bits apart, and the other pairs of a small part
    of their bucket, are verified one by one: those that share at least `similarity` of their word shingles (Jaccard, exact) are
    links. Where a bucket holds a family of many texts, or one fingerprint is that of several, all pairs of this group are compared
    in blocks. Of each connected component of verified links the smallest doc_id stays. Fingerprints are of the distinct words, not
    of the similarity's shingles: an edited word changes one of them and five of those, so near copies differ in fewer bits, and
    common words don't make unrelated texts alike. A null doc_id comes last.
    """
    number = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    prints = written(fingerprints(docs, print_shingle, distinct=True).withColumn("node", number), "simhash")
    # One node per text, named by its smallest doc_id; texts of one id are told apart by their key.
    first = checkpointed(prints.groupBy("text_key").agg(F.min(F.struct("node", "fp")).alias("m")).select("text_key", F.col("m.node").alias("node"), F.col("m.fp").alias("fp")))
    texts = checkpointed(first.groupBy("node").agg(F.min(F.struct("text_key", "fp")).alias("m")).select("node", "m.text_key", "m.fp"))
    pairs, groups = _candidates(texts, radius, block)
    both = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node")).distinct()
    wanted = checkpointed(both.join(texts, "node").select("node", F.col("text_key").alias("_key")))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.select(number.alias("node"), text_key(F.col("text")).alias("_key"), "text")
    bodies = keyed.join(F.broadcast(wanted) if few else wanted, ["node", "_key"], "left_semi")
    sets = written(_shingle_sets(bodies.select("node", "text"), shingle, print_shingle).dropDuplicates(["node"]), "shingles")
    of_groups = verified_links(lookup(sets.select("node", "shingles"), groups, ["node"], "inner").select("node", "grp", "shingles"), similarity)
    verified = checkpointed(verified_pairs(pairs, sets, similarity, 2 * radius).unionByName(of_groups))
    linked = connected_components(forest(verified))
    gone = checkpointed(linked.where("node <> component").join(texts, "node").select("text_key"))
    # Rows are looked up by id and text, so one text's copies don't meet in one task.
    keepers = first.join(gone, "text_key", "left_anti").select("node", "text_key")
    listed = prints.join(keepers, ["node", "text_key"], "left_anti").select("doc_id", "text_key")
    kept = drop_listed(docs, listed)
    again = checkpointed(prints.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]), "left_semi")
    once = kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]), "left_anti")
    return once.unionByName(twice.dropDuplicates(["doc_id", "text"]))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "fingerprint", "component_id")
