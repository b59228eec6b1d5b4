"""Merkle manifest of a dataset by nested-interval labels.

Each row is a leaf; the leaves of one language, in order of doc_id, have the ranks 0, 1, ... A node covers the leaf ranks
[start, stop), so a node of level l of a tree with fan-out f starts at a multiple of f^l, and an ancestor is a node whose
interval contains that of its descendant. Levels are built bottom up: nodes that fall into one bucket of f^(l+1) ranks are a
run and become their hash. Top down, children are joined to the runs of the next level by containment: start div f^(l+1) is
the bucket that both sides share, so the join has at most f children a run, whatever a language's share of the rows. What the
run's interval holds beside the child's own are its siblings, to the left and to the right; with the path of the run before
them they are the child's proof. So each level costs one join of narrow rows, and only the last one has the size of the table.

The ranks come from a range partitioning (of language, doc_id and leaf) that is written once: a row's rank is its place in its
partition and the rows of its language in the partitions before. No task holds a language, and all work is in DataFrame
functions.

Cases: null values are hashed as such, a null lang is a tree of its own, ahead of all others; rows of one doc_id are in the
order of their leaves, null ids come first; equal rows are leaves of their own; empty texts and texts of any length are
hashed whole; an empty table has no leaves and a null root; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sievework.llm.common import checkpointed, columns_only, lookup, written

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(**changed: Column) -> Column:
    """Hex SHA-256 of the fields, each `-` if null, else its length in bytes, `:` and itself."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*(field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


@dataclass
class Tree:
    """Nodes (tree, start, stop, digest, n, ...) of level 0 and the runs of each level above: (tree, start, stop, digest, n,
    members), members being the nodes of the level below. n: leaves of the tree."""

    leaves: DataFrame
    runs: list[DataFrame]
    fan: int

    def tops(self) -> DataFrame:
        """(tree, digest): what remains of each tree."""
        out = self.leaves.where("n = 1").select("tree", "digest")
        for level, runs in enumerate(self.runs, 1):
            out = out.unionByName(runs.where(F.col("n") <= self.fan**level).select("tree", "digest"))
        return out


@dataclass
class Manifest:
    trees: Tree
    top: Tree
    root: str | None


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with start (rank by `order` within tree), stop, and n (rows of the tree); written. The last resort of the order is
    a row's place in the input, so that equal rows are dealt to several tasks as well."""
    by = [*(F.col(c).asc_nulls_first() for c in ("tree", *order)), F.col("_place")]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_place")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)  # partition * 2^33 + place
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    counts = dealt.groupBy("_part", "tree").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    tree = W.partitionBy("tree")  # a row per partition at most
    before = F.coalesce(F.sum("_rows").over(tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = checkpointed(counts.select("_part", "tree", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(tree).alias("n")))
    out = lookup(dealt, offsets, ["_part", "tree"], "inner").withColumn("start", F.col("_at") + F.col("_shift"))
    return out.withColumn("stop", F.col("start") + 1).drop("_at", "_part", "_shift")


def _bucket(start: str, width: int) -> Column:
    return F.expr(f"{start} div {width}L")


def _grown(leaves: DataFrame, fan: int) -> Tree:
    largest = leaves.agg(F.max("n")).first()[0] or 0
    runs, below, width = [], leaves, 1
    while width < largest:
        # Only trees with several nodes at this level go on.
        members = F.array_sort(F.collect_list(F.struct("start", "stop", "digest")))
        wider = width * fan
        runs_of = below.where(F.col("n") > width).groupBy("tree", "n", _bucket("start", wider).alias("bucket")).agg(members.alias("members"))
        here = runs_of.select(
            "tree", F.col("members")[0]["start"].alias("start"), F.element_at("members", -1)["stop"].alias("stop"),
            F.sha2(F.array_join(F.col("members.digest"), ""), 256).alias("digest"), "n", "members",
        )
        below, width = written(here, "merkle"), wider
        runs.append(below)
    return Tree(leaves, runs, fan)


def build(docs: DataFrame, fan: int = FAN, also: dict[str, Column] | None = None) -> Manifest:
    """The trees of all languages and the tree of their subroots. `also`: expressions over the fields that leaves carry along."""
    rows = columns_only(docs, *FIELDS)
    # Null, then all others in the order of their bytes.
    tree = F.when(F.col("lang").isNull(), "-").otherwise(F.concat(F.lit(":"), F.col("lang").cast("string")))
    leaves = rows.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), *(c.alias(n) for n, c in (also or {}).items()))
    trees = _grown(_numbered(leaves, ["doc_id", "digest"], "leaves"), fan)
    tops = trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = _grown(_numbered(tops, ["name"], "subroots"), fan)
    root = top.tops().first()
    return Manifest(trees, top, root and root["digest"])


def labels(m: Manifest) -> DataFrame:
    """All nodes of the languages' trees: (tree, level, start, stop, digest)."""
    out = m.trees.leaves.select("tree", F.lit(0).alias("level"), "start", "stop", "digest")
    for level, runs in enumerate(m.trees.runs, 1):
        out = out.unionByName(runs.select("tree", F.lit(level).alias("level"), "start", "stop", "digest"))
    return out


_STEP = "struct<before:string,after:string>"


def _attached(children: DataFrame, parents: DataFrame, width: int, more: list[str]) -> DataFrame:
    """children with `path`: the siblings in the run that contains them, then the run's own path; and the columns `more` of the run."""
    right = parents.select(
        F.col("tree").alias("p_tree"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), "members", F.col("path").alias("p_path"), *more,
        _bucket("start", width).alias("p_bucket"),
    )
    inside = (F.col("p_start") <= F.col("start")) & (F.col("stop") <= F.col("p_stop"))
    met = children.withColumn("bucket", _bucket("start", width)).join(right, (F.col("tree") == F.col("p_tree")) & (F.col("bucket") == F.col("p_bucket")) & inside)
    digests = lambda keep: F.array_join(F.transform(F.filter("members", keep), lambda x: x["digest"]), "")
    step = F.struct(digests(lambda x: x["stop"] <= F.col("start")).alias("before"), digests(lambda x: x["start"] >= F.col("stop")).alias("after"))
    return met.withColumn("path", F.concat(F.array(step), "p_path")).drop("p_tree", "p_start", "p_stop", "p_path", "p_bucket", "bucket")


def _paths(tree: Tree, roots: DataFrame, more: list[str]) -> DataFrame:
    """The leaves of a tree with their path. roots: (tree, path, *more), what lies above each tree's own top."""

    def topmost(nodes: DataFrame, width: int) -> DataFrame:
        return lookup(nodes.where(F.col("n") <= width), roots, ["tree"], "inner")

    above = None
    for level in range(len(tree.runs), 0, -1):
        runs, width = tree.runs[level - 1], tree.fan**level
        here = topmost(runs, width)
        if above is not None:
            inner = _attached(runs.where(F.col("n") > width).withColumnRenamed("members", "own"), above, width * tree.fan, more).drop("members")
            here = here.unionByName(inner.withColumnRenamed("own", "members"))
        above = checkpointed(here) if level > 1 else here
    alone = topmost(tree.leaves, 1)
    if above is None:
        return alone
    return alone.unionByName(_attached(tree.leaves.where("n > 1"), above, tree.fan, more).drop("members"))


def proofs(m: Manifest) -> DataFrame:
    """The leaves, with path (per level up to the root the digests left and right of the own one, joined), subroot and root."""
    top_roots = checkpointed(m.top.leaves.limit(1).select(F.lit("").alias("tree"), F.expr(f"cast(array() as array<{_STEP}>)").alias("path")))
    subroots = _paths(m.top, top_roots, []).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"))
    return _paths(m.trees, checkpointed(subroots), ["subroot"]).withColumn("root", F.lit(m.root).cast("string"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def tampered_text() -> Column:
    """text with A-Z lower-cased where 3 divides the CRC-32 of doc_id; the text itself elsewhere."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs, its proof checked against a copy of the table in which a third of the texts were altered."""
    found = proofs(build(docs, also={"again": leaf_digest(text=tampered_text())}))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.col("again"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
