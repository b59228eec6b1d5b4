"""The pipeline's near-dedup against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("sievework.llm")

from pyspark.sql import functions as F  # noqa: E402

from sievework.llm import simhash_covering  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t, n=5):
    w = t.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def roots(n, linked):
    out = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(j, i) and out[i] != out[j]:
                old, new = max(out[i], out[j]), min(out[i], out[j])
                out = [new if r == old else r for r in out]
    return out


def edited(rng, ws, at):
    ws = list(ws)
    for k in at:
        ws[k] = f"w{rng.randrange(10**6)}"
    return ws


def families(seed):
    """Texts of which two are each like a third one, but not like each other, the third one last; and near copies around them."""
    rng = random.Random(seed)
    bits = lambda a, b: (simhash_covering.fingerprint(" ".join(a)) ^ simhash_covering.fingerprint(" ".join(b))).bit_count()
    texts = []
    for _ in range(4):
        c = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = lambda lo, c=c: next(x for x in iter(lambda: edited(rng, c, range(lo, lo + 80, 20)), None) if bits(x, c) <= 7)
        texts += [near(10), near(100), c]
        texts += [edited(rng, c, rng.sample(range(200), k)) for k in (1, 2, 8, 16)]
    return [" ".join(t) for t in texts]


def kept_by_all_pairs(texts):
    fps, sets = [simhash_covering.fingerprint(t) for t in texts], [shingles(t) for t in texts]
    group = roots(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 7)
    part = roots(len(texts), lambda i, j: group[i] == group[j] and alike(sets[i], sets[j]))
    return {i for i, r in enumerate(part) if r == i}


def test_one_of_each_component_stays(spark):
    texts = families(1)
    sets = [shingles(t) for t in texts[:3]]
    assert alike(sets[0], sets[2]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[1])
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DDL).repartition(3)
    got = {r.doc_id for r in simhash_covering.keep_one(df, radius=7, print_shingle=3).collect()}
    assert 0 in got and not {1, 2} & got
    assert got == kept_by_all_pairs(texts)


def test_large_buckets_lose_no_pair(spark):
    """Where a bucket holds more than a block of fingerprints within the radius, its texts are compared as before."""
    texts = families(2)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DDL)
    assert {r.doc_id for r in simhash_covering.keep_one(df, radius=7, print_shingle=3, block=2).collect()} == kept_by_all_pairs(texts)


@pytest.mark.parametrize("block_texts", [1024, 7])
def test_blocks_of_one_fingerprint_link_exactly(spark, block_texts):
    """Many texts of one fingerprint, the first of them like none: each links to those it is like, whatever the blocks."""
    rng = np.random.default_rng(3)
    centres = [rng.integers(0, 1 << 60, 100) for _ in range(3)]
    sets = [rng.integers(0, 1 << 60, 100)]
    for k in range(80):
        x = centres[k % 3].copy()
        x[rng.choice(100, k % 13, replace=False)] = rng.integers(0, 1 << 60, k % 13)
        sets.append(x[: rng.integers(70, 101)])
    sets.append(sets[0][:85])
    rows = [(i, 0, sorted(map(int, set(s.tolist())))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, grp long, shingles array<long>").repartition(3)
    got = {(r.a, r.b) for r in simhash_covering.verified_links(df, 0.8, block_texts).collect()}
    plain = [set(r[2]) for r in rows]
    assert all(alike(plain[a], plain[b]) for a, b in got)
    assert roots(len(rows), lambda i, j: (i, j) in got or (j, i) in got) == roots(len(rows), lambda i, j: alike(plain[i], plain[j]))


@pytest.mark.parametrize("most", [500_000, 3])
def test_forest_connects_the_same(spark, most):
    rng = random.Random(5)
    links = [(rng.randrange(40), rng.randrange(40, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 110)] * 3
    got = [(r.a, r.b) for r in simhash_covering.forest(spark.createDataFrame(links, "a long, b long"), most).collect()]
    part = lambda pairs: roots(111, lambda i, j: (i, j) in pairs or (j, i) in pairs)
    assert part(set(got)) == part(set(links)) and len(got) < len(links)
    assert simhash_covering.forest(spark.createDataFrame([], "a long, b long")).count() == 0


def test_close_links_are_all_pairs_within_the_radius(spark):
    """Small parts give every pair, in buckets of two and of more; values of several texts and large parts give trees."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 4))) for x in base for _ in range(3)})
    df = spark.createDataFrame([(simhash_covering.signed(x), k % 20 == 0) for k, x in enumerate(values)], "fp long, many boolean")
    found = simhash_covering.close_links(df, 7).collect()
    many = {simhash_covering.signed(x) for k, x in enumerate(values) if k % 20 == 0}
    want = {tuple(sorted((simhash_covering.signed(a), simhash_covering.signed(b)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 7}
    pairs = {(r.a, r.b) for r in found if not r.large}
    assert not any(many & set(p) for p in pairs) and {p for p in want if not many & set(p)} - pairs <= {p for p in want if any(p[0] in (r.a, r.b) or p[1] in (r.a, r.b) for r in found if r.large)}
    n = sorted(df.select("fp").collect())
    at = {r.fp: k for k, r in enumerate(n)}
    every = {(at[r.a], at[r.b]) for r in found}
    assert roots(len(n), lambda i, j: (i, j) in every or (j, i) in every) == roots(len(n), lambda i, j: (n[i].fp, n[j].fp) in want or (n[j].fp, n[i].fp) in want)


def test_a_family_gives_few_links_and_no_pair_twice(spark):
    """All pairs within the radius are pairs or of one group, never both, and a family's links are about as many as its members."""
    rng = random.Random(8)
    centre, other = rng.getrandbits(64), rng.getrandbits(64)
    near = lambda x, most: x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, most)))
    values = sorted({near(centre, 6) for _ in range(250)} | {near(other, 3) for _ in range(3)} | {near(rng.getrandbits(64), 1) for _ in range(30)})
    fps = dict(enumerate(values))
    texts = spark.createDataFrame([(k, 7 * k, simhash_covering.signed(x)) for k, x in fps.items()], "node long, text_key long, fp long").repartition(4)
    found, groups = simhash_covering._candidates(texts, 7, simhash_covering.BLOCK_PRINTS)
    pairs, grp = {tuple(sorted((r.a, r.b))) for r in found.collect()}, {r.node: r.grp for r in groups.collect()}
    assert len(grp) > 200 and not any(a in grp and grp[a] == grp.get(b) for a, b in pairs)
    for b in fps:
        for a in range(b):
            assert (fps[a] ^ fps[b]).bit_count() > 7 or (a, b) in pairs or grp[a] == grp[b]
    large = simhash_covering.close_links(texts.select("fp").withColumn("many", F.lit(False)), 7).where("large")
    assert large.count() > 2 * len(grp) and simhash_covering.forest(large).count() < len(grp)
