"""Pivot codes, repeated passages and the Merkle manifest against brute force, with the cases their docstrings define."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sievework.llm")

from sievework.llm import merkle_manifest, pivot_codes, substring_rlz  # noqa: E402


def with_more(df, *names):
    """The same rows with further columns, whose names clash in case or with names that operators use."""
    return df.select("*", *(F.lit("x").alias(n) for n in names))


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 11 pivot codes

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + rng.normal(size=8) * 0.3).astype(np.float32).tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    rows += [(1000, rows[5][1], 1), (1001, rows[5][1], None), (5, rows[5][1], 2)]  # copies and a repeated id
    bad = [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 7, 1), (2003, [1.0] * 12, 1), (2004, [None, *rows[0][1][1:]], 1), (2005, [float("nan"), *rows[0][1][1:]], 1), (2006, [float("-inf"), *rows[0][1][1:]], 1)]
    return rows, bad


def brute_codes(rows, entries=256):
    ok = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(np.array([r[1] for r in ok], np.float64) * 1024).astype(np.int64).reshape(len(ok), 4, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for again in range(5):
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        codes, squares = d.argmin(2), d.min(2)
        for p in range(4 if again < 4 else 0):
            for e in range(books.shape[1]):
                if (codes[:, p] == e).any():
                    books[p, e] = x[codes[:, p] == e, p].sum(0) // (codes[:, p] == e).sum()
    error = squares.sum(1).tolist()
    by = collections.Counter()
    for r, e in zip(ok, error):
        by[r[2]] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in cs), e, by[r[2]], digest) for r, cs, e in zip(ok, codes.tolist(), error)), key=str)


def test_codes(spark):
    rows, bad = vectors()
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(3)
    assert table(pivot_codes.digest(with_more(df, "LABEL", "VEC_ID", "code"))) == brute_codes(rows)


def test_codes_of_few_vectors_and_none(spark):
    rows = vectors(12)[0][:9]
    assert table(pivot_codes.digest(spark.createDataFrame(rows, VECTORS))) == brute_codes(rows)
    assert pivot_codes.digest(spark.createDataFrame([], VECTORS)).count() == 0
    far = [(0, [1e30] * 8, 1), (1, [-1e30] * 8, 1), (None, [0.0] * 8, None)]
    got = {r.vec_id: r.error for r in pivot_codes.digest(spark.createDataFrame(far, VECTORS)).collect()}
    assert got == {0: 0, 1: 0, None: 0}


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_no_entry(seed):
    """Small integers make many ties; the search with pivots must agree with the full table, and evaluate less of it."""
    rng = np.random.default_rng(seed)
    part, entries = rng.integers(-3, 4, (300, 6)) * (1 + 99 * (seed % 2)), rng.integers(-3, 4, (64, 6)) * (1 + 99 * (seed % 2))
    entries[10] = entries[3]
    pivots = pivot_codes.choose_pivots(entries, 5)
    count = [0]
    got = pivot_codes.nearest(part, pivot_codes.roots(pivot_codes.squared(part, pivots)), entries, pivot_codes.roots(pivot_codes.squared(entries, pivots)), count)
    d = ((part[:, None] - entries[None]) ** 2).sum(-1)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()
    assert seed % 2 == 0 or count[0] < d.size
    squares = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 31) ** 2 - 1, (1 << 31) ** 2])
    assert pivot_codes.roots(squares).tolist() == [0, 1, 1, 1, 2, 2, 3, (1 << 31) - 1, 1 << 31]


# 12 repeated passages


def brute_repeats(rows):
    last = 1 << 63
    known = [(last if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for n, _, w in known:
        for k in range(len(w) - 12):
            low[tuple(w[k : k + 13])] = min(n, low.get(tuple(w[k : k + 13]), last))
    out = []
    for n, i, w in known:
        gone = {k + o for k in range(len(w) - 12) if low[tuple(w[k : k + 13])] < n for o in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def texts(seed=2):
    rng = random.Random(seed)
    words = lambda n, some: " ".join(rng.choice(some) for _ in range(n))
    many = [f"w{k}é" for k in range(400)]
    passages = [words(n, many) for n in (13, 14, 25, 60)]
    rows = [(i, words(rng.randrange(0, 80), many if i % 3 else "ab")) for i in range(120)]
    rows += [(200 + i, words(rng.randrange(0, 9), many) + " \t\n" + rng.choice(passages) + "\x0b " + words(rng.randrange(0, 9), many) + "\x1f") for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(30)] + [(rng.randrange(400), rows[k][1]) for k in range(10)]
    rows += [(None, passages[2]), (None, passages[2] + " x"), (500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (503, "again " * 3000)]
    return rows


@pytest.mark.parametrize(("most", "bits"), [(2048, 27), (2, 12)])
def test_repeats(spark, most, bits):
    """Also with blocks that are cut at once and a bit map that lets most through: both must not change a row."""
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = with_more(df, "words", "Number", "TEXT", "windows")
    assert table(substring_rlz.digest(substring_rlz.remove_repeats(more, most, bits))) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert substring_rlz.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_and_kept_text(spark):
    a = " ".join(f"a{k}" for k in range(20))
    got = {r.doc_id: r for r in substring_rlz.remove_repeats(spark.createDataFrame([(1, a), (2, f"x {a} y"), (3, f"{a} {a}")], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 21)] and got[2].kept == "x y"
    assert got[1].n_removed == 0 and [tuple(s) for s in got[3].spans] == [(0, 40)] and got[3].kept == ""


@pytest.mark.parametrize("seed", range(6))
def test_factors_are_all_that_the_reference_holds(seed):
    rng = random.Random(seed)
    held = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    reference = substring_rlz.Reference()
    for h in held:
        reference.add(h)
    text = [rng.choice("abcd") for _ in range(200)]
    inside = lambda w: any(h[k : k + len(w)] == w for h in held for k in range(len(h)))
    for least in (1, 3, 5):
        covered = {k for s, e in reference.factors(text, least) for k in range(s, e - least + 1)}
        assert covered == {k for k in range(len(text) - least + 1) if inside(text[k : k + least])}
        assert all(inside(text[s:e]) for s, e in reference.factors(text, least))


# 13 Merkle manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hashed(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: hashed(*map(field, (r[0], r[3], r[2], r[4], t)))

    def tree(digests):
        level, path = [(d, [k]) for k, d in enumerate(digests)], [[] for _ in digests]
        while len(level) > 1:
            runs = [level[a : a + 8] for a in range(0, len(level), 8)]
            for run in runs:
                for j, (_, under) in enumerate(run):
                    for k in under:
                        path[k].append(([d for d, _ in run[:j]], [d for d, _ in run[j + 1 :]]))
            level = [(hashed(*(d for d, _ in run)), [k for _, under in run for k in under]) for run in runs]
        return level[0][0], path

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, above = tree([m[1] for m in made]) if made else (None, [])
    out = []
    for (own, subroot, paths), top in zip(made, above):
        for r, path in zip(own, paths):
            t = r[1]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            folded = leaf(r, t)
            for before, after in path + top:
                folded = hashed(*before, folded, *after)
            out.append((r[0], leaf(r, r[1]), subroot, root, hashed(*(d for b, a in path + top for d in b + a)), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(sizes):
    rng = random.Random(3)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randrange(10_000), rng.choice(["Aé", "b", "", None, "Long " * 500]), lang, rng.choice(["s", None, ""]), rng.choice([None, 3])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [{"en": 600, None: 9, "": 1, "é": 8, "z": 65}, {"en": 1}, {"en": 8}, {"en": 9}, {f"l{k}": 1 + k % 3 for k in range(70)}, {None: 3}])
def test_manifest(spark, sizes):
    rows = manifest_rows(sizes)
    rows += [rows[0], (None, *rows[0][1:]), (None, "Other", *rows[0][2:])] if len(rows) > 100 else []
    df = with_more(spark.createDataFrame(rows, DOCS).repartition(3), "LANG", "tree", "n", "digest", "path")
    assert table(merkle_manifest.digest(df)) == brute_manifest(rows)


def test_manifest_of_nothing_and_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle_manifest.digest(empty).count() == 0 and merkle_manifest.build(empty).root is None
    nodes = merkle_manifest.labels(merkle_manifest.build(spark.createDataFrame(manifest_rows({"en": 70}), DOCS))).collect()
    assert sorted((r.level, r.start, r.stop) for r in nodes if r.level) == [*((1, 8 * k, min(70, 8 * k + 8)) for k in range(9)), (2, 0, 64), (2, 64, 70), (3, 0, 70)]
