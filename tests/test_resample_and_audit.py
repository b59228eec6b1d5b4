"""Bootstraps with weights as columns, draws by class, random subsets, label pairs."""

import itertools
import random
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.operators import audit, resample
from sievework.plans import composites


def weights(df, n):
    """(uid, label, replicate) to the weight of each row of a table with weights."""
    each = F.explode(F.array(*(F.struct((F.col("_block") * resample.TOGETHER + k).alias("r"), F.col(f"_w{k}").alias("w")) for k in range(min(n, resample.TOGETHER)))))
    return [r for r in df.select("uid", "label", "y", each.alias("x")).select("uid", "label", "y", "x.*").where(f"r < {n}").collect()]


def plain_auc(rows):
    pos, neg = [(p, w) for y, p, w in rows if y == 1], [(p, w) for y, p, w in rows if y != 1]
    total = sum(w for _, w in pos) * sum(w for _, w in neg)
    return sum(w * v * ((p > q) + (p == q) / 2) for p, w in pos for q, v in neg) / total if total else None


def sample(n=90, seed=1):
    rng = random.Random(seed)
    return [(u, label, int(rng.random() < 0.3), rng.choice([0.1, 0.2, 0.5, rng.random()])) for u in range(n) for label in ("a", "b")]


@pytest.mark.parametrize("stratified", [False, True])
def test_replicate_auc(spark, stratified):
    rows, n = sample(), 20  # more replicates than ride on one row
    df = spark.createDataFrame(rows, "uid int, label string, y int, p double")
    drawn = (resample.with_draws(df, n, leaf=8) if stratified else resample.with_weights(df, n)).cache()
    w = {(x.uid, x.label, x.r): x.w for x in weights(drawn, n)}
    got = {(r.label, r.replicate): r.auc for r in resample.replicate_auc(drawn, ["label"], "y", "p", n).collect()}
    assert len(got) == 2 * n
    for (label, r), a in got.items():
        assert a == pytest.approx(plain_auc([(y, p, w[u, x, r]) for u, x, y, p in rows if x == label]), abs=1e-12)


@pytest.mark.parametrize("leaf", [4, 4096])
def test_class_totals_hold(spark, leaf):
    rows = [*sample(), (500, "a", None, 0.5), (501, "c", 1, 0.5)]
    size = {}
    for _, label, y, _ in rows:
        if y is not None:
            size[label, y] = size.get((label, y), 0) + 1
    found, all_ = {}, []
    for x in weights(resample.with_draws(spark.createDataFrame(rows, "uid int, label string, y int, p double"), 40, leaf=leaf), 40):
        found[x.label, x.y, x.r] = found.get((x.label, x.y, x.r), 0) + x.w
        all_.append(x.w)
    assert found == {(label, y, r): n for (label, y), n in size.items() for r in range(40)}
    # As often left out, and as often drawn twice, as draws with replacement are.
    assert abs(np.mean(np.array(all_) == 0) - np.exp(-1)) < 0.02 and abs(np.mean(np.array(all_) == 2) - np.exp(-1) / 2) < 0.02


def test_bootstraps_of_nothing(spark):
    df = spark.createDataFrame([], "uid int, label string, y int, p double")
    assert resample.bootstrap_macro(df, 5).first().n == 0 and resample.bootstrap_macro(df, 5, stratified=True).first().n == 0


def test_unranking():
    for n, k in ((6, 3), (9, 2), (5, 5), (7, 1)):
        masks = [composites.unranked(r, k) for r in range(comb(n, k))]
        assert masks == sorted(sum(1 << i for i in s) for s in itertools.combinations(range(n), k))
    drawn = composites.random_subsets(6, 500, 2, 4)
    assert sum(drawn.values()) == 500 and {m.bit_count() for m in drawn} == {2, 3, 4} and drawn == composites.random_subsets(6, 500, 2, 4)


def test_subset_study(spark):
    rng = np.random.default_rng(4)
    names, n = ["m0", "m1", "m2", "m3", "m4"], 60
    y = {"a": rng.integers(0, 2, n), "b": rng.integers(0, 2, n)}
    p = {(m, x): np.round(y[x] * 0.3 + rng.random(n), 2) for m in names for x in y}
    rows = [(m, u, x, int(y[x][u]), float(p[m, x][u])) for m in names for x in y for u in range(n)]
    got = composites.subset_study(spark.createDataFrame(rows, "member string, uid int, label string, y int, p double"), 30, 2, 4).collect()
    rank = {k: pd.Series(v).rank(pct=True) for k, v in p.items()}
    auc = lambda s, t: plain_auc([(a, round(b, 9), 1) for a, b in zip(t, s)])
    assert sum(r.draws for r in got) == 30
    for r in got:
        own = [m for k, m in enumerate(names) if r.mask >> k & 1]
        assert r.members == ",".join(own) and r.size == len(own)
        assert r.macro_auc == pytest.approx(np.mean([auc(sum(rank[m, x] for m in own) / len(own), y[x]) for x in y]), abs=1e-9)
        assert r.solo == pytest.approx(np.mean([np.mean([auc(p[m, x], y[x]) for x in y]) for m in own]), abs=1e-9)
        assert r.rho == pytest.approx(np.mean([np.mean([np.corrcoef(rank[a, x], rank[b, x])[0, 1] for x in y]) for a, b in itertools.combinations(own, 2)]), abs=1e-9)
    study = spark.createDataFrame(got)
    margin = {r.member: r.value for r in composites.subset_margins(study).collect()}
    mean = lambda rows: sum(r.macro_auc * r.draws for r in rows) / sum(r.draws for r in rows)
    for m in names:
        assert margin[m] == pytest.approx(mean([r for r in got if m in r.members]) - mean([r for r in got if m not in r.members]), abs=1e-9)
    x = np.array([[1, 1 - r.rho, np.log(r.size)] for r in got for _ in range(r.draws)])
    want = np.linalg.lstsq(x, np.array([r.gain for r in got for _ in range(r.draws)]), rcond=None)[0]
    assert [r.coef for r in composites.subset_model(study).collect()] == pytest.approx(want, abs=1e-6)


def test_triangles(spark):
    rng = random.Random(2)
    cells = [(u, x, rng.choice([0.0, 1.0, None]), rng.random()) for u in range(40) for x in "dabc" if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "uid int, label string, g double, w double")
    got = {(r.row, r.col): (r.triangle, r.r, r.n) for r in audit.two_triangles(df, "uid", "label", "g", "w").collect()}
    wide = {v: pd.DataFrame(cells, columns=["u", "x", "g", "w"]).pivot(index="u", columns="x", values=v) for v in "gw"}
    for a, b in itertools.combinations("abcd", 2):
        for key, v, name in (((a, b), "g", "gold"), ((b, a), "w", "weak")):
            both = wide[v][[a, b]].dropna()
            assert got[key][0] == name and got[key][2] == len(both) and got[key][1] == pytest.approx(both[a].corr(both[b]), abs=1e-9)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(audit.two_triangles(df, "uid", "label", "g", "w")._jdf.queryExecution(), "simple")
    assert "Join" not in plan
    top = audit.top_pairs(audit.two_triangles(df, "uid", "label", "g", "w"), n=2).collect()
    assert len(top) == 2 and abs(top[0].r) >= abs(top[1].r)


def test_audit_reads_cells_once(spark):
    """Nulls, a language without gold, labels without verdict; all sections there; one scan of the cells."""
    rng, seen = random.Random(6), spark.sparkContext.accumulator(0)
    cells = [(u, None if u % 9 == 0 else "xy"[u % 2], s, x, None if rng.random() < 0.1 else rng.random(), rng.choice(["YES", "NO", "UNK", None])) for u in range(60) for s in ("s", "t") for x in ("a", "b")]
    gold = [(u, x, float(rng.random() < 0.5)) for u in range(0, 60, 2) for x in ("a", "b")]
    df = spark.createDataFrame(cells, "uid int, lang string, source string, label string, value double, verdict string")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = audit.label_audit(df.mapInArrow(counted, df.schema), spark.createDataFrame(gold, "uid int, label string, y double"), ["s", "t"], "s", ("a", "b"), replicates=10).collect()
    assert seen.value == len(cells)
    assert {r.section for r in out} == set(range(1, 7))
    at = {(r.section, r.lang, r.label, r.a, r.b, r.measure): r.value for r in out}
    assert at[1, "y", None, None, None, "studies"] == len({u for u, lang, *_ in cells if lang == "y"})
    assert at[1, None, None, None, None, "studies"] == 7 and at[1, None, None, None, None, "all_studies"] == 60
    first = [(v, w) for u, _, s, x, v, w in cells if s == "s" and x == "a"]
    assert at[2, None, "a", None, None, "unk"] == pytest.approx(sum(w == "UNK" for _, w in first) / 60)
    assert at[2, None, "a", "s", None, "positive"] == pytest.approx(np.mean([v >= 0.5 for v, _ in first if v is not None]))
    assert at[5, None, "a", "b", None, "n"] == sum(w == "UNK" for _, w in first)
