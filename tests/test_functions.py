import functools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.functions import metrics, ranks, scalars, text
from sievework.operators import audit, blend, catalog, joins, labels, quality, sampling, splits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_ranks_match_pandas(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("ab"), rng.choice([None, 0.1, 0.2, 0.2, 0.5, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(data, "uid int, label string, p double")
    got = {r.uid: r.r for r in ranks.with_rank(df, ["label"], "p", "r").collect()}
    pdf = pd.DataFrame(data, columns=["uid", "label", "p"])
    want = pdf.groupby("label").p.rank(pct=True, method="average")
    for uid, w in zip(pdf.uid, want):
        assert (got[uid] is None and math.isnan(w)) or abs(got[uid] - w) < 1e-12


def test_rank_edges(spark):
    one = spark.createDataFrame([(1, "a", 0.3)], "uid int, label string, p double")
    assert rows(ranks.with_rank(one, ["label"], "p", "r", "end01"), "r") == [(0.5,)]
    none = one.where("false")
    assert ranks.with_rank(none, ["label"], "p", "r").count() == 0
    df = spark.createDataFrame([(1, "a", 0.3, True), (2, "a", 0.1, False), (3, "a", 0.9, True)], "uid int, label string, p double, ok boolean")
    assert rows(ranks.with_rank(df, ["label"], "p", "r", on=F.col("ok")).fillna(-1.0, ["r"]), "uid", "r") == [(1, 0.5), (2, -1.0), (3, 1.0)]


def test_quantile_match_properties(spark):
    rng = np.random.default_rng(2)
    pred = rng.random(50).round(2)
    ref = rng.random(31)
    p = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(pred)] + [(99, "a", None)], "uid int, label string, p double")
    r = spark.createDataFrame([("a", float(v)) for v in ref], "label string, ref double")
    got = {x.uid: x.m for x in ranks.quantile_match(p, r, ["label"], "p", "ref", "m").collect()}
    q = (pd.Series(pred).rank(method="average") - 0.5) / len(pred)
    want = np.quantile(ref, q)
    assert got[99] is None
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-12
    flat = spark.createDataFrame([(i, "a", 0.5) for i in range(9)], "uid int, label string, p double")
    assert {round(x.m, 9) for x in ranks.quantile_match(flat, r, ["label"], "p", "ref", "m").collect()} == {round(float(np.median(ref)), 9)}


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a == 1], [b for a, b in zip(y, s) if a != 1]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_auc(spark):
    rng = random.Random(3)
    y = [rng.choice([0, 1]) for _ in range(200)]
    s = [rng.choice([0.1, 0.2, 0.3, rng.random()]) for _ in y]
    df = spark.createDataFrame([("a", *x) for x in zip(y, s)] + [("b", 1, 0.5), ("b", 1, 0.7), ("a", 1, None), ("a", None, 0.5)], "label string, y int, s double")
    got = {r.label: r.auc for r in metrics.auc(df, ["label"], "y", "s").collect()}
    assert abs(got["a"] - brute_auc(y, s)) < 1e-12
    assert got["b"] is None
    assert metrics.auc(df.where("false"), ["label"], "y", "s").count() == 0


def test_auc_ignores_monotone_maps_and_order(spark):
    rng = random.Random(4)
    data = [("a", rng.choice([0, 1]), rng.random()) for _ in range(150)]
    df = spark.createDataFrame(data, "label string, y int, s double")
    a = metrics.auc(df, ["label"], "y", "s").first().auc
    b = metrics.auc(df.withColumn("s", F.exp("s") * 3).repartition(7), ["label"], "y", "s").first().auc
    assert a == b


def test_correlations_without_spread_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "label string, x double, y double")
    assert metrics.spearman(df, ["label"], "x", "y").first().rho is None
    assert df.agg(metrics.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_text_rules(spark):
    df = spark.createDataFrame([(1, " \tHello \n"), (2, "hello"), (3, None), (4, "")], "uid int, t string")
    g = {r.uid: r.g for r in df.select("uid", text.text_group(F.col("t")).alias("g")).collect()}
    assert g[1] == g[2] and g[3] == g[4] and g[1] != g[3]
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(text.language_vote(F.lit("the cat and the dog of war"))) == "en"
    assert one(text.language_vote(F.lit(None).cast("string"))) == "unk"
    assert one(text.word_count(F.lit("  a b\n c "))) == 3
    assert one(text.html_text(F.lit("<p>a &amp; b<br>c</p><ul><li>d</li></ul>"))) == "a & b\nc\n- d"
    assert one(text.progress(F.lit("[0:50] studies 10/50 | elapsed 30.5s")))["done"] == 10
    assert one(text.failure(F.lit("failed 17: no image")))["reason"] == "no image"
    import hashlib

    for uid in ("x", "1.2.840"):
        assert one(text.md5_shard(F.lit(uid), 7)) == int(hashlib.md5(uid.encode()).hexdigest(), 16) % 7


def test_log_lines(spark):
    files = spark.createDataFrame([('[{"stream_name":"stdout","data":"a\\nb"},{"stream_name":"stderr","data":"c"}]',), ('{"stream_name":"stdout","data":"d"}\n,{"stream_name":"stdout","data":"e"}',), ("plain\nlines",)], "value string")
    assert sorted(r.line for r in text.log_lines(files).collect()) == ["a", "b", "c", "d", "e", "lines", "plain"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(scalars.coded(F.lit("2.1: 10-75% area"))) == 2.1
    assert one(scalars.coded(F.lit(".: Missing"))) is None
    assert [one(scalars.flag(F.lit(x))) for x in ("", "nan", "1", " TRUE ", "no", "7")] == [None, None, 1, 1, 0, None]
    assert one(scalars.split_code(F.lit(2.1))) == 3
    assert one(scalars.plane(F.array(*(F.lit(float(x)) for x in (0, 1, 0, 0, 0, 1))))) == "Sagittal"
    assert one(scalars.plane(F.array(F.lit(1.0)))) == "unknown"
    w = lambda tr, te, seq, desc: one(scalars.weighting(F.lit(tr).cast("double"), F.lit(te).cast("double"), F.lit(seq), F.lit(desc)))
    assert [w(500, 90, "SE", ""), w(3000, 90, "SE", ""), w(3000, 20, "SE", ""), w(500, 9, "GR", ""), w(500, 9, "SE", "dess"), w(None, 9, "SE", "sag T2"), w(None, None, None, None)] == ["T1", "T2", "PD", "GRE", "GRE", "T2", "unknown"]
    assert one(scalars.confidence(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.15


def literal_greedy(groups, folds):
    size, golds, out = [0] * folds, [0] * folds, {}
    for g, n, gold in sorted(groups, key=lambda x: (-x[2], -x[1])):
        f = min(range(folds), key=lambda f: (golds[f], size[f], f) if gold else (size[f], f))
        size[f] += n
        golds[f] += gold
        out[g] = f
    return sorted(zip(size, golds)), out


@pytest.mark.parametrize("seed", range(4))
def test_folds_match_a_literal_greedy(spark, seed):
    rng = random.Random(seed)
    groups = [(f"g{i}", rng.choice([1, 1, 1, 2, 3, 40]), 0) for i in range(rng.randrange(5, 300))]
    groups = [(g, n, rng.choice([0, 0, 0, rng.randrange(0, n + 1)])) for g, n, _ in groups]
    df = spark.createDataFrame(groups, "group string, n long, gold long")
    got = splits.assign_folds(df, 5)
    sizes = got.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("gold").alias("g")).collect()
    want, _ = literal_greedy(groups, 5)
    have = sorted((r.n, r.g) for r in sizes)
    assert have == [w for w in want if w != (0, 0)] or have == want
    assert got.count() == len(groups)


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3 == 0, i % 5) for i in range(20)], "uid int, is_gold boolean, fold int")
    a, b = splits.split(df, "fold", 2)
    assert a.count() == 16 and b.count() == 4
    a, b = splits.split(df, "train_gold")
    assert a.count() + b.count() == 20 and b.where("not is_gold").count() == 0
    assert splits.split(df, "train_all")[1].count() == 0
    with pytest.raises(ValueError):
        splits.split(df, "other")


def literal_slots(bag):
    out, used = {}, set()
    conds = {"SAG_FLUID_FS": ("Sagittal", lambda f, s, w: f and s, lambda f, s, w: f), "COR_FLUID_FS": ("Coronal", lambda f, s, w: f and s, lambda f, s, w: f), "AX_FLUID_FS": ("Axial", lambda f, s, w: f and s, lambda f, s, w: f), "SAG_FLUID_NOFS": ("Sagittal", lambda f, s, w: f and not s, lambda f, s, w: f), "COR_T1": ("Coronal", lambda f, s, w: w == "T1", lambda f, s, w: not f), "SAG_T1": ("Sagittal", lambda f, s, w: w == "T1", lambda f, s, w: not f)}
    for strict in (True, False):
        for name, (plane, tight, loose) in conds.items():
            free = [r for r in bag if r[2] == plane and (tight if strict else loose)(*r[3:6]) and r[1] not in used]
            if name not in out and free:
                best = min(free, key=lambda r: (abs(r[6] - 32), r[0]))
                out[name] = best[1]
                used.add(best[1])
    return out


def test_slots_match_a_literal_greedy(spark):
    rng = random.Random(5)
    data, want = [], {}
    for uid in range(40):
        bag = [(k, f"s{k}", rng.choice(["Sagittal", "Coronal", "Axial"]), rng.random() < 0.6, rng.random() < 0.5, rng.choice(["T1", "T2"]), rng.randrange(5, 60)) for k in range(rng.randrange(1, 9))]
        want[uid] = literal_slots(bag)
        data += [(uid, *r) for r in bag]
    df = spark.createDataFrame(data, "uid int, ord int, series string, plane string, fluid boolean, fat_sat boolean, weighting string, n_slices int")
    assert {r.uid: r.slots for r in catalog.select_slots(df).collect()} == want


def test_slice_rules(spark):
    s = spark.createDataFrame([("a", "f1", 3.0, None), ("a", "f2", 1.0, None), ("b", "f1", None, 2), ("b", "f2", 5.0, 1), ("c", "f2", None, None), ("c", "f1", 2.0, 1)], "series string, file string, position double, instance int")
    assert rows(catalog.slice_order(s), "series", "place", "file") == [("a", 0, "f2"), ("a", 1, "f1"), ("b", 0, "f2"), ("b", 1, "f1"), ("c", 0, "f1"), ("c", 1, "f2")]
    n = spark.createDataFrame([("a", 10)], "series string, n_slices int")
    got = [r.place for r in catalog.band_sample(n, 5, 0.1, 0.9).orderBy("k").collect()]
    assert got == np.linspace(1, 8, 5).round().astype(int).tolist()
    g = spark.createDataFrame([("a", i, i in (1, 4)) for i in range(6)], "k string, i int, ok boolean")
    assert rows(catalog.nearest_good(g, ["k"], "i", "ok"), "i", "source") == [(0, 1), (1, 1), (2, 1), (3, 4), (4, 4), (5, 4)]


def test_side(spark):
    s = spark.createDataFrame([(1, "L", 30.0), (1, "R", 30.0), (2, "R", 40.0), (3, "", -50.0), (4, "", 5.0), (5, None, None)], "uid int, tag string, centre_x double")
    assert rows(catalog.side(s), "uid", "side", "conflict") == [(1, "L", 0), (2, "", 1), (3, "R", 0), (4, "", 0), (5, "", 0)]


def test_blend_metamorphic(spark):
    rng = random.Random(6)
    mk = lambda seed: spark.createDataFrame([(u, "a", rng.random()) for u in range(30)], "uid int, label string, p double")
    a, b = mk(1), mk(2)
    got = blend.mix_ranked(a, b, [0.0, 1.0]).collect()
    ra = {r.uid: r.r for r in ranks.with_rank(a, ["label"], "p", "r").collect()}
    rb = {r.uid: r.r for r in ranks.with_rank(b, ["label"], "p", "r").collect()}
    for r in got:
        assert abs(r.p - (ra if r.beta == 0 else rb)[r.uid]) < 1e-9
    m = a.withColumn("member", F.lit("x")).unionByName(a.withColumn("member", F.lit("y")).withColumn("p", F.col("p") * 7))
    assert all(abs(r.p - ra[r.uid]) < 1e-12 for r in blend.rank_mean(m).collect())


@pytest.mark.parametrize("fail_a,fail_b", [(set(), set()), ({1, 2}, set()), ({1}, {2}), ({3}, {3}), (set(range(6)), set()), (set(range(6)), set(range(6)))])
def test_failures(spark, fail_a, fail_b):
    va, vb = [0.1, 0.5, 0.2, 0.9, 0.5, 0.3], [0.3, 0.2, 0.8, 0.1, 0.6, 0.2]
    mk = lambda v, bad: spark.createDataFrame([(u, "a", x, u not in bad) for u, x in enumerate(v)], "uid int, label string, p double, ok boolean")
    got = {r.uid: r.p for r in blend.two_with_failures(mk(va, fail_a), mk(vb, fail_b), 0.6).collect()}
    rank = lambda v, bad: pd.Series([x for u, x in enumerate(v) if u not in bad], index=[u for u in range(6) if u not in bad]).rank(pct=True)
    ra, rb = rank(va, fail_a), rank(vb, fail_b)
    for u in range(6):
        want = 0.5 if u in fail_a & fail_b else rb[u] if u in fail_a else ra[u] if u in fail_b else 0.6 * ra[u] + 0.4 * rb[u]
        assert abs(got[u] - want) < 1e-9


def quotas(capacities, shares, target):
    """Largest remainders, cut to the capacities, then turn by turn to the open slot that is owed most. Sums are plain additions in
    order, which decide ties between slots that are owed the same."""
    added = lambda xs: functools.reduce(lambda a, b: a + b, xs, 0.0)
    total = added(shares)
    ideal = [target * s / total for s in shares]
    out = [int(x) for x in ideal]
    for i in sorted(range(len(out)), key=lambda i: -(ideal[i] - out[i]))[: target - sum(out)]:
        out[i] += 1
    out = [min(q, c) for q, c in zip(out, capacities)]
    owed = [0.0] * len(out)
    for _ in range(min(target, sum(capacities)) - sum(out)):
        room = [i for i in range(len(out)) if out[i] < capacities[i]]
        weight = added(shares[i] if i in room else 0.0 for i in range(len(out)))
        for i in room:
            owed[i] += shares[i] / weight
        best = max(room, key=lambda i: (owed[i], -i))
        out[best] += 1
        owed[best] -= 1
    return out


@pytest.mark.parametrize("target", [1, 13, 59])
def test_quotas_fill(spark, target):
    rng, made, want = random.Random(target), [], []
    for u in range(80):
        n = rng.randrange(1, 7)
        room, share = [rng.randrange(0, 30) for _ in range(n)], [rng.choice([1.0, 2.0, rng.random() + 0.1]) for _ in range(n)]
        q = quotas(room, share, target)
        assert sum(q) == min(target, sum(room)) and all(0 <= a <= b for a, b in zip(q, room))
        made += [(u, k, c, s) for k, (c, s) in enumerate(zip(room, share))]
        want += [(u, k, x) for k, x in enumerate(q)]
    df = spark.createDataFrame(made, "uid int, slot int, room int, share double")
    assert rows(sampling.allocate(df, "uid", "slot", "room", "share", target), "uid", "slot", "quota") == want


def test_quotas_of_nulls_and_zeros(spark):
    df = spark.createDataFrame([("u", "a", 5, 1.0), ("u", "b", 50, 1.0), ("v", "a", 4, 0.0), ("v", "b", 9, None), ("w", "a", None, 1.0)], "uid string, slot string, room int, share double")
    assert rows(sampling.allocate(df, "uid", "slot", "room", "share", 20), "uid", "slot", "quota") == [("u", "a", 5), ("u", "b", 15), ("v", "a", 4), ("v", "b", 9), ("w", "a", 0)]


def test_windows(spark):
    w = spark.createDataFrame([("a", c, 24) for c in range(1, 23)] + [("b", c, 8) for c in range(1, 7)], "k string, c int, n int")
    got = sampling.trim_ends(w, ["k"], "c", "n", 2)
    assert rows(got.where("k = 'a'"), "c") == [(c,) for c in range(3, 21)] and got.where("k = 'b'").count() == 6
    assert rows(sampling.trim_ends(w.where("k = 'a'"), ["k"], "c", "n", 12), "c") == [(12,)]


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("b", float("nan")), ("c", None)], "uid string, p double")
    assert rows(quality.duplicates(df, ["uid"]), "uid", "n") == [("a", 2)]
    assert quality.out_of_range(df, "p").count() == 2
    with pytest.raises(quality.DataError):
        quality.require(quality.duplicates(df, ["uid"]), "duplicates")
    quality.require(quality.duplicates(df.where("uid <> 'a'"), ["uid"]), "duplicates")
    assert quality.low_coverage(df.where("uid = 'a'"), df, "uid", 0.5).count() == 1
    assert quality.too_many_failed(df, F.col("p").isNull(), 0, 0.0).count() == 1


def test_teacher_mix_leaves_uncovered_and_gold(spark):
    soft = spark.createDataFrame([(i, "a", i / 20) for i in range(20)], "uid int, label string, value double")
    teach = spark.createDataFrame([("t", i, "a", 1 - i / 20) for i in range(10)], "source string, uid int, label string, value double")
    gold = spark.createDataFrame([(0,), (1,)], "uid int")
    got = {r.uid: r.value for r in labels.mix_teacher(soft, teach, gold, 0.5).collect()}
    assert all(got[i] == i / 20 for i in [0, 1, *range(10, 20)])
    assert any(abs(got[i] - i / 20) > 1e-6 for i in range(2, 10)) and all(0 <= v <= 1 for v in got.values())
    same = {r.uid: r.value for r in labels.mix_teacher(soft, teach, gold, 0.5, soft.where("false").select("uid", "label"), 0.9).collect()}
    assert same == got


def test_first_known_and_gold(spark):
    df = spark.createDataFrame([(1, None, 0), (1, 2.0, 1), (1, 3.0, 2), (2, None, 0)], "uid int, v double, prio int")
    assert rows(labels.first_known(df, ["uid"], "v", "prio").fillna(-1.0), "uid", "v") == [(1, 2.0), (2, -1.0)]


def test_joins(spark):
    t = spark.createDataFrame([(1, None, 9), (2, 1, 9), (3, 2, 9), (4, 1, 9)], "id long, parent long, topic int")
    assert [r.id for r in joins.reply_tree(t).orderBy("path").collect()] == [1, 2, 3, 4]
    lines = spark.createDataFrame([("f1", 0, '{"uid":"a","error":"x"}'), ("f2", 0, '{"uid":"a","v":1}'), ("f3", 0, '{"uid":"a","error":"y"}'), ("f3", 1, "{bad")], "file string, at int, line string")
    got = joins.merge_evidence(lines, "uid string, v int, error string", "uid").first()
    assert got.r.v == 1
    assert joins.unreadable(lines, "uid string, v int, error string", "uid").first().unreadable == 1


def test_repeated_rows(spark):
    m = spark.createDataFrame([("m", u, x, p) for u, a, b in ((1, 0.1, 0.2), (2, 0.1, 0.2), (3, 0.3, 0.4)) for x, p in (("a", a), ("b", b))], "member string, uid int, label string, p double")
    assert rows(blend.repeated_rows(m), "uid") == [(1,), (2,)]


def test_audit_on_empty(spark):
    e = spark.createDataFrame([], "uid int, source string, label string, verdict string, value double, w double")
    assert audit.silence(e, ["source"]).count() == 0
    assert audit.quantile_profile(e, ["label"]).count() == 0
