"""Checked writes, and readers that go by each file's own header."""

import gzip
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sievework.operators import quality
from sievework.sources import guarded, readers


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def jobs(spark, run):
    """The number of Spark jobs that run() starts."""
    sc, group = spark.sparkContext, f"count-{uuid.uuid4()}"
    sc.setJobGroup(group, "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group))


def test_write_and_refuse(spark, tmp_path):
    path = f"{tmp_path}/t"
    good, bad = spark.createDataFrame([(1, 0.5), (2, 0.7)], "uid int, v double"), spark.createDataFrame([(1, 0.5), (1, 1.7)], "uid int, v double")
    rules = [guarded.none("high", F.col("v") > 1), guarded.none("repeated", F.col("_times") > 1), guarded.exactly("rows", F.count("*"), 2)]
    assert guarded.write(guarded.times(good, ["uid"]), path, rules, ["_times"]) == {"high": 0, "repeated": 0, "rows": 2}
    with pytest.raises(quality.DataError, match="high = 1; repeated = 2"):
        guarded.write(guarded.times(bad, ["uid"]), path, rules, ["_times"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [0.5, 0.7] and os.listdir(tmp_path) == ["t"]
    guarded.write(good.where("uid = 2"), path, [])
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(path).columns == ["uid", "v"]


def test_rules_have_no_job_of_their_own(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("uid"), F.lit(0.5).alias("v"))
    rules = [guarded.none("repeated", F.col("_times") > 1), guarded.exactly("rows", F.count("*"), 100), guarded.none("high", F.col("v") > 1), guarded.at_least("mean", F.avg("v"), 0.5)]
    one = jobs(spark, lambda: guarded.write(guarded.times(df, ["uid"]), f"{tmp_path}/a", rules[:1]))
    all_ = jobs(spark, lambda: guarded.write(guarded.times(df, ["uid"]), f"{tmp_path}/b", rules))
    assert one == all_ <= 2


def test_merged_runs(spark, tmp_path):
    mk = lambda *r: spark.createDataFrame(list(r), "uid string, v double")
    ok = F.col("v").isNotNull()
    found = guarded.merge_runs(mk(("a", 1.0), ("b", None)), mk(("b", 2.0), ("c", None)), f"{tmp_path}/m", ok)
    assert found["rows"] == 2 and sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [("a", 1.0), ("b", 2.0)]
    for prior, new in ((mk(("a", 1.0)), mk(("a", 2.0))), (mk(("a", 1.0), ("a", 1.0)), mk(("b", 2.0)))):
        with pytest.raises(quality.DataError, match="repeated"):
            guarded.merge_runs(prior, new, f"{tmp_path}/m", ok)


def test_cohort(spark, tmp_path):
    base = spark.createDataFrame([("a", 0, True, 1.0), ("b", 1, False, 1.0)], "uid string, fold int, is_gold boolean, w double")
    extra = spark.createDataFrame([(f"x{k}", 1.0) for k in range(20)], "uid string, w double")
    imaged = spark.createDataFrame([(f"x{k}",) for k in range(19)], "uid string")
    found = guarded.append_cohort(base, extra, imaged, f"{tmp_path}/c", weights=["w"])
    got = spark.read.parquet(f"{tmp_path}/c")
    assert found["imaged_share"] == 0.95 and found["appended"] == 19 and got.count() == 21 and got.columns == base.columns
    assert {(r.fold, r.is_gold) for r in got.where("uid like 'x%'").collect()} == {(-1, False)}
    for kind, args in {
        "imaged_share": (extra, imaged.where("uid <> 'x3'")),
        "repeated": (extra.unionByName(base.select("uid", "w").limit(1)), imaged.unionByName(base.select("uid"))),
        "without_weight": (extra.withColumn("w", F.when(F.col("uid") != "x1", 1.0)), imaged),
        "one side": (extra.drop("w"), imaged),
    }.items():
        with pytest.raises(quality.DataError, match=kind):
            guarded.append_cohort(base, *args, f"{tmp_path}/c", weights=["w"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 21


def test_distillation(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "fold int, uid int, label string, p double")
    one = [(u % 2, u, "a", (u * 7 % 10) / 10 + u % 2) for u in range(10)]
    two = [(u % 2, u, "a", u / 10) for u in range(10)]
    path = f"{tmp_path}/d"
    guarded.distillation({"x": mk(one), "y": mk(two)}, path, folds=2, uids=10, per_fold_rank=True)
    import pandas as pd

    want = sum(pd.DataFrame(s, columns=["f", "u", "l", "p"]).pipe(lambda d: d.assign(q=d.groupby("f").p.rank(pct=True))).set_index("u").q.rank(pct=True) for s in (one, two)) / 2
    assert {r.uid: round(r.p, 9) for r in spark.read.parquet(path).collect()} == want.round(9).to_dict()
    for kind, sets in {
        "repeated": {"x": one, "y": [*two, (1, 0, "a", 0.5)]}, "uncovered": {"x": one, "y": two[1:]}, "unknown": {"x": one, "y": [*two[1:], (0, 0, "a", None)]},
        "other_folds": {"x": one, "y": [*two[1:], (2, 0, "a", 0.1)]}, "set1_fold0": {"x": one, "y": [(1, *r[1:]) for r in two]}, "uids": {"x": one[1:], "y": two[1:]},
    }.items():
        with pytest.raises(quality.DataError, match=kind):
            guarded.distillation({k: mk(v) for k, v in sets.items()}, path, folds=2, uids=10)


def test_table_headers(spark, tmp_path):
    put(f"{tmp_path}/t/a.csv", 'uid,"ACL","MCL, old"\n1,0.1,0.2\n')
    put(f"{tmp_path}/t/b b.csv", '"MCL, old", uid,ACL\n0.4,2,0.3\n')
    put(f"{tmp_path}/t/c.csv", "﻿uid,ACL,more\n3,nan,x\n")
    put(f"{tmp_path}/t/d.csv", "")
    with gzip.open(f"{tmp_path}/t/e.csv.gz", "wt") as f:
        f.write("uid,ACL\n4,0.7\n")
    got = readers.read_table(spark, f"{tmp_path}/t", ["uid"], ["ACL", "MCL, old"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", 0.1, 0.2), ("2", 0.3, 0.4), ("3", None, None), ("4", 0.7, None)]
    with pytest.raises(quality.DataError, match="PCL"):
        readers.read_table(spark, f"{tmp_path}/t", ["uid"], ["ACL", "PCL"])


def test_coded_described_and_manifest_headers(spark, tmp_path):
    put(f"{tmp_path}/c/a.txt", "ID|SIDE\n7|R\n")
    put(f"{tmp_path}/c/b.txt", "SIDE|ID\nL|8\n")
    assert sorted(tuple(r) for r in readers.read_coded(spark, f"{tmp_path}/c", ["ID", "SIDE"]).collect()) == [("7", "R"), ("8", "L")]
    put(f"{tmp_path}/d/a.tsv", "key\tname\nthe key\tthe name\nk1\tn1\n")
    put(f"{tmp_path}/d/b.tsv", '"name"\t"key"\nits name\tits key\nn2\tk2\n')
    assert sorted(tuple(r) for r in readers.read_described(spark, f"{tmp_path}/d", ["key", "name"], "key").collect()) == [("k1", "n1"), ("k2", "n2")]
    head = "uid,slots,n_slots,side,shard,blob,row,cached,mask,cache_version".split(",")
    cells = dict(zip(head, "u,s,1,L,0,b9,7,1,11,v1".split(",")))
    for k, order in enumerate((head, head[::-1])):
        put(f"{tmp_path}/m/manifest_shard{k}.csv", ",".join(order) + "\n" + ",".join(cells[c] for c in order) + "\n")
    assert {(r.blob, r.row, r.mask) for r in readers.read_manifests(spark, f"{tmp_path}/m/*.csv").collect()} == {("b9", 7, "000011")}
