"""Cases of readers, keys, trees and references."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import ranks, text
from sievework.operators import catalog, joins, quality, splits
from sievework.sources import readers


def put(path, content):
    with open(path, "w") as f:
        f.write(content)


def test_files_of_different_column_orders(spark, tmp_path):
    put(f"{tmp_path}/a.csv", "uid,ACL,MCL\n001,0.1,0.9\n")
    put(f"{tmp_path}/b.csv", "uid,MCL,ACL\n002,0.8,0.2\n")
    put(f"{tmp_path}/c.csv", "uid,ACL\n003,0.3\n")
    got = readers.read_table(spark, str(tmp_path), ["uid"], ["ACL", "MCL"]).orderBy("uid").collect()
    assert [tuple(r) for r in got] == [("001", 0.1, 0.9), ("002", 0.2, 0.8), ("003", 0.3, None)]


def test_folds_of_two_digits(spark, tmp_path):
    for k in (3, 10, 117):
        put(f"{tmp_path}/v1_fold{k}_oof.csv", "uid,pred__A,y__A,w__A\n1,0.5,1,1\n")
    assert sorted(r.fold for r in readers.read_oof(spark, str(tmp_path), ["uid"], ["A"]).collect()) == [3, 10, 117]


def test_deep_threads_and_long_ids(spark):
    base = 1234567890120000
    rows = [(base + k, base + k - 1 if k else None, 1) for k in range(300)] + [(7, 8, 2), (8, 7, 2), (9, 99, 3)]
    got = joins.reply_tree(spark.createDataFrame(rows, "id long, parent long, topic long"))
    by = {r.id: r for r in got.collect()}
    assert len(by) == 300 and by[base + 299].depth == 299 and len({r.path for r in by.values()}) == 300
    assert [r.id for r in sorted(by.values(), key=lambda r: r.path)] == [base + k for k in range(300)]


def test_natural_key_of_long_numbers(spark):
    names = ["a20240101123456.dcm", "a20240101123457.dcm", "a9.dcm", "a10.dcm", "a000011.dcm", "b1.dcm"]
    df = spark.createDataFrame([(n,) for n in names], "file string")
    got = [r.file for r in df.orderBy(catalog.natural_key(F.col("file"))).collect()]
    assert got == ["a9.dcm", "a10.dcm", "a000011.dcm", "a20240101123456.dcm", "a20240101123457.dcm", "b1.dcm"]


@pytest.mark.parametrize("raw,want", [("&#8217;&eacute;&#x1F600;", "’é😀"), ("a &amp;lt; b &unknown; &", "a &lt; b &unknown; &"), ("&AMP;x&NotEqualTilde;", "&x≂̸"), ("&#0;&#55296;", "&#0;&#55296;")])
def test_character_references(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "h string").select(text.html_text(F.col("h"))).first()[0] == want


def test_cohort_guards(spark):
    base = spark.createDataFrame([("a", 0.5, 0, True)], "uid string, x double, fold int, is_gold boolean")
    extra = spark.createDataFrame([("b", 0.1), ("c", 0.2)], "uid string, x double")
    imaged = spark.createDataFrame([("b",)], "uid string")
    assert joins.append_cohort(base, extra, imaged, same_columns=True).count() == 2
    assert joins.append_cohort(base, extra, imaged, use=False).count() == 1
    with pytest.raises(quality.DataError):
        joins.append_cohort(base, extra, imaged, least=0.95)
    with pytest.raises(quality.DataError):
        joins.append_cohort(base, extra.withColumn("z", F.lit(1)), imaged, same_columns=True)


def test_dimension_keys_must_be_unique(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(quality.DataError):
        joins.with_dimension(rows, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k", ["v"])


def test_quantile_match_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 3)
    ref = [("l", v) for v in [0.0] * 20 + [0.1, 0.4, 0.4, 0.7, 1.0]]
    pred = [("l", k / 10) for k in range(9)]
    import numpy as np

    got = ranks.quantile_match(spark.createDataFrame(pred, "k string, p double"), spark.createDataFrame(ref, "k string, v double"), ["k"], "p", "v", "m")
    want = np.quantile([v for _, v in ref], [(k + 0.5) / 9 for k in range(9)])
    assert np.allclose([r.m for r in got.orderBy("p").collect()], want)


def test_row_rank_with_nulls_and_ties(spark):
    rows = [("a", None, 2), ("a", 0.5, 3), ("a", None, 1), ("a", 0.5, 1), ("b", 0.1, 1)]
    got = ranks.with_row_rank(spark.createDataFrame(rows, "k string, v double, t int"), ["k"], "v", "t", "r")
    assert {(r.k, r.v, r.t): r.r for r in got.collect()} == {("a", None, 1): 0.0, ("a", None, 2): 1 / 3, ("a", 0.5, 1): 2 / 3, ("a", 0.5, 3): 1.0, ("b", 0.1, 1): 0.5}


def test_balanced_turns(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(11)], "uid int, cost int")
    got = splits.balanced(rows, "uid", "cost", 3).collect()
    order = sorted(range(11), key=lambda k: (-(k % 3), k))
    want = {}
    for w in range(3):
        mine = order[w::3]
        want |= {uid: (w, t) for t, uid in enumerate([*mine[::2], *mine[1::2]])}
    assert {r.uid: (r.worker, r.turn) for r in got} == want
