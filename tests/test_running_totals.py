"""Running totals: light and heavy keys, and bounds that differ each time they are computed."""

import random

from pyspark.sql import functions as F

from sievework.functions import metrics, ranks
from sievework.operators import audit, splits


def brute(rows):
    return {(k, x): (sum(n for j, y, n in rows if j == k and y < x), sum(n for j, _, n in rows if j == k)) for k, x, n in rows}


def test_light_and_heavy_keys(spark):
    rng = random.Random(1)
    rows = [("a", x, rng.randrange(5)) for x in rng.sample(range(5000), 400)] + [("b", x, 1) for x in range(30)] + [("c", 7, 3)]
    df = spark.createDataFrame([*rows, (None, 5, 1)], "k string, x long, n long").repartition(4)
    for light in (0, 30, 10_000):
        got = {(r.k, r.x): (r.n_before, r.n_total) for r in ranks.running_total(df, ["k"], "x", ["n"], light=light).collect() if r.k is not None}
        assert got == brute(rows)


def shaky(monkeypatch, seen=None):
    """Bounds as on a cluster, where sketches are merged in whatever order they come: different at each computation."""
    plain = F.percentile_approx

    @F.udf("array<long>")
    def moved(bounds):
        return [b + random.SystemRandom().randrange(40) for b in bounds]

    def approx(*args):
        if seen is not None:
            seen.append(args)
        return moved.asNondeterministic()(plain(*args))

    monkeypatch.setattr(ranks.F, "percentile_approx", approx)


def test_totals_do_not_depend_on_bounds(spark, monkeypatch):
    """The bounds of a value's bucket and those of the buckets' totals are the same ones (sub_chunks, ranks)."""
    if hasattr(ranks, "LIGHT"):
        monkeypatch.setattr(ranks, "LIGHT", 100)
    shaky(monkeypatch)
    df = spark.range(3000).select(F.col("id").alias("uid")).repartition(4)
    got = {r.uid: r.chunk for r in splits.chunks(df, "uid", 300).collect()}
    assert got == {i: i // 300 for i in range(3000)}


def test_series_of_few_slices_need_no_bounds(spark, monkeypatch):
    """order_audit: no sketch per series, whose number grows with the input."""
    seen = []
    shaky(monkeypatch, seen)
    df = spark.range(4000).selectExpr("id div 4 as series", "id as file_at", "cast(case when id % 8 = 0 then 9 else id % 4 end as double) as position")
    got = audit.order_audit(df).first()
    assert not seen and got.series == 1000 and abs(got.in_order - 0.5) < 1e-9


def test_auc_of_light_and_heavy_keys(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, rng.randrange(300) / 7, int(rng.random() < 0.4)) for k in "ab" for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, s double, y int").repartition(4)
    want = {r.k: r.auc for r in metrics.auc(df, ["k"], "y", "s").collect()}
    monkeypatch.setattr(ranks, "LIGHT", 20)
    assert {r.k: r.auc for r in metrics.auc(df, ["k"], "y", "s").collect()} == want


def test_sub_chunks_sql_of_many_parts():
    """More than 4,096 parts: the SQL gives every row its part."""
    import duckdb

    from sievework.plans.queries_tables import SQL

    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT range AS doc_id FROM range(1500000)")
    assert c.execute(f"SELECT count(*), max(chunk), min(chunk) FROM ({SQL['sub_chunks']})").fetchall() == [(1500000, 4999, 0)]
