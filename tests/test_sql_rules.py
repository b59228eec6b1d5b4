"""Queries against their SQL on rows where rounding and ties decide."""

import duckdb

from sievework.plans import queries_metrics, queries_tables


def both(spark, tmp_path, module, name, tables):
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = module.QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, df.collect())), sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({module.SQL[name]})").fetchall())


def test_histogram_of_halves(spark, tmp_path):
    """Balances that lie half way between two bars go up, as decimals do: 1450 is 0.145 and counts at 0.15."""
    got, want = both(spark, tmp_path, queries_tables, "score_histogram", {"customer": "SELECT range AS c_custkey, range * 25 / 1.0::DOUBLE AS c_acctbal FROM range(-10, 250)"})
    assert got == want and dict(got)[0.15] == 4


def test_equal_mixes_tie(spark):
    """0.75 * a + 0.25 * b is the same for the two rows, but not as binary fractions rounded to twelve places."""
    from sievework.operators import blend

    n, at = 10240, {6439: 4342, 6442: 4333}  # uid (its rank in a): its rank in b
    rest = iter(sorted(set(range(1, n + 1)) - set(at.values())))
    of_b = [(u, "x", float(at[u] if u in at else next(rest))) for u in range(1, n + 1)]
    a = spark.createDataFrame([(u, "x", float(u)) for u in range(1, n + 1)], "uid long, label string, p double")
    got = {r.uid: r.p for r in blend.mix_ranked(a, spark.createDataFrame(of_b, a.schema), [0.25]).collect()}
    assert len(got) == n and got[6439] == got[6442]


def test_fork_blend_of_many_rows(spark, tmp_path):
    rows = "SELECT range AS vec_id, (range * 7 % 10)::INT AS label, list_transform(range(16), lambda i: ((hash(range * 16 + i) % 1000000) / 1000000.0 - 0.5)::FLOAT) AS embedding FROM range(10240)"
    got, want = both(spark, tmp_path, queries_metrics, "fork_blend", {"embeddings": rows})
    assert len(got) == 4 * 4 * 10240 and got == want


def test_cohort_with_one_in_twenty_without_image(spark, tmp_path):
    """1,922 of 2,024 odd uids are imaged: 94.96 %."""
    from sievework.plans import queries_files

    tables = {"labels": "SELECT range AS doc_id, (range % 2)::INT AS quality, 0 AS toxic FROM range(4048)", "documents": "SELECT range AS doc_id, 'x' AS text FROM range(4048)"}
    got, want = both(spark, tmp_path, queries_files, "guarded_cohort", tables)
    assert got == want and len(got) == 2024 + 1922
