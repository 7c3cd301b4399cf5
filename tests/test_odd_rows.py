"""Queries against their SQL on rows that the small tables don't have."""

import duckdb

from folioquery import registry


def differing(spark, folder, name, table, rows, schema):
    """Rows of a query and of its SQL over one table, as text, so that zeros keep their signs."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    got = registry.QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(str, (tuple(r) for r in got.collect()))), sorted(map(str, want))


def test_balances_near_zero_and_between_cents(spark, tmp_path):
    values = [-0.0, 0.0, None, -0.01, -0.53, 0.07, -999.99, 1234567.89, 999.995, -0.001, 0.004, 0.125, 0.375, -0.125, 2.675, 1.005, 1234.565]
    rows = [(10 * k + j, v) for k, v in enumerate(values) for j in (0, 1)]
    got, want = differing(spark, tmp_path, "numeric_cells", "customer", rows, "c_custkey long, c_acctbal double")
    assert got == want and "(1, '-0.00', 0.0)" in got and len(got) == 2 * len(values)


def test_letters_count_as_they_stand(spark, tmp_path):
    """Texts of 31 letters and a sign that one form or another counts as none, one or more."""
    signs = ["ß", "b", "", "ﬃ", "㎏", "①", "½", "é", "́", "_", "İ", "中", "\U00010570", "\U0001e7e0", "٣", "ª", "™", "x\0", None]
    ids = [i for i in range(1, 200) if i % 3 == 1 and i % 5 and i % 7]
    rows = [(i, None if s is None else "a" * n + s) for i, (s, n) in zip(ids, [(s, n) for s in signs for n in (30, 31)], strict=False)]
    assert len(rows) == 2 * len(signs)
    got, want = differing(spark, tmp_path, "readable_texts", "documents", rows, "doc_id long, text string")
    assert got == want and f"({ids[1]}, True)" in got and f"({ids[0]}, False)" in got
