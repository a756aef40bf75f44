"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    import pandas as pd

    return sorted(tuple("" if pd.isna(v) else str(v).removesuffix(" 00:00:00") for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    elif "ok" in got:
        assert got.ok.all()
    assert len(got)


def test_consistency_of_many_users(spark, tmp_path):
    """Ids of users as large as in larger tables, beyond two octets."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (user_id * 1601 + 65530 AS user_id) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(queries.ORACLE_SQL["type_consistency"]).df()
    assert rows(queries.QUERIES["type_consistency"](spark, str(tmp_path)).toPandas()) == rows(want)


def test_carried_addresses(spark, tmp_path):
    from sparkloom.plans.log_lines import log_lines

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE event_id WHEN 0 THEN 255 WHEN 1 THEN 65535 WHEN 2 THEN 65536 WHEN 3 THEN 89999 ELSE 16777215 END AS user_id, 'view' AS event_type) FROM '{DATA}/events.parquet' WHERE event_id < 5) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    address = {carried: [r.raw.split(" ")[3] for r in log_lines(spark, str(tmp_path), carried).orderBy("log_idx").collect()] for carried in (False, True)}
    assert address[True] == ["10.0.0.255", "10.0.255.255", "10.1.0.0", "10.1.95.143", "10.255.255.255"]
    assert address[False][:4] == ["10.0.0.255", "10.0.255.255", "10.0.256.0", "10.0.351.143"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
