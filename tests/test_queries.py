"""Every query of the log engine against its SQL on the smallest tables."""

import pytest

from sluicelog.plans import catalogue

from .conftest import TABLES, plain


def test_all_have_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, TABLES).toPandas()) == plain(duck.execute(catalogue.SQL[name]).df())


def test_transient_shared_keeps_the_turns_that_probe(spark):
    """All rows, on topics of 2000, against a plain round of three consumers, where each turn tries the next ones until one has permits."""
    import duckdb

    tables = TABLES.replace("sf0.001", "sf0.01")
    n = {r.topic: r["count"] for r in catalogue.the_log(spark, tables).groupBy("topic").count().collect()}
    want = {}
    for topic in n:
        permits = [100, 200, 200]
        for i in range(n[topic]):
            to = next((c for c in (i % 3, (i + 1) % 3, (i + 2) % 3) if permits[c]), None)
            want[topic, i] = None if to is None else to + 1
            if to is not None:
                permits[to] -= 1
    assert min(n.values()) > 500
    got = {(r.topic, r.seq): r.consumer_id for r in catalogue.QUERIES["np_shared_drop_probing"](spark, tables).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tables}/events.parquet'")
    stated = {(topic, seq): c for topic, seq, c in con.execute(catalogue.SQL["np_shared_drop_probing"]).fetchall()}
    assert got == want == stated


def test_every_partition_elects(spark):
    n = spark.read.parquet(f"{TABLES}/part.parquet").count()
    got = {r.partition: r.consumer_id for r in catalogue.QUERIES["failover_partition_mod_all"](spark, TABLES).collect()}
    assert len(got) == n and all(c == 1 + p % 3 for p, c in got.items())
