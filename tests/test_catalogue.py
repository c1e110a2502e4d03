"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

from roundforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, spark, small, db):
    df = catalogue.QUERIES[name](spark, small)
    result = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_validate_more_rows_with_namesakes(spark, tmp_path):
    """Products of one category that share a title: a round whose own choice is blank has its title among the others."""
    c = duckdb.connect()
    c.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'name ' || (i % 700 // 2) AS p_name, 'brand' AS p_brand, 'type' AS p_type, 1::INT AS p_size, 1.0::DOUBLE AS p_retailprice FROM range(1400) t(i)")
    c.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'a text' AS text FROM range(50) t(i)")
    for t in ("part", "documents"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = catalogue.QUERIES["q_validate_more_rows"](spark, str(tmp_path)).select("error", "pos").collect()
    want = c.execute(catalogue.ORACLES["q_validate_more_rows"]).fetchall()
    assert rows(["error", "pos"], [tuple(r) for r in got]) == rows(["error", "pos"], want)


def _filters(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"[+:]- Filter (.*?)(?=\n[ :]*[+:]- |\Z)", plan, re.S)


def test_flags_are_counted_without_a_second_scoring(spark, small):
    """Spark's own filter on what is exploded would go below the scores and bring all of them along."""
    for name in ("q_audit_flags", "q_audit_facets"):
        assert not any("regexp_extract_all" in f or "array_intersect" in f for f in _filters(catalogue.QUERIES[name](spark, small)))


def test_texts_are_searched_once(spark, small):
    """A filter on the screening stays above the search."""
    for name in ("q_exclude_high", "q_screen_flags"):
        df = catalogue.QUERIES[name](spark, small)
        assert not any("RLIKE" in f for f in _filters(df))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("(?iU)(?<!") == 1


def test_greedy_two_key_equals_a_loop(spark, small):
    from pyspark.sql import functions as F

    from roundforge.plans import views

    got = {r["key"] for r in catalogue.QUERIES["q_greedy_two_key"](spark, small).collect()}
    r = views.reviews(spark, small).select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    keyed = r.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("key"), F.col("l_orderkey").alias("a"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("b"))
    seen_a, seen_b, kept = set(), set(), set()
    for x in keyed.withColumn("pos", F.pmod(F.xxhash64("key"), F.lit(1 << 62))).orderBy("pos").collect():
        if x["a"] not in seen_a and x["b"] not in seen_b:
            kept.add(x["key"])
            seen_a.add(x["a"])
            seen_b.add(x["b"])
    assert got == kept and len(kept) > 1000


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
