import os

import pytest

from quillon import queries as Q
from quillon.operators import spatial
from quillon.runtime import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plan(df):
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Q.queries()["range_btree_numeric"](spark, DATA))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text and "LessThanOrEqual(o_totalprice,50000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_the_box_of_a_radius_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 10.0, 20.0), (2, 50.0, 60.0)], "id int, lat double, lon double").write.parquet(str(tmp_path / "p"))
    text = plan(spatial.radius(spark.read.parquet(str(tmp_path / "p")), 10.0, 20.0, 100.0))
    assert "GreaterThanOrEqual(lat," in text and "LessThanOrEqual(lon," in text


def test_no_query_multiplies_tables(spark):
    for name in ("text_search_topk", "text_search_many", "knn_sequential", "knn_inverted", "join_lookup_coalesce", "p7_found", "result_overlap_jaccard", "text_index_stats"):
        text = plan(Q.queries()[name](spark, DATA))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text, name


def test_top_k_is_one_operator(spark):
    text = plan(spatial.nearest(table(spark, DATA, "customer").selectExpr("c_custkey", "0D AS lat", "0D AS lon"), 1, 1, 3, tie="c_custkey"))
    assert "TakeOrderedAndProject" in text


def test_layouts_are_pruned(spark):
    from quillon.plans.session import Session

    rows = spark.range(20000).selectExpr("cast(id as string) as k", "id % 7 as v")
    s = Session(spark)
    for kind in ("hash", "btree", "isam"):
        s.register(f"t_{kind}", rows, kind, "k")
    plan = plan(s.sql("SELECT v FROM t_hash WHERE k = ' 77 '"))
    assert "PartitionFilters: [isnotnull(_q_bucket" in plan and "EqualTo(_q_key,77)" in plan
    assert "GreaterThanOrEqual(_q_number,70.0)" in plan(s.sql("SELECT v FROM t_btree WHERE k BETWEEN 70 AND 79"))
    assert "EqualTo(_q_key,77)" in plan(s.sql("SELECT v FROM t_isam WHERE k = '77'"))
    read = s.sql("SELECT v FROM t_hash WHERE k = '77'")
    assert read.count() == 1 and len({f for f in s.tables["t_hash"].stored.filter("_q_key = '77'").inputFiles()}) >= 16


def test_changes_add_files_and_leave_the_rest(spark):
    from quillon.plans.session import Session

    rows = spark.range(500).selectExpr("cast(id as string) as k", "id % 7 as v")
    s = Session(spark)
    s.register("t", rows, "hash", "k")
    before = set(s.tables["t"].stored.inputFiles())
    s.sql("INSERT INTO t VALUES ('7', 99)")
    assert {r.v for r in s.sql("DELETE FROM t WHERE k = '7'").collect()} == {0, 99}
    s.sql("INSERT INTO t VALUES ('7', 5)")
    after = set(s.tables["t"].stored.inputFiles())
    assert before <= after and len(after) == len(before) + 2
    assert [r.v for r in s.sql("SELECT v FROM t WHERE k = '7'").collect()] == [5] and s.tables["t"].rows.count() == 500
    s.compact("t")
    assert not before & set(s.tables["t"].stored.inputFiles()) and s.tables["t"].rows.count() == 500


def test_layout_keeps_empty_tables_and_null_keys(spark):
    from quillon.plans.session import Session

    s = Session(spark)
    for kind in ("hash", "btree", "isam", "sequential"):
        s.register("e", spark.createDataFrame([], "k string, v int"), kind, "k")
        assert s.sql("SELECT * FROM e WHERE k = '1'").count() == 0
        s.register("n", spark.createDataFrame([(None, 1), ("", 2), (" 5", 3), ("5.0", 4)], "k string, v int"), kind, "k")
        assert s.tables["n"].rows.count() == 4
        assert sorted(r.v for r in s.sql("SELECT v FROM n WHERE k = '5'").collect()) == ([3, 4] if kind == "btree" else [3])
