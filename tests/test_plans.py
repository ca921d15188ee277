"""Plan-shape checks: the properties the scale design relies on."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hirelens.operators import merge as M
from hirelens.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlay_is_one_shuffle_no_join(spark):
    ex = fx.existing_load(spark, SF)
    nw = fx.new_load(spark, SF)
    merged, _ = M.overlay(ex, nw)
    p = plan(merged)
    assert p.count("Exchange hashpartitioning") == 1
    assert "Join" not in p
    assert "partial_max_by" in p           # map-side combine before the shuffle


def test_dedup_last_combines_map_side(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    p = plan(M.dedup_last(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]))
    assert "partial_max_by" in p and "Window" not in p


def test_postings_scan_is_pruned_and_filtered(spark):
    j = fx.jobs_view(spark, SF).filter(F.col("first_seen") >= F.lit(dt.datetime(2001, 1, 1)))
    p = plan(j.select("job_id", "first_seen"))
    orders_scan = [line for line in p.split("\n") if "FileScan parquet" in line and "o_orderkey" in line][0]
    assert "o_orderstatus" not in orders_scan and "o_totalprice" not in orders_scan
    assert "o_orderdate" in orders_scan and "DataFilters" in orders_scan


def test_no_cartesian_products(spark):
    for name in ["search", "stat_fresh", "facet_country", "run_metadata", "fetch_stats", "marker_sample"]:
        p = plan(E.queries()[name](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_python_only_where_needed(spark):
    for name in ["new_matching", "search", "merge_first_seen", "facet_ats_level", "anomaly_zscore", "norm_workday",
                 "tier_score", "dedup_last"]:
        p = plan(E.queries()[name](spark, SF))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name
    p = plan(E.queries()["html_unescape"](spark, SF))
    assert "ArrowEvalPython" in p          # the one vectorised UDF, Arrow-batched


def test_each_parser_reads_its_own_partition(spark):
    from hirelens.plans import raw_fixture as rf
    from hirelens.sources import raw as R
    raw = rf.raw_responses(spark, SF)
    for platform in ("Greenhouse", "iCIMS", "Workday"):
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(R.NORMALIZERS[platform](raw)))
        assert filters and all("platform" in f and platform in f for f in filters)


def test_accents_are_stripped_of_distinct_strings_only(spark):
    p = plan(E.queries()["geo_resolve"](spark, SF))
    assert p.count("ArrowEvalPython") <= 2


def test_keyed_reduction_sorts_and_collapses_before_its_one_shuffle(spark):
    p = plan(E.queries()["merge_first_seen"](spark, SF))
    assert p.count("Exchange hashpartitioning") == 1 and "partial_max_by" in p and "SortAggregate" in p


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    from hirelens.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda key, default=None: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=context))
