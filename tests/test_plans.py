"""Shapes of plans that must hold at any size."""

import pytest

from quakeframe.plans import catalogue


@pytest.fixture(scope="module")
def plan(spark, sf_dir):
    return lambda name: catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n.startswith(("kill_", "op_", "set_", "change_", "firing_", "amp_", "taper_", "window_", "scale_", "snr_", "dec_", "save_mode", "geojson"))])
def test_row_operations_neither_shuffle_nor_leave_the_jvm(plan, name):
    text = plan(name)
    assert "Exchange" not in text.replace("BroadcastExchange", "") and "Python" not in text and "Arrow" not in text


def test_scans_read_only_what_is_used(plan):
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan("kill_gt")
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan("kill_defined")
    assert "embedding" not in plan("ensemble_size")


def test_filters_reach_the_scan(plan):
    assert "GreaterThanOrEqual(user_id,10)" in plan("query_translation")


def test_members_are_edited_in_place(spark, plan):
    from pyspark.sql import functions as F

    from quakeframe.operators import edit, group
    from quakeframe.state import attribute

    rows = spark.createDataFrame([("a", [(1, 2.0), (7, 3.0)]), ("a", [(9, 4.0)]), ("a", [(9, 4.0)]), (None, []), (None, None)], "k string, members array<struct<q:int,x:double>>")
    edits = [edit.MetadataGT("q", 5).apply, edit.SetValue("y", 1.5), lambda m: m.filter(attribute("x") < 4)]
    out = group.apply_to_members(rows, edits)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Generate" not in text and "Python" not in text
    got = sorted((r.k or "", None if r.members is None else [(m.q, m.live, m.y) for m in r.members]) for r in out.collect() if r.members is not None)
    assert got == [("", []), ("a", []), ("a", []), ("a", [(1, True, 1.5), (7, False, None)])] and out.filter("members IS NULL").count() == 1
    dead = group.apply_to_members(rows.withColumn("live", F.lit(False)), edits).filter("size(members) = 2").first()
    assert [(m.q, m.x, m.live) for m in dead.members] == [(1, 2.0, None), (7, 3.0, None)]
    with pytest.raises(AttributeError):
        group.apply_to_members(rows, lambda m: m.groupBy("q").count())


def test_normalizers_of_one_key_join_the_rows_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = catalogue.QUERIES["normalizer_list"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") == 1


@pytest.mark.parametrize("name", ["match_seed_start", "match_seed_span", "match_arrival", "network_from_sites", "match_overlapping_epochs"])
def test_rows_carry_no_epochs(plan, name):
    assert "collect_list" not in plan(name) and "collect_set" not in plan(name)


@pytest.mark.parametrize("name", ["match_equality", "match_seed_start", "match_seed_span", "match_kill_on_failure", "match_origin_nearest", "match_arrival", "match_unique_only"])
def test_matchers_use_equality_joins_and_do_not_rank_rows(plan, name):
    text = plan(name)
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    assert "row_number" not in text


@pytest.mark.parametrize("name", ["bandpass", "waterlevel", "mt_spectrum_power", "error_kills"])
def test_kernels_run_in_arrow_batches(plan, name):
    assert "MapInArrow" in plan(name) and "BatchEvalPython" not in plan(name)


@pytest.mark.parametrize("name", ["last_wins", "best_member", "demean_residuals_median"])
def test_group_choices_have_no_window(plan, name):
    assert "Window" not in plan(name)
