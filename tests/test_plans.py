"""Plan assertions: what the optimizer must (not) plan for the registered queries."""

import pytest

import __spark_entry__ as E
from bibliospark.plans import catalog
from testdata_paths import SF001

# queries whose builders run jobs while planning (checkpoints): checked separately
HEAVY = {"star_load_roundtrip", "json_sink_roundtrip", "corpus_load", "landed_documents_roundtrip", "message_log_sinks",
         "incremental_star_load", "dedup_landings", "message_default_time",
         "message_stream_numbering", "harvest_stream",
         "reports_by_deltas", "discussion_search_indexed", "bucketed_article_authors",
         "bucketed_top_authors", "bucketed_top_countries", "landed_shapes", "landed_shape_drift"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    qs = catalog.queries()
    return {name: plan_of(fn(spark, SF001)) for name, fn in qs.items() if name not in HEAVY}


def test_no_cross_or_nested_loop_joins(plans):
    bad = {n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad, bad


def test_no_row_at_a_time_python_udf(plans):
    bad = {n for n, p in plans.items() if "BatchEvalPython" in p}
    assert not bad, bad


def test_python_only_in_the_distance_kernel(plans):
    py = {n for n, p in plans.items() if "MapInPandas" in p or "FlatMapCoGroupsInPandas" in p
          or "ArrowEvalPython" in p or "MapInArrow" in p}
    assert all(n.startswith("knn") or n in ("answers", "answer_blocks", "article_authors_affils")
               for n in py), py


def test_knn_limits_candidates_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans["knn_exact"]
    assert "MapInArrow" in plans["knn_exact"]
    assert "FlatMapCoGroupsInPandas" in plans["knn_exact_blocked"]


def test_reports_prune_columns_and_pre_aggregate(plans):
    p = plans["top_authors"]
    assert "struct<l_partkey:bigint>" in p          # only the key column of the bridge is read
    assert p.count("HashAggregate") >= 4             # partial + final, before and after the join
    assert "TakeOrderedAndProject" in p


def test_nth_message_limits_per_user_map_side(plans):
    assert "WindowGroupLimit" in plans["nth_message"]


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["author", "total"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_answers_read_materialised_hits_once(plans):
    # the kernel runs once, into a checkpoint, not once per branch of the answer plan
    assert "MapInArrow" not in plans["answers"]
    assert "MapInArrow" not in plans["answer_blocks"]


def test_keyword_reports_semi_join_texts_to_keys(plans):
    # documents reach the keyword split through a semi join on the order keys,
    # not through the outer-joined article view that shuffles every text
    for name in ("keyword_bag", "keyword_bag_comma"):
        assert "LeftSemi" in plans[name]
        assert "LeftOuter" not in plans[name]


def test_single_partition_only_for_partition_counts(plans):
    # a single-partition exchange may only carry the per-partition row counts
    # of the numbering (one row per partition), never the data itself
    bad = set()
    for name, p in plans.items():
        lines = p.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and "HashAggregate(keys=[_pid" not in lines[i + 1]:
                bad.add(name)
    assert not bad, bad


def test_dedup_rounds_split_hot_keys_and_move_no_text(spark):
    # two thirds of the rows share the blank id, and the first of them is blocked
    # by its title: the drop of a round is an anti join of two checkpointed tables, which AQE splits; only hashes take part
    from pyspark.sql import functions as F

    from bibliospark.operators import dedup
    hot = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in hot}
    for k, v in hot.items():
        spark.conf.set(k, v)
    try:
        ids = F.when(F.col("id") % 3 == 0, F.sha2(F.col("id").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256))
        rows = spark.range(60_000).select(F.col("id").alias("seq"), ids.alias("k1"),
                                          F.sha2(F.greatest(F.col("id") - F.when(F.col("id") == 1, 1).otherwise(0), F.lit(0)).cast("string"), 256).alias("k2"))
        rows = rows.repartition(32).checkpoint()
        accepted = dedup.accepted_of(rows).checkpoint()
        rest = dedup.undecided_after(rows, accepted)
        assert set(rest.columns) == {"seq", "k1", "k2"} and rest.count() == 39_999
        rest.collect()
        assert "skew=true" in plan_of(rest), plan_of(rest)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
