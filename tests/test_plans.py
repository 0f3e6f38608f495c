"""What the plans must show: pruned columns, pushed filters, no product of tables."""

import pytest

from hexloom.plans import base, built_queries, coverage_queries, metric_queries, pipeline_queries, quality_queries, serving_queries, time_queries

_ = (built_queries, coverage_queries, metric_queries, quality_queries, serving_queries, time_queries)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_read_one_column(spark, data):
    text = plan(pipeline_queries.p4_found(spark, data))
    assert "ReadSchema: struct<h3_res9:string,_tmp_metadata_row_index:bigint>" in text and "place_id" not in text


def test_latest_snapshots_reach_the_scan(spark, data):
    from hexloom.operators.snapshots import latest_valid
    from hexloom.runtime import table

    df = latest_valid(table(spark, data, "places"), group="source", key="place_id", snapshot="snapshot", version="delivered_at", values=["lat", "lon"])
    text = plan(df)
    pushed = text[text.index("PushedFilters") :]
    assert "In(snapshot" in pushed and "category" not in pushed[: pushed.index("\n", 5)]


@pytest.mark.parametrize("name", ["cell_business_metrics", "history_fact", "corrected_series", "dup_candidates_blocked", "same_point_counts", "cell_search", "report_metrics", "open_as_of", "coordinate_collapse"])
def test_no_product_of_tables(spark, data, name):
    text = plan(base.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_counts_combine_before_the_shuffle(spark, data):
    text = plan(base.QUERIES["cell_business_metrics"](spark, data))
    assert "partial_count" in text


def test_the_ring_reaches_the_scan(spark, data):
    """A request reads the row groups of its ring: comparisons of q and r, or a list of areas, are pushed down."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name in ("report_metrics", "report_context", "places_in_catchment", "compare_points", "coverage_probe"):
        text = plan(base.QUERIES[name](spark, data))
        for scan in text.split("FileScan")[1:]:
            pushed = scan[scan.index("PushedFilters") :].split("\n")[0]
            assert "GreaterThanOrEqual(r," in pushed and "LessThanOrEqual(r," in pushed, name
        assert "FileScan" in text
    text = plan(base.QUERIES["catchment_series"](spark, data))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all("In(h3_index" in scan[scan.index("PushedFilters") :].split("\n")[0] for scan in text.split("FileScan")[1:])


def test_rows_read_follow_the_ring(spark, tmp_path):
    """Of a large sorted table only what lies near the ring is read."""
    from hexloom.operators.serving import in_ring
    from hexloom.sources.sinks import write_sorted

    n = 400_000
    write_sorted(spark.range(n).selectExpr("id % 632 as q", "id div 632 as r", "id as v"), str(tmp_path / "t"), ["r", "q"], 16)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = in_ring(spark.read.parquet(str(tmp_path / "t")), [(100, 300), (101, 300), (100, 301)])
    run = got._jdf.queryExecution()
    assert run.executedPlan().executeCollectPublic() is not None
    scans, todo = [], [run.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            scans.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.length())]
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert got.count() == 3 and scans and max(scans) <= n / 8
