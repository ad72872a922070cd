"""What reaches the scans, and that hot paths stay in the JVM."""

import re

from urlmill import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark, sf):
    text = plan(registry.QUERIES["risk_summary"](spark, sf))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["page_id:bigint,url:string"] or re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["url:string"]
    assert "html" not in text


def test_filters_are_pushed(spark, sf):
    text = plan(registry.QUERIES["failures_in_window"](spark, sf))
    assert "EqualTo(event_type,error)" in text


def test_no_python_in_column_queries(spark, sf):
    for name in ("url_features", "policy_cascade", "archive_fold", "fpr_threshold", "ttl_cache_hits", "rate_limit_fold", "feed_precedence"):
        text = plan(registry.QUERIES[name](spark, sf))
        assert not re.search(r"MapInArrow|MapInPandas|BatchEvalPython|CartesianProduct|BroadcastNestedLoopJoin", text), name
