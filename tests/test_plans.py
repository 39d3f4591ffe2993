"""Plan properties that matter at scale, read from ``explain`` output."""

import contextlib
import io

from tests.conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _q(name):
    import __spark_entry__ as e
    return e.queries()[name]


def test_usage_cost_pushdown_and_pruning(spark):
    plan = _plan(_q("usage_cost")(spark, SF001))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    li_schema = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema: struct<l_orderkey")][0]
    assert "l_extendedprice" not in li_schema and "l_tax" not in li_schema
    assert "LeftOuter" not in plan


def test_vector_topk_has_no_pair_join(spark):
    plan = _plan(_q("vector_topk")(spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "MapInPandas" in plan and "WindowGroupLimit" in plan


def test_moderation_has_no_conversation_window(spark):
    plan = _plan(_q("moderation_input")(spark, SF001))
    windows = [ln for ln in plan.splitlines() if "Window " in ln and "conv_id" in ln]
    assert windows == []


def test_keyword_topk_forwards_candidates_only(spark):
    plan = _plan(_q("keyword_topk")(spark, SF001))
    assert "MapInPandas" in plan and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan
