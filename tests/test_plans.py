"""Plan shapes that must hold at scale."""

import contextlib
import io
import re

import pytest
from compare import DATA

from fieldproof.plans import catalog

SF = f"{DATA}/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "segment_verdicts", "evidence_dedup", "compliance_gate", "zone_containment", "similar_fingerprints",
    "effective_quality", "overlay_coordinates", "error_rates", "first_occurrences"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(catalog.entries()[name].run(spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", text)


def test_scan_is_pruned_and_filtered(spark):
    text = plan(catalog.entries()["segment_verdicts"].run(spark, SF))
    # Every line item is a photo, so the scan itself drops none; those without a segment go before the first exchange.
    assert re.search(r"Condition : .*l_partkey", text)
    schema = next(line for line in text.splitlines() if "ReadSchema" in line and "l_orderkey" in line)
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_dedup_combines_before_the_shuffle(spark):
    text = plan(catalog.entries()["evidence_dedup"].run(spark, SF))
    assert "partial_min" in text and "Window" not in text
