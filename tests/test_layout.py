"""Rows of text and units against plain loops, over batches that cut documents apart."""

import random

import pytest

from vellum.operators import layout


def plain_buckets(rows, max_center=18.0, min_overlap=0.45):
    out, buckets = {}, {}
    for doc, i, x1, y1, x2, y2 in sorted(rows, key=lambda g: (g[0], g[3], (g[3] + g[5]) / 2, g[2], g[1])):
        own, best = buckets.setdefault(doc, []), None
        for k, (lo, hi) in enumerate(own):
            apart = abs((y1 + y2) / 2 - (lo + hi) / 2)
            shared = max(0, min(y2, hi) - max(y1, lo)) / max(min(y2 - y1, hi - lo), 1)
            if (apart <= max_center or shared >= min_overlap) and (best is None or apart < best[0]):
                best = (apart, k)
        if best is None:
            best = (0, len(own))
            own.append((y1, y2))
        lo, hi = own[best[1]]
        own[best[1]] = (min(lo, y1), max(hi, y2))
        out[doc, i] = best[1] + 1
    return out


def plain_units(rows):
    out, before = {}, None
    for doc, bucket, i, x1, x2 in sorted(rows, key=lambda g: (g[0], g[1], g[3], g[4], g[2])):
        if (doc, bucket) != before:
            before, unit, reason = (doc, bucket), 0, "first_in_line"
        else:
            reason = "gap_too_wide" if x1 - right > 60 else "unit_too_wide" if max(right, x2) - left > 420 else "merged"
        if reason == "merged":
            right = max(right, x2)
        else:
            unit, left, right = unit + 1, x1, x2
        out[doc, bucket, i] = (unit, reason)
    return out


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("tall", [12, 90])
def test_buckets_and_units_against_plain_loops(spark, small_batches, tall):
    rng, rows = random.Random(tall), []
    for doc, n in enumerate([1, 150, 3, 0, 7, 14, 1, 40, 2]):
        for i in range(n):
            x, y = rng.randrange(0, 900, 3), rng.randrange(0, 700, 5)
            rows.append((doc, i, x, y, x + rng.randrange(1, 90), y + rng.randrange(0, tall)))
    boxes = spark.createDataFrame(rows, "doc long, id long, x1 long, y1 long, x2 long, y2 long")
    lines = layout.line_buckets(boxes, keep=("x1", "x2"))
    found = lines.collect()
    want = plain_buckets(rows)
    assert {(r.doc, r.id): r.bucket for r in found} == want and len(found) == len(rows)
    assert {(r.doc, r.id, r.x1, r.x2) for r in found} == {(d, i, x1, x2) for d, i, x1, _, x2, _ in rows}
    units = layout.text_units(lines).collect()
    assert {(r.doc, r.bucket, r.id): (r.unit, r.reason) for r in units} == plain_units([(d, want[d, i], i, x1, x2) for d, i, x1, _, x2, _ in rows])
    assert len(units) == len(rows) and {r.reason for r in units} == {"first_in_line", "gap_too_wide", "unit_too_wide", "merged"}
    assert layout.text_units(layout.line_buckets(boxes.filter("doc < 0"), keep=("x1", "x2"))).count() == 0


def test_lines_without_a_document_are_one_group(spark, small_batches):
    rows = spark.range(20).selectExpr("cast(null as long) AS doc", "id", "id * 30 AS x1", "5L AS y1", "id * 30 + 20 AS x2", "15L AS y2")
    units = layout.text_units(layout.line_buckets(rows, keep=("x1", "x2"))).collect()
    assert len(units) == 20 and {r.doc for r in units} == {None} and {r.bucket for r in units} == {1} and {r.unit for r in units} == {1, 2}


def test_no_call_for_each_line(spark):
    """A frame for each line of text took more than a millisecond."""
    from types import SimpleNamespace

    from vellum.plans import structure

    rows = spark.range(400).selectExpr("id * 7 AS l_orderkey", "id % 7 AS l_linenumber", "id * 31 AS l_partkey", "id * 17 AS l_suppkey", "cast(id % 50 AS double) AS l_quantity", "'A' AS l_returnflag")
    plan = structure.text_units(SimpleNamespace(spark=spark, lineitem=rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan and plan.count("Range (") == 1
