"""Queries over whole tables, against brute force."""

import pytest

from chronoloom.plans import catalog


def test_items_of_all_series_are_aligned(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    items = {}
    for series, values in rows:
        items.setdefault(series // 3, {})[series % 3] = {step + series % 5 * 2: v for step, v in enumerate(values)}
    want = {}
    for item, members in items.items():
        steps = [s for m in members.values() for s in m]
        want |= {(item, pos, s): m.get(s) for pos, m in members.items() for s in range(min(steps), max(steps) + 1)}
    got = catalog.QUERIES["item_aligned"](spark, sf).select("item_id", "member_pos", "step", "value").collect()
    assert len(got) == len(want) and {tuple(r[:3]): r[3] for r in got} == {k: None if v is None else pytest.approx(v) for k, v in want.items()}
    assert {r[0] for r in got} == {series // 3 for series, _ in rows}


def test_offsets_over_all_dates(spark, sf):
    days = sorted(r[0].date() for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderdate").collect())
    want = {d: i + 1 for i, d in enumerate(days)}
    got = {r["d"]: r["upto"] for r in catalog.QUERIES["batch_offsets"](spark, sf).collect()}
    assert got == want and max(got).year == 2001


def test_copies_of_all_series_are_found(spark, sf):
    series = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    for name in ("overlap_scan", "match_values"):
        got = {(r["series"], r["copy"]) for r in catalog.QUERIES[name](spark, sf).collect()}
        assert len({s for s, c in got if s == c}) >= 0.9 * len(series) and any(s % 10 and s % 3 for s, c in got)
