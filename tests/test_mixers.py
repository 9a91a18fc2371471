"""Mixers over the embeddings, given out a few series at a time."""

import numpy as np
import pyarrow as pa

from chronoloom.plans import base, catalog, recurrences


def test_results_leave_the_task_a_few_series_at_a_time(spark):
    """700 series of one batch come as batches of at most _FEW."""

    class Rows:
        dtypes = [("series", "bigint"), ("values", "array<double>")]

        def mapInArrow(self, each, schema):
            batch = pa.record_batch({"series": list(range(700)), "values": [[float(i), 1.0] for i in range(700)]})
            return list(each(iter([batch])))

    out = recurrences._by_few(Rows(), lambda v: {"twice": [2 * x for x in v]}, "twice array<double>")
    assert max(b.num_rows for b in out) <= recurrences._FEW
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, [2.0 * i, 2.0]) for i in range(700)]


def test_mixers_are_those_of_each_series(spark, sf):
    got = {r["series"]: r.asDict() for r in catalog.QUERIES["mixers"](spark, sf).collect()}
    series = base.arrays(spark, sf).collect()
    assert len(got) == len(series) and catalog.QUERIES["quantile_head"](spark, sf).count() == len(series)
    for r in series[:20]:
        want = recurrences._mixers(np.asarray(r["values"], float).reshape(-1, 4))
        assert all(got[r["series"]][n] == np.round(want[n].ravel(), 6).tolist() for n in want)
