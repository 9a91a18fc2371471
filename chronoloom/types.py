"""Schemas of the data model, as DDL text, which every reader and createDataFrame takes."""

from __future__ import annotations

#: One row per series, and its exploded twin; NULL is a missing value.
SERIES = "subset STRING, series_id BIGINT, values ARRAY<FLOAT>"
POINTS = "subset STRING, series_id BIGINT, step BIGINT, value DOUBLE"
MANIFEST = "subset STRING, freq STRING, n_series BIGINT, n_obs BIGINT, median_length INT, domain STRING, license STRING, origin STRING, dropped BIGINT"
#: Members of multivariate items on one axis.
ITEMS = "item_id BIGINT, member_pos INT, subset STRING, series_id BIGINT, shift BIGINT"
#: An evaluation cut and a long quantile forecast of it.
CUTS = "subset STRING, series_id BIGINT, origin INT, context ARRAY<DOUBLE>, target ARRAY<DOUBLE>"
QUANTILES = "subset STRING, series_id BIGINT, origin INT, step INT, level DOUBLE, q DOUBLE"
#: One result file per configuration.
RESULT = "config STRING, prediction_length INT, model STRUCT<MASE: DOUBLE, CRPS: DOUBLE, coverage: MAP<STRING, DOUBLE>>, ratein STRUCT<frac_k_gt1: DOUBLE>"

#: Roles of a variate, and quantile levels of a forecast (fixed values).
TARGET, PAST_COVARIATE, FUTURE_COVARIATE = 0, 1, 2
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
