"""Column expressions: frequencies, seasons, buckets, rounding and robust aggregates."""
