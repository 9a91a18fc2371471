"""Operators over points (keys..., step, value) and series (keys..., values array); a missing value is NULL."""
