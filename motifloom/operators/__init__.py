"""Operators on series: DataFrames in, DataFrames out, group-wise over ``series_id``."""
