"""Operators over load series. All take and return DataFrames keyed by series_id and ts."""
