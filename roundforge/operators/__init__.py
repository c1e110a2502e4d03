"""Operators: functions from DataFrames to DataFrames. None of them collects rows that grow with the input."""
