"""Operators: functions from DataFrames to a DataFrame. Column names are arguments; books are a key, never a loop."""
