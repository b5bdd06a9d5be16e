"""Operators on logs, states and runs: functions from DataFrames to DataFrames."""
