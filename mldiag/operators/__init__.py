"""Diagnostic operators: functions from DataFrames to lazy result DataFrames."""
