"""Operators: functions from DataFrames to DataFrames, without actions unless the name says so."""
