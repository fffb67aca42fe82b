"""Operators over node, edge, document and trace tables: functions from DataFrames to DataFrames."""
