"""Tidewell: table-to-table analytics operators on Spark DataFrames."""
