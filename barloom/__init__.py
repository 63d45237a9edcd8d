"""Bars, indicators, backtests and training-data operators as Spark DataFrames."""
