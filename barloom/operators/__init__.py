"""Operators over bars: indicators, signals, the engine, metrics, calendars, search, simulation."""
