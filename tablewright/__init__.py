"""Tabular data preparation and governance as plain DataFrame functions.

functions/  Column -> Column expressions and the fixed word lists behind them
operators/  DataFrame -> DataFrame transforms and long-form reports
sources/    readers, the bronze / silver / gold layers, the SQLite data source
plans/      whole chains of operators (clean, ingest, integrate, named steps)
"""
