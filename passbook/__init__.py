"""Ledger analytics on Spark DataFrames: ingest, search, rules, transfers, categories."""
