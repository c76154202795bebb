"""Corpus rule analytics on Spark: documents, rules, findings, gates and reports as DataFrames."""
