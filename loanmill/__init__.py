"""Loan-record pipeline on Spark: upload, clean, report, train, score."""
